"""Downsampling and chart figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.meaning import BAD, ESTIMATED, finite, usable
from tideline.functions.times import since
from tideline.operators.sequence import neighbour, running


def bins(norm: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """Rows of ``[start, end)`` with ``bin`` of ``n`` equal ones; exact at any width."""
    own = norm.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end))
    offset = (F.col("ts_ns") - F.lit(start)).cast("decimal(38,0)") * n
    return own.withColumn("bin", F.call_function("div", offset, F.lit(end - start).cast("decimal(20,0)")))


def m4(norm: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """``(series_id, bin, ts_ns, value)``: the first, lowest, highest and last finite value of each bin;
    equal values count at their earliest time."""
    return _extremes(bins(norm.where(finite(F.col("value"))), start, end, n))


def _extremes(own: DataFrame) -> DataFrame:
    at = F.struct("ts_ns", "value")
    # the earliest of equal values: the order's second part is the time, turned round for the highest
    picks = own.groupBy("series_id", "bin").agg(
        F.min_by(at, "ts_ns").alias("first"),
        F.min_by(at, F.struct("value", "ts_ns")).alias("low"),
        F.max_by(at, F.struct(F.col("value"), (-F.col("ts_ns")).alias("t"))).alias("high"),
        F.max_by(at, "ts_ns").alias("last"),
    )
    return picks.select("series_id", "bin", F.explode(F.array_distinct(F.array("first", "low", "high", "last"))).alias("p")).select("series_id", "bin", "p.*")


def m4_extent(norm: DataFrame, n: int) -> DataFrame:
    """``(series_id, bin, ts_ns, value)``: as ``m4`` over the extent of each series' own finite values, of which the last
    bin takes the rest. Series of up to ``4 n`` values are left as they are, in bin 0."""
    values = norm.where(finite(F.col("value"))).select("series_id", "ts_ns", "value")
    extent = values.groupBy("series_id").agg(F.min("ts_ns").alias("_lo"), F.max("ts_ns").alias("_hi"), F.count("*").alias("_n"))
    width = F.greatest(F.lit(1), F.call_function("div", since(F.col("_lo"), F.col("_hi")), F.lit(n)))
    place = F.least(F.lit(n - 1), F.call_function("div", since(F.col("_lo"), F.col("ts_ns")), width))
    own = values.join(extent, "series_id").withColumn("bin", F.when(F.col("_n") <= 4 * n, 0).otherwise(place).cast("long"))
    few = own.where(F.col("_n") <= 4 * n).select("series_id", "bin", "ts_ns", "value")
    return few.unionByName(_extremes(own.where(F.col("_n") > 4 * n)))


def chart(norm: DataFrame, start: int, end: int, n: int, intervals: DataFrame) -> DataFrame:
    """``(series_id, ts_ns, value)``: the extremes of ``n`` bins of ``[start, end)``, with a null where two points are further
    apart than two bins or three intervals of ``intervals (series_id, interval)``."""
    step = F.greatest(F.lit(2 * max(1, (end - start) // n)), 3 * F.coalesce("interval", F.lit(0)))
    return gap_breaks(m4(norm, start, end, n).join(intervals.select("series_id", step.alias("_step")), "series_id"), F.col("_step"))


def compare(norm: DataFrame, start: int, end: int, n: int, intervals: DataFrame) -> DataFrame:
    """The points of `chart` with the figures of each series' good values in the window, by which they can be brought to
    one scale: ``(series_id, ts_ns, value, range01, z, index100)``."""
    own = norm.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end))
    return normalise(chart(norm, start, end, n, intervals), window_stats(own))


def residual_chart(residuals: DataFrame, grid: int, start: int, end: int, n: int, low: float = -0.01, high: float = 0.05) -> DataFrame:
    """``(ts_ns, value, band_low, band_high)``: the extremes of ``residuals (bin, residual, sum_in)`` in ``n`` bins of
    ``[start, end)``, each with the loss band of its own time; all are null between points over two bins or grid steps
    apart."""
    base = F.greatest(F.lit(0.0), F.col("sum_in"))
    rows = residuals.select(F.lit("residual").alias("series_id"), F.greatest(F.col("bin") * grid, F.lit(start)).alias("ts_ns"), F.col("residual").alias("value"), (low * base).alias("band_low"), (high * base).alias("band_high"))
    points = gap_breaks(m4(rows, start, end, n), F.lit(max(2 * max(1, (end - start) // n), 2 * grid)))
    band = rows.select("ts_ns", "band_low", "band_high").dropDuplicates(["ts_ns"])
    return points.join(band, "ts_ns", "left").select("ts_ns", "value", *[F.when(F.col("value").isNotNull(), F.col(c)).alias(c) for c in ("band_low", "band_high")])


def gap_breaks(points: DataFrame, most: Column | int) -> DataFrame:
    """Adds a null value 1 ns after each point that the next one follows by more than ``most``, which may be a column."""
    limit = F.lit(most) if isinstance(most, int) else most
    ahead = neighbour(points.select("series_id", "ts_ns", "value", limit.alias("_most")), "_next", F.col("ts_ns"), after=True)
    broken = (since(F.col("ts_ns"), F.col("_next")) > F.col("_most")) & F.col("value").isNotNull()
    own, extra = F.struct("ts_ns", "value"), F.struct((F.col("ts_ns") + 1).alias("ts_ns"), F.lit(None).cast("double").alias("value"))
    return ahead.select("series_id", F.explode(F.when(broken, F.array(own, extra)).otherwise(F.array(own))).alias("p")).select("series_id", "p.*")


def quality_runs(norm: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """Stretches of the worst quality that is not good (bad, estimated, uncertain), by bin; neighbours
    of one class join unless a good row lies between."""
    rank = F.when(F.col("quality") == BAD, 3).when(F.col("quality") == ESTIMATED, 2).when(F.col("quality") != 0, 1)
    counted = running(bins(norm, start, end, n), "_goods", F.when(F.col("quality") == 0, 1).otherwise(0))
    worst = counted.where("quality <> 0").groupBy("series_id", "bin").agg(F.max(rank).alias("rank"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.min("_goods").alias("g0"), F.max("_goods").alias("g1"))
    w = Window.partitionBy("series_id").orderBy("bin")
    new = F.when((F.lag("rank").over(w) == F.col("rank")) & (F.lag("g1").over(w) == F.col("g0")), 0).otherwise(1)
    grouped = worst.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("series_id", "_run", "rank").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("bins")).drop("_run")


#: A power of two that squares of the largest doubles, times it, stay below the end of.
SMALL = 2.0**-540


def moments(value: Column) -> tuple[Column, Column]:
    """Mean and population deviation that stay finite where sums or squares of values don't: worked out of the values and of
    values made smaller by a power of two, in one pass whose parts merge; the second counts where the first overflows
    (what is lost there is 10^-160 of the largest)."""
    pairs = [(f(value), f(value * SMALL) / SMALL) for f in (F.avg, F.stddev_pop)]
    return tuple(F.when(finite(whole), whole).otherwise(scaled) for whole, scaled in pairs)


def window_stats(norm: DataFrame) -> DataFrame:
    """``(series_id, n, low, high, mean, sd, first, first_ns)`` of the good values of each series; finite at any size of values."""
    good = norm.where(usable(F.col("quality")) & finite(F.col("value")))
    mean, sd = moments(F.col("value"))
    return good.groupBy("series_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), mean.alias("mean"), sd.alias("sd"), F.min_by("value", "ts_ns").alias("first"), F.min("ts_ns").alias("first_ns"))


def normalise(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``range01``, ``z`` and ``index100`` from each series' own figures; null where they refuse (``refusals``)."""
    both = values.join(stats, "series_id")
    over = lambda a, b: F.try_divide(a, F.when(b != 0, b))
    v = F.col("value")
    return both.select("series_id", "ts_ns", "value", over(v - F.col("low"), F.col("high") - F.col("low")).alias("range01"), over(v - F.col("mean"), F.col("sd")).alias("z"), over(v * 100, F.col("first")).alias("index100"))


def refusals(stats: DataFrame) -> DataFrame:
    """``(series_id, mode, reason)``: the scales that a series can't be brought to."""
    flat, zero = F.col("high") == F.col("low"), F.col("first") == 0
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.when(c, r).alias("reason")) for m, c, r in (("range", flat, "constant in the window"), ("z", F.col("sd") == 0, "constant in the window"), ("index", zero, "the first value is zero"))])
    return stats.select("series_id", F.explode(modes).alias("m")).select("series_id", "m.*").where("reason is not null")


def quality_counts(norm: DataFrame, start: int, end: int) -> DataFrame:
    """``(series_id, quality, n)`` of the rows in ``[start, end)``."""
    return norm.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end)).groupBy("series_id", "quality").agg(F.count("*").alias("n"))


def bin_table(norm: DataFrame, start: int, end: int, n: int) -> DataFrame:
    return bins(norm.where(finite(F.col("value"))), start, end, n).groupBy("series_id", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def readout(norm: DataFrame, cursor: Column | int) -> DataFrame:
    """The row of each series nearest to ``cursor``; the earlier on a tie."""
    c = F.lit(cursor) if isinstance(cursor, int) else cursor
    return norm.where(finite(F.col("value"))).groupBy("series_id").agg(F.min_by(F.struct("ts_ns", "value"), F.struct(F.abs(F.col("ts_ns") - c).alias("d"), F.col("ts_ns").alias("t"))).alias("p")).select("series_id", "p.*")
