"""One profile for each series: what its checks hold it against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.meaning import finite
from tideline.functions.times import HOUR, SEC, plus
from tideline.operators import seasonal
from tideline.operators.checks import SIGMA, constant_fraction, resolution
from tideline.operators.kernels import modal
from tideline.operators.ranks import counted, rank_counted
from tideline.operators.sequence import neighbour
from tideline.operators.tables import written

#: What may be known of a series beforehand; all but the id may be null.
META = "series_id string, unit string, kind string, interval_ns long, low double, high double, op_low double, op_high double, non_negative boolean, own_resolution double, sla_ns long, max_rate double"
SHARES = ("good", "uncertain", "bad", "estimated")
#: Figures that checks hold a series against: those of its baseline, if it has one.
BASIS = ("n_finite", "distinct_values", "quantiles", "q001", "q999", "median", "mad", "resolution", "constant_fraction", "interval", "rate_p999", "noise_sigma")


def beside(norm: DataFrame) -> DataFrame:
    """Adds ``prev_ts`` and ``prev_value``, those of the row before in the series."""
    return neighbour(norm.withColumn("_at", F.struct("ts_ns", "value")), "_prev", F.col("_at")).withColumn("prev_ts", F.col("_prev.ts_ns")).withColumn("prev_value", F.col("_prev.value")).drop("_at", "_prev")


def paired(interval: Column) -> Column:
    """Whether a row and the one before are up to three intervals apart and both finite."""
    dt = F.try_subtract("ts_ns", "prev_ts")
    return F.coalesce((dt > 0) & (dt <= 3 * interval) & finite(F.col("value")) & finite(F.col("prev_value")), F.lit(False))


def profile(near: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row for each series of ``near`` (as of ``beside``, best a written table; it is read four times): extent
    (``w_start``, ``w_end``, ``n``), figures of its finite values (``n_finite``, ``lowest``, ``highest``,
    ``distinct_values``, ``quantiles`` at each 5 %, ``q001``, ``q999``, ``median``, ``mad``, ``resolution``), shares of
    each quality, ``constant_fraction``, steps (``iat_p50``, ``iat_p99``, ``interval``: the known one, else the modal
    one, else the median), ``rate_p999``, ``noise_sigma``, and the columns of ``META``."""
    value = F.col("value")
    shares = [F.avg((F.col("quality") == i).cast("int")).alias(c) for i, c in enumerate(SHARES)]
    ok = finite(value)
    extent = near.groupBy("series_id").agg(F.min("ts_ns").alias("w_start"), plus(F.max("ts_ns"), 1).alias("w_end"), F.count("*").alias("n"), F.count_if(ok).alias("n_finite"), F.min(F.when(ok, value)).alias("lowest"), F.max(F.when(ok, value)).alias("highest"), *shares)

    steps = written(counted(near.withColumn("step", F.try_subtract("ts_ns", "prev_ts")), "step"), "steps")
    ranked = rank_counted(steps, [0.5, 0.99])
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("v")))
    iat = ranked.groupBy("series_id").agg(at(0.5).alias("iat_p50"), at(0.99).alias("iat_p99")).join(modal(steps.where("v > 0"), ["series_id"]), "series_id", "left")
    known = near.sparkSession.createDataFrame([], META) if meta is None else meta
    base = extent.join(iat, "series_id", "left").join(known, "series_id", "left")
    base = written(base.withColumn("interval", F.greatest(F.lit(1), F.coalesce("interval_ns", "modal_ns", "iat_p50", F.lit(1)).cast("long"))).drop("modal_ns"), "extents")

    diff = F.col("value") - F.col("prev_value")
    figure = lambda name, v: F.struct(F.lit(name).alias("what"), v.alias("x"))
    pair = paired(F.col("interval"))
    rate = F.abs(diff) / (F.try_subtract("ts_ns", "prev_ts") / SEC)
    found = F.array(figure("value", F.when(ok, value)), figure("diff", F.when(pair, diff)), figure("rate", F.when(pair, rate)))
    long = near.join(base.select("series_id", "interval"), "series_id").select("series_id", F.explode(found).alias("f")).select("series_id", "f.*")
    counts = written(counted(long, "x", ["series_id", "what"]), "figures")
    fine = rank_counted(counts, [i / 20 for i in range(21)] + [0.001, 0.999], ["series_id", "what"])
    of = lambda what, q: F.max(F.when((F.col("what") == what) & (F.col("q") == q), F.col("v")))
    grid = F.array_sort(F.collect_list(F.when((F.col("what") == "value") & ~F.col("q").isin(0.001, 0.999), F.struct("q", "v"))))
    quantiles = fine.groupBy("series_id").agg(F.transform(grid, lambda x: x["v"]).alias("quantiles"), of("value", 0.001).alias("q001"), of("value", 0.999).alias("q999"), of("value", 0.5).alias("median"), of("diff", 0.5).alias("mid_diff"), of("rate", 0.999).alias("rate_p999"))
    quantiles = written(quantiles, "quantiles")
    middle = F.when(F.col("what") == "value", F.col("median")).otherwise(F.col("mid_diff"))
    off = counts.where("what <> 'rate'").join(quantiles.select("series_id", "median", "mid_diff"), "series_id").select("series_id", "what", F.abs(F.col("v") - middle).alias("v"), "c")
    mads = rank_counted(off, [0.5], ["series_id", "what"]).groupBy("series_id").agg(F.max(F.when(F.col("what") == "value", F.col("v"))).alias("mad"), F.max(F.when(F.col("what") == "diff", F.col("v") * SIGMA / F.sqrt(F.lit(2.0)))).alias("noise_sigma"))
    distinct = counts.where("what = 'value'").groupBy("series_id").agg(F.count("*").alias("distinct_values"))
    out = base.join(quantiles.drop("mid_diff"), "series_id", "left").join(mads, "series_id", "left").join(distinct, "series_id", "left")
    out = out.join(resolution(near), "series_id", "left").join(constant_fraction(near).withColumnRenamed("fraction", "constant_fraction"), "series_id", "left")
    return out.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))


def basis(prof: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``(series_id, baseline, <BASIS>)``: what each profiled series is held against. ``baseline`` is ``baseline`` where ``given`` has a
    profile of the series, whose empty figures stay empty, else ``self``."""
    own = prof.select("series_id", F.struct(*BASIS).alias("own"))
    if given is None:
        return own.select("series_id", F.lit("self").alias("baseline"), "own.*")
    both = own.join(given.select("series_id", F.struct(*BASIS).alias("given")), "series_id", "left")
    return both.select("series_id", F.when(F.col("given").isNull(), "self").otherwise("baseline").alias("baseline"), F.coalesce("given", "own").alias("x")).select("series_id", "baseline", "x.*")


def with_period(prof: DataFrame, near: DataFrame, step: int = HOUR) -> DataFrame:
    """Profiles with ``dominant_period_ns`` and ``seasonal_strength``, null for series without a period: found in means of bins of ``step``, or of
    their interval for series of a longer one (a pass for each of these intervals)."""
    wide = prof.select("series_id", F.greatest(F.lit(step), F.col("interval")).alias("_step"))
    found = None
    for (own,) in wide.select("_step").distinct().orderBy("_step").collect():  # one for each interval over ``step``
        spine = written(seasonal.regularise(near.join(wide.where(F.col("_step") == own).select("series_id"), "series_id"), own), "spine")
        part = seasonal.dominant(spine, own)
        found = part if found is None else found.unionByName(part)
    return prof.withColumn("dominant_period_ns", F.lit(None).cast("long")).withColumn("seasonal_strength", F.lit(None).cast("double")) if found is None else prof.join(found, "series_id", "left")
