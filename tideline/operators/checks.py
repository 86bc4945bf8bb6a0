"""The single-series checks. Each takes normalised rows (unless it says otherwise) and returns findings
or the figures that they rest on, for all series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.meaning import BAD, ESTIMATED, UNCERTAIN, finite, usable
from tideline.functions.times import DAY, END_OF_TIME, HOUR, MIN, SEC, plus, since
from tideline.operators.normalize import descents, duplicate_counts, good_values, segments, steps
from tideline.operators.ranks import counted, group_medians, mad_counted, median_mad, nearest_rank, pick, rank_counted, within
from tideline.operators.sequence import merged, neighbour, runs
from tideline.operators.tables import written

#: Fixed value: what the ids of checks begin with.
PREFIX = "tby."
#: From a median absolute deviation to a standard deviation.
SIGMA = 1.4826


def windows(norm: DataFrame) -> DataFrame:
    """``(series_id, w_start, w_end, n)``: the extent of each series."""
    return norm.groupBy("series_id").agg(F.min("ts_ns").alias("w_start"), plus(F.max("ts_ns"), 1).alias("w_end"), F.count("*").alias("n"))


def overlap(start: Column, end: Column) -> Column:
    """The share of the window that a span covers."""
    inside = since(F.greatest(start, F.col("w_start")), F.least(end, F.col("w_end")))
    return F.greatest(F.lit(0), inside) / F.greatest(F.lit(1), since(F.col("w_start"), F.col("w_end")))


def run_windows(norm: DataFrame, flag: Column, interval: int, least: Column | None = None) -> DataFrame:
    """Runs of flagged rows as ``[start_ns, end_ns)``: to the next row's time, or ``interval`` past the last; ``n`` and
    ``least``, if that is given."""
    found = runs(norm, flag, least=least)
    end = F.coalesce("next_ts", plus(F.col("last_ts"), max(interval, 1)))
    return found.withColumn("start_ns", F.col("first_ts")).withColumn("end_ns", F.greatest(end, plus(F.col("first_ts"), 1))).drop("next_ts", "first_ts", "last_ts")


def finding(df: DataFrame, check: str, dimension: str, severity: str, affected: Column, evidence: Sequence[str]) -> DataFrame:
    """The common columns of findings; evidence keeps null fields, as its keys tell findings apart."""
    told = F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"})
    return df.select(F.lit(PREFIX + check).alias("check_id"), "series_id", F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), "start_ns", "end_ns", F.greatest(F.lit(0.0), F.least(F.lit(1.0), affected.cast("double"))).alias("affected"), told.alias("evidence"))


def gaps(norm: DataFrame, interval: int, factor: float = 3, least: int = 5 * MIN, most: int = 200) -> DataFrame:
    """Spans without a good value longer than ``factor`` intervals, the window's ends included; the
    first ``most`` of a series are reported."""
    ends = windows(norm)
    points = good_values(norm).select("series_id", "ts_ns").unionByName(ends.select("series_id", F.col("w_start").alias("ts_ns"))).unionByName(ends.select("series_id", F.col("w_end").alias("ts_ns"))).distinct()
    limit = max(int(interval * factor), least)
    found = neighbour(points, "start_ns", F.col("ts_ns")).where(since(F.col("start_ns"), F.col("ts_ns")) > limit).select("series_id", "start_ns", F.col("ts_ns").alias("end_ns"))
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("series_id").orderBy("start_ns"))).where(F.col("_k") <= most).drop("_k")


def completeness(norm: DataFrame, interval: int) -> DataFrame:
    """``(series_id, present, expected, completeness)``."""
    good = good_values(norm).groupBy("series_id").agg(F.count("*").alias("present"))
    out = windows(norm).join(good, "series_id", "left").withColumn("present", F.coalesce("present", F.lit(0)))
    out = out.withColumn("expected", F.greatest(F.lit(1), F.floor(since(F.col("w_start"), F.col("w_end")) / interval + 0.5)))
    return out.select("series_id", "present", "expected", F.least(F.lit(1.0), F.col("present") / F.col("expected")).alias("completeness"))


def completeness_findings(norm: DataFrame, interval: int) -> DataFrame:
    found = gaps(norm, interval).join(windows(norm), "series_id").withColumn("gap_duration_ns", F.col("end_ns") - F.col("start_ns"))
    found = found.withColumn("gap_start", F.col("start_ns")).withColumn("gap_end", F.col("end_ns")).withColumn("expected_interval_ns", F.lit(interval)).withColumn("gap_threshold_ns", F.lit(max(3 * interval, 5 * MIN)))
    return finding(found, "completeness", "completeness", "high", F.col("gap_duration_ns") / (F.col("w_end") - F.col("w_start")), ["gap_start", "gap_end", "gap_duration_ns", "expected_interval_ns", "gap_threshold_ns"])


def staleness(obs: DataFrame, now: int, interval: int) -> DataFrame:
    """``(series_id, age_ns, stale)`` of rows as delivered."""
    newest = obs.groupBy("series_id").agg(F.max(F.when(usable(F.col("quality")) & finite(F.col("value")), F.col("ts_ns"))).alias("newest"), F.min("ts_ns").alias("w_start"))
    age = F.coalesce(F.lit(now) - F.col("newest"), F.lit(now) - F.col("w_start"))
    return newest.select("series_id", "newest", age.alias("age_ns"), (age > max(3 * interval, 5 * MIN)).alias("stale"))


def latency(obs: DataFrame, sla: int, ahead: int = 60 * SEC) -> DataFrame:
    """``(series_id, p50_ns, p95_ns, late, future)`` of rows that have an arrival time, as delivered."""
    lat = obs.where("ingest_ns is not null").withColumn("lat", F.col("ingest_ns") - F.col("ts_ns"))
    mid = nearest_rank(lat, [0.5], "lat", half=0.0).select("series_id", F.col("v").alias("p50_ns"))
    high = nearest_rank(lat, [0.95], "lat").select("series_id", F.col("v").alias("p95_ns"))
    counts = lat.groupBy("series_id").agg(F.count_if(F.col("lat") > sla).alias("late"), F.count_if(F.col("lat") < -ahead).alias("future"))
    return mid.join(high, "series_id").join(counts, "series_id")


def timestamp_integrity(obs: DataFrame) -> DataFrame:
    """``(series_id, out_of_order, exact, conflicting)`` of rows as delivered; repeats conflict by their values alone."""
    return descents(obs).join(duplicate_counts(obs), "series_id")


def regularity(norm: DataFrame, interval: int, tolerance: float = 0.1) -> DataFrame:
    """``(series_id, steps, regular)``: steps up to three intervals, and those within the tolerance."""
    found = steps(norm).where((F.col("step") > 0) & (F.col("step") <= 3 * interval))
    return found.groupBy("series_id").agg(F.count("*").alias("steps"), F.count_if(F.abs(F.col("step") - interval) <= tolerance * interval).alias("regular"))


def quality_flags(norm: DataFrame, interval: int, limits: dict[int, float] | None = None) -> DataFrame:
    """Runs of each class of quality whose share of the series is over its limit."""
    out = None
    for code, limit in (limits or {BAD: 0.01, UNCERTAIN: 0.05, ESTIMATED: 0.10}).items():
        share = norm.groupBy("series_id").agg((F.count_if(F.col("quality") == code) / F.count("*")).alias("share")).where(F.col("share") > limit)
        part = run_windows(norm, F.col("quality") == code, interval).join(share, "series_id").withColumn("quality", F.lit(code))
        out = part if out is None else out.unionByName(part)
    return out


def value_type(norm: DataFrame, interval: int, most: float = 0.01) -> DataFrame:
    """Runs of infinite values, and of missing ones if their share is over ``most``."""
    endless = F.abs("value") == float("inf")
    lost = F.col("value").isNull() | F.isnan("value")
    share = norm.groupBy("series_id").agg((F.count_if(lost) / F.count("*")).alias("share")).where(F.col("share") > most)
    return run_windows(norm, endless, interval).withColumn("kind", F.lit("inf")).unionByName(run_windows(norm, lost, interval).join(share.select("series_id"), "series_id").withColumn("kind", F.lit("nan")))


def frozen(norm: DataFrame, atol: float, least: int = 10, fraction: float = 0.99) -> DataFrame:
    """Series of which nearly all good values are within ``atol`` of the first."""
    good = good_values(norm)
    anchor = good.groupBy("series_id").agg(F.min_by("value", "ts_ns").alias("first"))
    found = good.join(anchor, "series_id").groupBy("series_id").agg(F.count("*").alias("usable"), F.count_if(F.abs(F.col("value") - F.col("first")) <= atol).alias("same"))
    return found.withColumn("frozen", (F.col("usable") >= least) & (F.col("same") >= fraction * F.col("usable")))


def _outside(low: float | None, high: float | None) -> Column:
    out = F.lit(False)
    if low is not None:
        out |= F.col("value") < low
    if high is not None:
        out |= F.col("value") > high
    return finite(F.col("value")) & out


def physical_range(norm: DataFrame, low: float | None, high: float | None, interval: int) -> DataFrame:
    """Excursions beyond the limits; those closer than max(1 h, 12 intervals) are one episode."""
    found = run_windows(norm, _outside(low, high), interval)
    return merged(found.select("series_id", "start_ns", "end_ns"), ["series_id"], gap=max(HOUR, 12 * interval), inclusive=False)


def band(norm: DataFrame, k: float = 1.0) -> DataFrame:
    """``(series_id, low, high)``: the 0.1 and 99.9 % ranks, widened by ``k`` deviations."""
    counts = written(counted(norm.where(finite(F.col("value")))), "counted")
    q = rank_counted(counts, [0.001, 0.999]).groupBy("series_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return q.join(mad_counted(counts), "series_id").select("series_id", (F.col("lo") - k * SIGMA * F.col("mad")).alias("low"), (F.col("hi") + k * SIGMA * F.col("mad")).alias("high"))


def operational_range(norm: DataFrame, limits: DataFrame, interval: int, most: float = 0.005) -> DataFrame:
    """Runs outside ``limits (series_id, low, high)`` of series with over ``most`` such values."""
    placed = norm.join(limits, "series_id").withColumn("_out", finite(F.col("value")) & ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))))
    share = placed.groupBy("series_id").agg(F.avg(F.col("_out").cast("int")).alias("share"), F.count("*").alias("rows")).where(f"share > {most} and rows >= 20")
    return run_windows(placed, F.col("_out"), interval).join(share.select("series_id"), "series_id")


def negative(norm: DataFrame, interval: int, tolerance: float = 0.0) -> DataFrame:
    return run_windows(norm, finite(F.col("value")) & (F.col("value") < -tolerance), interval, F.col("value"))


def segment_values(norm: DataFrame, width: int) -> DataFrame:
    """Good values with ``segment``, the number of their stretch of ``width``."""
    return segments(norm, width).where(usable(F.col("quality")) & finite(F.col("value")))


def segment_medians(norm: DataFrame, width: int, least: int = 1) -> DataFrame:
    """``(series_id, segment, n, med, mad, start_ns, end_ns)`` of the good values of each stretch of ``width``."""
    return group_medians(segment_values(norm, width), ["series_id", "segment"], F.min("ts_ns").alias("start_ns"), plus(F.max("ts_ns"), 1).alias("end_ns")).where(F.col("n") >= least)


def bucket_medians(norm: DataFrame, width: int, most: int = 2000) -> DataFrame:
    """``(series_id, bucket, med)``: medians of good values by stretches of ``width``, or of as many of these as it takes
    for a series to have at most ``most``; ``bucket`` is the number of a stretch's first ``width``."""
    good = segments(norm, width).where(usable(F.col("quality")) & finite(F.col("value")))
    span = F.max("segment") - F.min("segment") + 1
    times = F.when(span <= most, F.lit(1)).otherwise(F.ceil(span / (most - 1))).cast("long")
    wide = good.join(good.groupBy("series_id").agg(times.alias("times")), "series_id").withColumn("bucket", F.col("segment") - F.pmod("segment", "times"))
    return group_medians(wide, ["series_id", "bucket"], deviation=False).drop("n")


#: Factors by which units are mixed up.
FACTORS = (10.0, 100.0, 1000.0, 0.1, 0.01, 0.001)


def scale_shift(norm: DataFrame, width: int = DAY, least: int = 30, tolerance: float = 0.1, base: DataFrame | None = None) -> DataFrame:
    """``(series_id, segment, start_ns, end_ns, med, mad, ratio, bmed, bmad, factor, candidate)``: segments whose median and
    spread are both a power of ten of the whole series', or else those of Fahrenheit for Celsius or the reverse (which
    goes first if both fit). ``base (series_id, bmed, bmad)`` may give what they are held against."""
    seg = segment_medians(norm, width, least).drop("n")
    own = median_mad(good_values(norm)).select("series_id", F.col("median").alias("bmed"), F.col("mad").alias("bmad")) if base is None else base
    both = seg.join(own.where("bmad > 0 and abs(bmed) > 1e-12"), "series_id").withColumn("ratio", F.col("med") / F.col("bmed")).withColumn("spread", F.col("mad") / F.col("bmad"))
    near = lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(1.0)) <= tolerance
    factor, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    degrees = (("C to F", 1.8 * F.col("bmed") + 32, 1.8), ("F to C", (F.col("bmed") - 32) / 1.8, 1 / 1.8))
    for label, want, f in degrees:
        fits = near(F.col("med"), want) & (F.abs(F.col("spread") / f - 1) <= 0.25)
        factor, name = F.when(fits, f).otherwise(factor), F.when(fits, label).otherwise(name)
    for f in reversed(FACTORS):
        fits = (F.abs(F.col("ratio") / f - 1) <= tolerance) & (F.abs(F.col("spread") / f - 1) <= 0.5)
        factor, name = F.when(fits, f).otherwise(factor), F.when(fits, f"x{f:g}").otherwise(name)
    return both.withColumn("factor", factor).withColumn("candidate", name).where("factor is not null").drop("spread")


def rates(norm: DataFrame, interval: int) -> DataFrame:
    """``(…, diff, dt, rate)`` of each two neighbours with finite values up to three intervals apart."""
    both = neighbour(norm.withColumn("_at", F.struct("ts_ns", "value")), "before", F.col("_at")).drop("_at")
    both = both.withColumn("dt", F.try_subtract(F.col("ts_ns"), F.col("before.ts_ns"))).withColumn("diff", F.col("value") - F.col("before.value"))
    ok = (F.col("dt") > 0) & (F.col("dt") <= 3 * interval) & finite(F.col("value")) & finite(F.col("before.value"))
    return both.where(ok).withColumn("rate", F.abs("diff") / (F.col("dt") / SEC)).drop("before")


def noise(norm: DataFrame, interval: int) -> DataFrame:
    """``(series_id, sigma, rate_p999)``: noise from signed differences, and the usual largest slope. Both figures'
    values are counted in one table, which is written, and ranked in one pass."""
    figure = lambda name, v: F.struct(F.lit(name).alias("what"), F.col(v).alias("x"))
    long = rates(norm, interval).select("series_id", F.explode(F.array(figure("diff", "diff"), figure("rate", "rate"))).alias("f")).select("series_id", "f.*")
    counts = written(counted(long, "x", ["series_id", "what"]), "rates")
    ranked = rank_counted(counts, [0.5, 0.999], ["series_id", "what"])
    at = lambda what, q: F.max(F.when((F.col("what") == what) & (F.col("q") == q), F.col("v")))
    own = ranked.groupBy("series_id").agg(at("diff", 0.5).alias("median"), at("rate", 0.999).alias("rate_p999"))
    off = counts.where("what = 'diff'").join(own, "series_id").select("series_id", F.abs(F.col("v") - F.col("median")).alias("v"), "c", "rate_p999")
    mad = rank_counted(off, [0.5], ["series_id", "rate_p999"])
    return mad.select("series_id", (F.col("v") * SIGMA / F.sqrt(F.lit(2.0))).alias("sigma"), "rate_p999")


def rate_of_change(norm: DataFrame, interval: int, factor: float = 3.0) -> DataFrame:
    """Steps steeper than ``factor`` times the usual largest slope."""
    r = rates(norm, interval)
    usual = nearest_rank(r, [0.999], "rate").select("series_id", (F.col("v") * factor).alias("limit"))
    return r.join(usual, "series_id").where("rate > limit").select("series_id", (F.col("ts_ns") - F.col("dt")).alias("start_ns"), F.col("ts_ns").alias("end_ns"), "rate", "limit")


def noise_segments(norm: DataFrame, interval: int, width: int = DAY) -> DataFrame:
    """``(series_id, segment, sigma, ratio)``: each segment's noise and its ratio to the series'."""
    own = group_medians(segments(rates(norm.where(usable(F.col("quality"))), interval), width), ["series_id", "segment"], value="diff").select("series_id", "segment", (F.col("mad") * SIGMA / F.sqrt(F.lit(2.0))).alias("sigma"))
    return own.join(noise(norm, interval).select("series_id", F.col("sigma").alias("base")), "series_id").select("series_id", "segment", "sigma", F.try_divide("sigma", "base").alias("ratio"))


def resolution(norm: DataFrame) -> DataFrame:
    """``(series_id, resolution)``: the least change between neighbouring finite values."""
    near = neighbour(norm.where(finite(F.col("value"))), "before", F.col("value")).withColumn("d", F.abs(F.col("value") - F.col("before")))
    return near.groupBy("series_id").agg(F.min(F.when(F.col("d") > 0, F.col("d"))).alias("resolution"))


def density(norm: DataFrame, width: int = DAY, least: int = 50) -> DataFrame:
    """``(series_id, segment, n, distinct, density, base)``: distinct values for each value, and the series'."""
    values = segments(norm.where(finite(F.col("value"))), width)
    seg = values.groupBy("series_id", "segment").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct")).where(F.col("n") >= least)
    base = values.groupBy("series_id").agg((F.count_distinct("value") / F.count("*")).alias("base"))
    return seg.join(base, "series_id").withColumn("density", F.col("distinct") / F.col("n"))


def level_drift(norm: DataFrame, width: int = DAY, least: int = 10, segments_least: int = 7, most: int = 400) -> DataFrame:
    """``(series_id, slope_per_day, segments, segment_ns)``: the median of the slopes of all pairs of segment medians (at their first rows);
    segments are widened so that a series has at most ``most``."""
    extent = windows(norm).select("series_id", F.greatest(F.lit(width), F.ceil(since(F.col("w_start"), F.col("w_end")) / most)).alias("width"), "w_start")
    good = good_values(norm).join(extent, "series_id").withColumn("segment", F.call_function("div", since(F.col("w_start"), F.col("ts_ns")), F.col("width")))
    seg = group_medians(good, ["series_id", "segment"], (since(F.first("w_start"), F.min("ts_ns")) / DAY).alias("day"), F.first("width").alias("segment_ns"), deviation=False).where(F.col("n") >= least).select("series_id", "segment_ns", F.struct("day", "med").alias("p"))
    points = seg.groupBy("series_id", "segment_ns").agg(F.array_sort(F.collect_list("p")).alias("p")).where(F.size("p") >= segments_least)
    slopes = F.flatten(F.transform("p", lambda a, i: F.transform(F.filter("p", lambda b: b["day"] > a["day"]), lambda b: (b["med"] - a["med"]) / (b["day"] - a["day"]))))
    return points.select("series_id", pick(slopes, 0.5).alias("slope_per_day"), F.size("p").alias("segments"), "segment_ns")


def distribution_drift(norm: DataFrame, width: int = DAY, least: int = 100, base: DataFrame | None = None) -> DataFrame:
    """``(series_id, segment, start_ns, end_ns, psi, wasserstein)`` against ``base (series_id, g, spread)``: each 5 % rank and
    the spread that distances are told in; by default those of the good values and the distance of their quartiles.
    ``psi`` is null where deciles are equal."""
    if base is None:
        base = _grid(norm).withColumn("spread", F.get("g", F.lit(15)) - F.get("g", F.lit(5)))
    key = ["series_id", "segment"]
    values = within(segment_values(norm, width), key, [i / 20 for i in range(21)]).where(F.col("_n") >= least).join(base, "series_id")
    edges = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.get("g", 2 * i))
    part = F.size(F.filter("edges", lambda e: e < F.col("value")))
    tens = F.array(*[F.greatest(F.lit(1e-4), F.count_if(F.col("part") == i) / F.count("*")) for i in range(10)])
    seg = values.withColumn("edges", edges).withColumn("part", part).groupBy(*key).agg(F.min("ts_ns").alias("start_ns"), plus(F.max("ts_ns"), 1).alias("end_ns"), tens.alias("shares"), *[F.first(c).alias(c) for c in ("g", "spread", "edges", "_ranked")])
    psi = F.aggregate("shares", F.lit(0.0), lambda a, p: a + (p - 0.1) * F.log(p / 0.1))
    far = F.aggregate(F.zip_with("g", "_ranked", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, d: a + d) / 21
    return seg.select(*key, "start_ns", "end_ns", F.when(F.size(F.array_distinct("edges")) == 9, psi).alias("psi"), F.try_divide(far, F.col("spread")).alias("wasserstein"))


def _grid(norm: DataFrame) -> DataFrame:
    """``(series_id, g)``: each 5 % rank of the good values."""
    good = good_values(norm)
    return nearest_rank(good, [i / 20 for i in range(21)]).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("q", "v"))).alias("g")).select("series_id", F.transform("g", lambda x: x["v"]).alias("g"))


def constant_fraction(norm: DataFrame, least: int = 10) -> DataFrame:
    """``(series_id, fraction)``: the share of rows in runs of ``least`` or more equal finite values."""
    near = neighbour(norm, "before", F.col("value"))
    found = runs(near, finite(F.col("value")) & (F.col("value") == F.col("before")))
    held = found.where(F.col("n") + 1 >= least).groupBy("series_id").agg(F.sum(F.col("n") + 1).alias("held"))
    return norm.groupBy("series_id").agg(F.count("*").alias("rows")).join(held, "series_id", "left").select("series_id", (F.coalesce("held", F.lit(0)) / F.col("rows")).alias("fraction"))
