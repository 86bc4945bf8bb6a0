"""Baselines: profiles of a recent, trusted stretch of each series, kept in versions, which later runs are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.meaning import BAD, finite
from tideline.functions.times import DAY, plus
from tideline.operators import profiles
from tideline.operators.lifecycle import keep_versions
from tideline.operators.profiles import BASIS
from tideline.operators.tables import written

#: What a baseline keeps of a profile.
KEPT = (*BASIS, "lowest", "highest", "iat_p50", "iat_p99", *profiles.SHARES)
#: The longest window in days, the least rows that a baseline is fitted on, the versions kept of a series.
WINDOW_DAYS, LEAST_ROWS, VERSIONS = 28, 50, 30


def fit_window(cover: DataFrame, max_rows: int, days: int = WINDOW_DAYS) -> DataFrame:
    """``(series_id, from_ns, to_ns, est_rows)`` of coverage ``(series_id, range_start, range_end, n_rows)``: the last ``days`` of what is
    covered, halved (whole days, one at least) until at most ``max_rows`` are expected, as each range's rows are spread
    evenly. Where not even a day fits, ``from_ns`` is null. All widths are worked out in one pass."""
    widths = [days >> k for k in range(days.bit_length()) if days >> k]
    extent = cover.groupBy("series_id").agg(F.min("range_start").alias("_lo"), F.max("range_end").alias("to_ns"))
    tried = cover.join(extent, "series_id").select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("_days")).withColumn("from_ns", F.greatest("_lo", F.try_subtract(F.col("to_ns"), F.col("_days") * F.lit(DAY))))
    inside = F.greatest(F.lit(0), F.col("range_end") - F.greatest("range_start", "from_ns"))
    share = inside / F.greatest(F.lit(1), F.col("range_end") - F.col("range_start"))
    sized = tried.groupBy("series_id", "to_ns", "_days", "from_ns").agg(F.ceil(F.sum(F.col("n_rows") * share)).alias("est_rows"))
    fits = F.col("est_rows") <= max_rows
    best = F.max_by(F.when(fits, F.struct("from_ns", "est_rows")), F.when(fits, F.col("_days")))
    return sized.groupBy("series_id", "to_ns").agg(best.alias("x")).select("series_id", "x.from_ns", "to_ns", "x.est_rows")


def trusted(rows: DataFrame, findings: DataFrame, width: int = DAY) -> DataFrame:
    """Adds ``taken``: null for rows to learn from, else why not: ``bad`` quality, no ``number``, or inside an open critical ``finding``
    (checked in this order). Windows of findings are dealt to the days that they touch, so the range join is an equi-join; an
    empty one takes the row at its time."""
    open_ = findings.where("severity = 'critical' and status = 'open'").select("series_id", F.col("start_ns").alias("_s"), F.greatest("end_ns", plus(F.col("start_ns"), 1)).alias("_e"))
    days = open_.select("*", F.explode(F.sequence(F.expr(f"_s div {width} - 1"), F.expr(f"_e div {width} + 1"))).alias("_day")).distinct()
    times = rows.select("series_id", "ts_ns", F.expr(f"ts_ns div {width}").alias("_day")).join(days, ["series_id", "_day"]).where("ts_ns >= _s and ts_ns < _e").select("series_id", "ts_ns", F.lit(True).alias("_hit")).distinct()
    why = F.when(F.col("quality") == BAD, "bad").when(~F.coalesce(finite(F.col("value")), F.lit(False)), "number").when(F.col("_hit"), "finding")
    return rows.join(times, ["series_id", "ts_ns"], "left").withColumn("taken", why).drop("_hit")


def fit(norm: DataFrame, cover: DataFrame, findings: DataFrame, max_rows: int, least: int = LEAST_ROWS, meta: DataFrame | None = None) -> DataFrame:
    """``(series_id, status, from_ns, to_ns, n_samples, excluded, profile)`` for each covered series: the profile (a struct of ``KEPT``)
    of the rows to learn from in its window. ``status`` is ``fitted``, or why not: ``no_data`` (no rows in the window), ``too_large``
    (no window fits, or it holds more than was expected and too much), ``too_few`` (under ``least`` to learn from).
    ``excluded`` counts rows of bad quality and rows in critical findings, and lists these windows."""
    windows = written(fit_window(cover, max_rows), "windows")
    bounds = windows.where("from_ns is not null")
    rows = written(trusted(norm.join(bounds.select("series_id", "from_ns", "to_ns"), "series_id").where("ts_ns >= from_ns and ts_ns < to_ns"), findings), "trusted")
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("taken").isNull()).alias("n_samples"), F.count_if(F.col("taken") == "bad").alias("bad"), F.count_if(F.col("taken") == "finding").alias("in_findings"))
    touched = findings.where("severity = 'critical' and status = 'open'").select("series_id", "start_ns", F.greatest("end_ns", plus(F.col("start_ns"), 1)).alias("end_ns")).join(bounds, "series_id").where("start_ns < to_ns and end_ns > from_ns")
    touched = touched.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("start_ns", "end_ns"))).alias("windows"))
    status = F.when(F.col("from_ns").isNull(), "too_large").when(F.col("n_rows").isNull(), "no_data").when(F.col("n_rows") > max_rows, "too_large").when(F.col("n_samples") < least, "too_few").otherwise("fitted")
    judged = written(windows.join(sizes, "series_id", "left").join(touched, "series_id", "left").withColumn("status", status), "judged")
    near = written(profiles.beside(rows.where("taken is null").drop("taken", "from_ns", "to_ns").join(judged.where("status = 'fitted'").select("series_id"), "series_id")), "learned")
    kept = profiles.profile(near, meta).select("series_id", F.struct(*KEPT).alias("profile"))
    none = F.array().cast("array<struct<start_ns:bigint,end_ns:bigint>>")
    excluded = F.struct(F.col("bad"), F.col("in_findings").alias("findings"), F.coalesce("windows", none).alias("windows"))
    return judged.join(kept, "series_id", "left").select("series_id", "status", "from_ns", "to_ns", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.when(F.col("status") == "fitted", excluded).alias("excluded"), "profile")


def current(baselines: DataFrame) -> DataFrame:
    """The newest version of each series."""
    newest = F.max_by(F.struct(*[c for c in baselines.columns if c != "series_id"]), "version")
    return baselines.groupBy("series_id").agg(newest.alias("x")).select("series_id", "x.*")


def store(baselines: DataFrame | None, fitted: DataFrame, now: int, keep: int = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """``(baselines, outcome)`` after ``fitted`` (as of `fit`): a series gets a new version only if its profile, window or exclusions
    changed; the last ``keep`` versions stay. ``outcome (series_id, status, version)`` has ``stored``, ``unchanged`` or why a series
    was not fitted. ``baselines (series_id, version, from_ns, to_ns, n_samples, excluded, profile, at_ns)`` may be None at first. A
    result that is folded in again changes nothing."""
    columns = ["from_ns", "to_ns", "n_samples", "excluded", "profile"]
    good = fitted.where("status = 'fitted'")
    if baselines is None:
        baselines = good.select("series_id", F.lit(0).cast("long").alias("version"), *columns, F.lit(now).cast("long").alias("at_ns")).where("false")
    was = current(baselines).select("series_id", F.col("version").alias("_version"), *[F.col(c).alias(f"_{c}") for c in columns if c != "n_samples"])
    same = F.col("_version").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}")) if c != "n_samples" else same
    told = fitted.join(was, "series_id", "left").withColumn("_same", (F.col("status") == "fitted") & same)
    told = told.withColumn("version", F.when((F.col("status") == "fitted") & ~F.col("_same"), F.coalesce("_version", F.lit(0)) + 1).otherwise(F.col("_version")))
    told = told.withColumn("status", F.when(F.col("_same"), "unchanged").when(F.col("status") == "fitted", "stored").otherwise(F.col("status")))
    new = told.where("status = 'stored'").select("series_id", F.col("version").cast("long"), *columns, F.lit(now).cast("long").alias("at_ns"))
    return keep_versions(baselines.unionByName(new), keep), told.select("series_id", "status", F.col("version").cast("long").alias("version"))


def profiles_of(baselines: DataFrame) -> DataFrame:
    """Current profiles by series, as `registry.run_checks` takes them."""
    return current(baselines).select("series_id", "profile.*")


def due(series: DataFrame, cover: DataFrame, now: int, age: int = DAY, most: int = 200) -> DataFrame:
    """The ``most`` of ``series (series_id, baseline_at)`` with coverage whose last baseline is older than ``age`` or missing: those
    without one first, then the oldest."""
    old = F.col("baseline_at").isNull() | (F.col("baseline_at") < now - age)
    ready = series.where(old).join(cover.select("series_id").distinct(), "series_id", "left_semi")
    return ready.orderBy(F.col("baseline_at").asc_nulls_first(), "series_id").limit(most)
