"""How sources fare over their fetches, how findings fare against labels, and lists of findings by check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.meaning import SEVERITY
from tideline.functions.times import DAY, floor_div

#: Failures in a row from which a source is failing, and how long the history of fetches is kept.
FAILING_AFTER, HISTORY = 3, 30 * DAY


def next_health(fetches: DataFrame, data_triggers: list[str] | None = None) -> DataFrame:
    """``(source_id, status, consecutive_failures, last_success_ns, last_error, last_error_ns, last_fetch_id, last_fetch_status, last_rows)``
    after all ``fetches (source_id, fetch_id, at_ns, status, error, trigger, rows)``: ``ok`` after a success, ``degraded`` after a failure,
    ``failing`` from ``FAILING_AFTER`` failures in a row. ``data_triggers``: the triggers that count as the last fetch of data (null:
    all).

    Failures in a row are those behind the last success, so the fold over a source's history is two aggregations that are combined
    before the shuffle; a source of any length is no single task's. Fetches of one time are in order of their ids."""
    at = F.struct("at_ns", "fetch_id")
    good = F.col("status") == "succeeded"
    ends = fetches.groupBy("source_id").agg(F.max(F.when(good, at)).alias("success"))
    own = fetches.join(ends, "source_id")
    after = F.col("success").isNull() | (at > F.col("success"))
    data = F.lit(True) if data_triggers is None else F.col("trigger").isin(data_triggers)
    out = own.groupBy("source_id").agg(
        F.count_if(~good & after).alias("consecutive_failures"),
        F.max("success.at_ns").alias("last_success_ns"),
        F.max(F.when(~good, F.struct("at_ns", "fetch_id", "error"))).alias("e"),
        F.max(F.when(data, F.struct("at_ns", "fetch_id", F.col("status").alias("s"), F.coalesce("rows", F.lit(0)).cast("long").alias("r")))).alias("f"),
    )
    status = F.when(F.col("consecutive_failures") == 0, "ok").when(F.col("consecutive_failures") < FAILING_AFTER, "degraded").otherwise("failing")
    return out.select("source_id", status.alias("status"), "consecutive_failures", "last_success_ns", F.col("e.error").alias("last_error"), F.col("e.at_ns").alias("last_error_ns"), F.col("f.fetch_id").alias("last_fetch_id"), F.col("f.s").alias("last_fetch_status"), F.col("f.r").alias("last_rows"))


def prune(fetches: DataFrame, now: int, keep: int = HISTORY) -> DataFrame:
    """Fetches that are not older than ``keep``."""
    return fetches.where(F.col("at_ns") >= now - keep)


def reap(runs: DataFrame, now: int, stale: int) -> DataFrame:
    """``runs (status, beat_ns, ...)`` with those that run but gave no sign for ``stale`` as failed."""
    dead = (F.col("status") == "running") & (F.coalesce("beat_ns", F.lit(0)) < now - stale)
    return runs.withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))


def rate_counts(calls: DataFrame, width: int, most: int) -> DataFrame:
    """``(key, window_ns, n, limited)`` of ``calls (key, at_ns)``: calls in windows of ``width`` from the epoch, and how many of them were
    over ``most``."""
    n = calls.groupBy("key", (floor_div(F.col("at_ns"), width) * width).alias("window_ns")).agg(F.count("*").alias("n"))
    return n.withColumn("limited", F.greatest(F.lit(0).cast("long"), F.col("n") - most))


def _dealt(spans: DataFrame, width: int) -> DataFrame:
    """Spans once for each stretch of ``width`` that they touch."""
    return spans.withColumn("_day", F.explode(F.sequence(floor_div(F.col("start_ns"), width), floor_div(F.col("end_ns"), width))))


def label_hits(labels: DataFrame, findings: DataFrame, width: int = DAY) -> DataFrame:
    """``(check_id, windows, hit, recall, findings, outside, false_share)``: of the labelled windows ``(series_id, start_ns, end_ns)`` how many each
    check's ``findings (check_id, series_id, start_ns, end_ns)`` touch (the ends count), and of its findings how many touch none.

    Repeated windows count once. Windows and findings are dealt to the stretches of ``width`` that they touch, so both the semi join
    (windows that are hit) and the anti join (findings outside) are equi-joins on series and stretch."""
    known = labels.select("series_id", "start_ns", "end_ns").distinct()
    total = known.count()
    numbered = findings.select("check_id", "series_id", "start_ns", "end_ns").groupBy("check_id", "series_id", "start_ns", "end_ns").agg(F.count("*").alias("_n"))
    w = _dealt(known, width).withColumnsRenamed({"start_ns": "w_start", "end_ns": "w_end"})
    met = _dealt(numbered, width).join(w, ["series_id", "_day"]).where("start_ns <= w_end and end_ns >= w_start")
    hit = met.select("check_id", "series_id", "w_start", "w_end").distinct().groupBy("check_id").agg(F.count("*").alias("hit"))
    inside = met.select("check_id", "series_id", "start_ns", "end_ns").distinct()
    outside = numbered.join(inside, ["check_id", "series_id", "start_ns", "end_ns"], "left_anti").groupBy("check_id").agg(F.sum("_n").alias("outside"))
    sums = numbered.groupBy("check_id").agg(F.sum("_n").alias("findings"))
    out = sums.join(hit, "check_id", "left").join(outside, "check_id", "left").withColumn("windows", F.lit(total).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("check_id", "windows", zero("hit"), "findings", zero("outside"))
    return out.withColumn("recall", F.try_divide("hit", "windows")).withColumn("false_share", F.try_divide("outside", "findings"))


def lanes(findings: DataFrame, by_series: bool = True) -> DataFrame:
    """``(series_id, check_id, severity, n, start_ns, end_ns, lane)``: findings by check (and series), the worst severity first, then the
    most; ``lane`` numbers them from 0."""
    order = F.array(*[F.lit(s) for s in SEVERITY])
    key = ["series_id", "check_id"] if by_series else ["check_id"]
    rank = F.array_position(order, F.col("severity"))
    found = findings.groupBy(*key).agg(F.max(rank).alias("_worst"), F.count("*").alias("n"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    told = found.withColumn("severity", F.get(order, (F.col("_worst") - 1).cast("int")))
    # as many rows as there are checks of series that have findings; numbered for a page
    lane = F.row_number().over(Window.orderBy(F.col("_worst").desc(), F.col("n").desc(), *key)) - 1
    return told.withColumn("lane", lane).drop("_worst")


def source_counts(sources: DataFrame, series: DataFrame) -> DataFrame:
    """``sources (source_id, ...)`` with ``n_series``, how many ``series (source_id, ...)`` each has."""
    n = series.groupBy("source_id").agg(F.count("*").alias("n_series"))
    return sources.join(n, "source_id", "left").withColumn("n_series", F.coalesce("n_series", F.lit(0)))
