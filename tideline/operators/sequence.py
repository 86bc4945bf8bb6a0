"""Neighbours, running sums and runs along each series, without a window over a whole series.

A series may hold a large part of all rows. So windows span one chunk of time of one series, and what
crosses chunks meets in a second window or table of a few rows for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.times import DAY, floor_div

#: Length of a chunk of a series.
CHUNK = DAY


#: The part that rows at either end of a chunk share, so that they meet those of the chunks beside it.
ENDS = -(2**63)


def _chunked(df: DataFrame, key: str, order: str, chunk: int) -> tuple[DataFrame, Window, Window]:
    out = df.withColumn("_chunk", floor_div(F.col(order), chunk))
    return out, Window.partitionBy(key, "_chunk").orderBy(order), Window.partitionBy(key).orderBy("_chunk")


def neighbour(df: DataFrame, name: str, value: Column, after: bool = False, key: str = "series_id", order: str = "ts_ns", chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``, the value of the row before (or after) in its series; null at the end. Within a chunk the
    row beside is a window's; the first and last rows of all chunks then meet in a second one, which has two
    rows a chunk."""
    out, within, _ = _chunked(df.withColumn("_own", F.struct(value.alias("v"))), key, order, chunk)
    move, other = (F.lead, F.lag) if after else (F.lag, F.lead)
    out = out.withColumn("_near", move("_own").over(within)).withColumn("_end", F.col("_near").isNull() | other("_own").over(within).isNull())
    out = out.withColumn("_part", F.when(F.col("_end"), ENDS).otherwise(F.col("_chunk")))
    across = Window.partitionBy(key, "_part").orderBy(order)
    return out.withColumn(name, F.coalesce("_near", move("_own").over(across))["v"]).drop("_chunk", "_own", "_near", "_end", "_part")


def running(df: DataFrame, name: str, value: Column, key: str = "series_id", order: str = "ts_ns", chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``, the sum of ``value`` up to and including the row; orders must be distinct."""
    out, within, across = _chunked(df.withColumn("_own", value), key, order, chunk)
    sums = out.groupBy(key, "_chunk").agg(F.sum("_own").alias("_sum"))
    before = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_own").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return out.join(before, [key, "_chunk"]).withColumn(name, own + F.col("_before")).drop("_chunk", "_own", "_before")


def runs(df: DataFrame, flag: Column, key: str = "series_id", order: str = "ts_ns", chunk: int = CHUNK, least: Column | None = None, first: Column | None = None) -> DataFrame:
    """One row for each maximal run of rows where ``flag`` holds: ``first_ts``, ``last_ts``, ``next_ts`` (the time
    of the row after the run, if any), ``n``, and ``least``/``first``, the least and the first of the given columns.
    Null flags are false.

    Stretches of one flag are found within chunks. Those at either end of a chunk, flagged or not, then meet in
    a second window, a few rows a chunk, where runs over a chunk's bounds are joined."""
    out, within, _ = _chunked(df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_least", F.lit(None).cast("double") if least is None else least).withColumn("_first", F.lit(None).cast("double") if first is None else first), key, order, chunk)
    out = out.withColumn("_turn", F.when(F.lag("_flag").over(within) == F.col("_flag"), 0).otherwise(1)).withColumn("_ahead", F.lead(order).over(within))
    out = out.withColumn("_stretch", F.sum("_turn").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = out.groupBy(key, "_chunk", "_stretch").agg(
        F.first("_flag").alias("_flag"),
        F.min(order).alias("_from"),
        F.max(order).alias("_to"),
        F.count("*").alias("_n"),
        F.max("_ahead").alias("_ahead"),
        F.bool_or(F.col("_ahead").isNull()).alias("_tail"),
        F.min("_least").alias("_least"),
        F.min_by("_first", order).alias("_first"),
    )
    end = F.col("_tail") | (F.col("_stretch") == 1)
    parts = parts.where(F.col("_flag") | end).withColumn("_part", F.when(end, ENDS).otherwise(F.col("_chunk")))
    across = Window.partitionBy(key, "_part").orderBy("_from")
    joined = end & F.lag("_flag").over(across) & F.col("_flag") & (F.lag("_chunk").over(across) != F.col("_chunk"))
    parts = parts.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_follows", F.when(F.col("_tail"), F.lead("_from").over(across)).otherwise(F.col("_ahead")))
    parts = parts.withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))).where("_flag")
    found = parts.groupBy(key, "_part", "_run").agg(F.min("_from").alias("first_ts"), F.max("_to").alias("last_ts"), F.max_by("_follows", "_to").alias("next_ts"), F.sum("_n").alias("n"), F.min("_least").alias("least"), F.min_by("_first", "_from").alias("first"))
    return found.drop("_part", "_run", *[c for c, x in (("least", least), ("first", first)) if x is None])


def merged(spans: DataFrame, key: list[str], start: str = "start_ns", end: str = "end_ns", gap: int = 0, inclusive: bool = True) -> DataFrame:
    """Spans of a key that overlap, touch, or lie up to ``gap`` apart (less, if not ``inclusive``), as one."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) - F.col("_reach") > gap) if inclusive else (F.col(start) - F.col("_reach") >= gap)
    out = spans.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | apart, 1).otherwise(0))
    out = out.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*key, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_group")


def missing_ranges(cover: DataFrame, start: int, end: int, key: list[str]) -> DataFrame:
    """The parts of ``[start, end)`` that no ``(start_ns, end_ns)`` row of a key covers."""
    own = cover.where((F.col("end_ns") > start) & (F.col("start_ns") < end) & (F.col("end_ns") > F.col("start_ns")))
    keys = cover.select(*key).distinct()
    bounds = keys.select(*key, F.lit(start).cast("long").alias("start_ns"), F.lit(start).cast("long").alias("end_ns")).unionByName(keys.select(*key, F.lit(end).cast("long").alias("start_ns"), F.lit(end).cast("long").alias("end_ns")))
    w = Window.partitionBy(*key).orderBy("start_ns", "end_ns").rowsBetween(Window.unboundedPreceding, -1)
    out = own.select(*key, "start_ns", "end_ns").unionByName(bounds).withColumn("_reach", F.max("end_ns").over(w))
    return out.where(F.col("_reach") < F.col("start_ns")).select(*key, F.col("_reach").alias("gap_start"), F.col("start_ns").alias("gap_end"))
