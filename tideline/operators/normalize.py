"""Delivery order to time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.meaning import finite, usable
from tideline.functions.times import floor_div, since
from tideline.operators.sequence import neighbour

OBS = "series_id string, seq long, ts_ns long, value double, quality int, ingest_ns long"


def normalized(obs: DataFrame) -> DataFrame:
    """One row for each time of a series: the first delivered."""
    rest = [c for c in obs.columns if c not in ("series_id", "ts_ns", "seq")]
    return obs.groupBy("series_id", "ts_ns").agg(F.min_by(F.struct("seq", *rest), "seq").alias("x")).select("series_id", "ts_ns", "x.*")


def duplicate_counts(obs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Later deliveries of a time by series: ``exact`` (a value within ``tolerance`` of the first, or missing like it) or
    ``conflicting``. The quality doesn't matter."""
    first = obs.groupBy("series_id", "ts_ns").agg(F.min("seq").alias("s0"), F.min_by("value", "seq").alias("v0"), F.count("*").alias("n"))
    both = obs.join(first.where("n > 1"), ["series_id", "ts_ns"]).where("seq <> s0")
    lost = lambda c: F.col(c).isNull() | F.isnan(c)
    same = F.coalesce((lost("value") & lost("v0")) | (F.col("value") == F.col("v0")) | (F.abs(F.col("value") - F.col("v0")) <= tolerance), F.lit(False))
    found = both.groupBy("series_id").agg(F.count_if(same).alias("exact"), F.count_if(~same).alias("conflicting"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return obs.select("series_id").distinct().join(found, "series_id", "left").select("series_id", zero("exact"), zero("conflicting"))


def descents(obs: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``(series_id, out_of_order)``: how often the time falls from one delivery to the next."""
    back = neighbour(obs.select("series_id", "seq", "ts_ns"), "before", F.col("ts_ns"), order="seq", chunk=chunk)
    return back.groupBy("series_id").agg(F.count_if(F.col("ts_ns") < F.col("before")).alias("out_of_order"))


def good_values(obs: DataFrame) -> DataFrame:
    return obs.where(usable(F.col("quality")) & finite(F.col("value")))


def steps(norm: DataFrame) -> DataFrame:
    """Adds ``step``, the time since the row before, kept within the range of a bigint."""
    far = F.when(F.col("ts_ns") > F.col("before"), 2**63 - 1).otherwise(-(2**63) + 1)
    out = neighbour(norm, "before", F.col("ts_ns"))
    return out.withColumn("step", F.when(F.col("before").isNotNull(), F.coalesce(F.try_subtract("ts_ns", "before"), far))).drop("before")


def segments(norm: DataFrame, width: int) -> DataFrame:
    """Adds ``segment``, counted from each series' first time."""
    first = norm.groupBy("series_id").agg(F.min("ts_ns").alias("_first"))
    return norm.join(first, "series_id").withColumn("segment", F.call_function("div", since(F.col("_first"), F.col("ts_ns")), F.lit(width))).drop("_first")


def episodes(flagged: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Rows ``(key, ordinal, start_ns, end_ns)`` with consecutive ordinals as one."""
    w = Window.partitionBy(*key).orderBy(ordinal)
    island = flagged.withColumn("_i", F.col(ordinal) - F.row_number().over(w))
    return island.groupBy(*key, "_i").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("n_segments")).drop("_i")


def align(obs: DataFrame, grid: Column | int) -> DataFrame:
    """``(series_id, bin, mean)``: means of good values in bins counted from the epoch. Each series has one ``grid``."""
    good = good_values(obs).withColumn("bin", floor_div(F.col("ts_ns"), grid))
    return good.groupBy("series_id", "bin").agg(F.avg("value").alias("mean"))
