"""Made-up series and planted faults, for tests of detection and of false positives at any size.

Every value depends on the seed, the series and the row's number alone, so any partitioning gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.times import MIN, SEC


def uniform(seed: int, *of: Column) -> Column:
    """A number in (0, 1) that the seed and the columns tell."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *of: Column) -> Column:
    """A standard normal number that the seed and the columns tell."""
    return F.sqrt(-2 * F.log(uniform(seed, *of))) * F.cos(2 * math.pi * uniform(seed + 1, *of))


def generate(spark: SparkSession, n: int, series: list[str] | int = 1, interval: int = MIN, start: int = 1_700_000_000 * SEC, base: float = 50.0, amplitude: float = 10.0, period: float = 1440.0, noise: float = 0.5, seed: int = 1, delay: int = SEC) -> DataFrame:
    """``n`` rows ``(series_id, seq, ts_ns, value, quality, ingest_ns)`` of each series: a sine of ``period`` rows around
    ``base`` with normal noise, all good, delivered ``delay`` later. Series are named, or ``s0``, ``s1``, ... if counted."""
    if n < 0 or interval <= 0 or period <= 0:
        raise ValueError("n must not be negative, interval and period must be positive")
    names = spark.range(series).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("series_id")) if isinstance(series, int) else spark.createDataFrame([(s,) for s in series], "series_id string")
    rows = names.select("series_id", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK))).alias("_b")) if n else names.withColumn("_b", F.lit(0)).limit(0)
    rows = rows.select("series_id", F.explode(F.sequence(F.col("_b").cast("long") * BLOCK, F.least((F.col("_b").cast("long") + 1) * BLOCK, F.lit(n)) - 1)).alias("seq"))
    ts = F.lit(start) + F.col("seq") * interval
    value = base + amplitude * F.sin(2 * math.pi * F.col("seq") / period) + noise * normal(seed, F.col("series_id"), F.col("seq"))
    return rows.select("series_id", "seq", ts.alias("ts_ns"), value.alias("value"), F.lit(0).alias("quality"), (ts + delay).alias("ingest_ns"))


#: Rows of a series that one input row makes.
BLOCK = 10_000


def _within(first: int, n: int, series: str | None = None) -> Column:
    inside = F.col("seq").between(first, first + n - 1)
    return inside if series is None else inside & (F.col("series_id") == series)


def gap(obs: DataFrame, first: int, n: int, series: str | None = None) -> DataFrame:
    """Without ``n`` rows from number ``first``, of all series or of one (as all faults here)."""
    return obs.where(~_within(first, n, series))


def _set(obs: DataFrame, column: str, where: Column, value: Column) -> DataFrame:
    return obs.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def flatline(obs: DataFrame, first: int, n: int, series: str | None = None) -> DataFrame:
    """The value of row ``first`` held for ``n`` rows."""
    held = obs.where(_within(first, 1, series)).select("series_id", F.col("value").alias("_held"))
    return _set(obs.join(held, "series_id", "left"), "value", _within(first, n, series) & F.col("_held").isNotNull(), F.col("_held")).drop("_held")


def spikes(obs: DataFrame, every: int, size: float, seed: int = 7, series: str | None = None) -> DataFrame:
    """``size`` added or taken away at about one row in ``every``."""
    here = (uniform(seed, F.col("series_id"), F.col("seq")) < 1 / every) & (F.lit(True) if series is None else F.col("series_id") == series)
    return _set(obs, "value", here, F.col("value") + F.when(uniform(seed + 9, F.col("seq")) < 0.5, -size).otherwise(size))


def missing(obs: DataFrame, first: int, n: int, series: str | None = None) -> DataFrame:
    return _set(obs, "value", _within(first, n, series), F.lit(float("nan")))


def constant(obs: DataFrame, first: int, n: int, value: float, series: str | None = None) -> DataFrame:
    return _set(obs, "value", _within(first, n, series), F.lit(value))


def scaled(obs: DataFrame, first: int, n: int, factor: float, offset: float = 0.0, series: str | None = None) -> DataFrame:
    return _set(obs, "value", _within(first, n, series), F.col("value") * factor + offset)


def flagged(obs: DataFrame, first: int, n: int, quality: int, series: str | None = None) -> DataFrame:
    return _set(obs, "quality", _within(first, n, series), F.lit(quality))


def duplicated(obs: DataFrame, row: int, times: int = 1, delta: float = 0.0, series: str | None = None) -> DataFrame:
    """Row ``row`` delivered ``times`` times more, right after itself; with ``delta`` the repeats conflict with it."""
    copies = F.when(_within(row, 1, series), F.sequence(F.lit(0), F.lit(times))).otherwise(F.array(F.lit(0)))
    out = obs.withColumn("_copy", F.explode(copies)).withColumn("value", F.when(F.col("_copy") > 0, F.col("value") + delta).otherwise(F.col("value")))
    return out.withColumn("seq", F.col("seq") * (times + 1) + F.col("_copy")).drop("_copy")


def swapped(obs: DataFrame, a: int, b: int, series: str | None = None) -> DataFrame:
    """Rows ``a`` and ``b`` delivered in each other's place."""
    own = F.lit(True) if series is None else F.col("series_id") == series
    return obs.withColumn("seq", F.when(own & (F.col("seq") == a), b).when(own & (F.col("seq") == b), a).otherwise(F.col("seq")).cast("long"))
