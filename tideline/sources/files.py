"""Series from files: long and wide CSV or Parquet, and epoch integers of unknown unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.meaning import quality_of_text
from tideline.functions.times import epoch_unit

#: Texts that stand for a missing number.
NULLS = ("", "NA", "NaN", "nan", "null")


_OFFSET = r"(?i)\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def text_time(c: Column, zone: str = "UTC") -> Column:
    """Text to nanoseconds, null if it can't be read: ISO 8601 and dates and times without padding. Times without an
    offset are of ``zone``; the session's time zone has no say."""
    text = F.trim(c)
    offset, local = F.regexp_extract(text, _OFFSET, 1), F.regexp_replace(text, _OFFSET, "").try_cast("timestamp_ntz")
    there = F.when(offset == "", F.convert_timezone(F.lit(zone), F.lit("UTC"), local)).otherwise(local)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), there)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(F.length(offset) > 1, sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.right(offset, F.lit(2)).cast("int"))).otherwise(0)
    finer = F.regexp_extract(F.regexp_replace(text, _OFFSET, ""), r"\.[0-9]{6}([0-9]{1,3})[0-9]*$", 1)
    nanos = F.when(finer == "", 0).otherwise(F.rpad(finer, 3, "0").cast("int"))
    return (micros - minutes.cast("long") * 60_000_000) * 1000 + nanos


class BadColumn(ValueError):
    """A column with values that can't be read; tells how many, and the first."""


def checked(df: DataFrame, column: str, bad: Column, what: str) -> DataFrame:
    """``df``; an error if ``bad`` holds anywhere. The first in order of ``seq`` is told."""
    found = df.agg(F.count_if(bad).alias("n"), F.min_by(F.struct("seq", F.col(column).cast("string").alias("v")), F.when(bad, F.col("seq"))).alias("first")).first()
    if found.n:
        raise BadColumn(f"{column}: {found.n} {what}, the first {found.first.v!r} in row {found.first.seq}")
    return df


def read_series(spark: SparkSession, path: str, series_id: str, ts: str = "ts", value: str = "value", quality: str | None = None, ingest: str | None = None, kind: str = "csv", zone: str = "UTC", sep: str = ",") -> DataFrame:
    """The rows of one series from CSV or Parquet, in the order of the file. Times are text, or whole numbers of one unit
    for the column; a column with both, and times or values that can't be read, are errors. Missing values are null."""
    raw = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True, sep=sep)
    lacking = [c for c in (ts, value, quality, ingest) if c and c not in raw.columns]
    if lacking:
        raise BadColumn(f"no column {', '.join(lacking)}")
    rows = raw.withColumn("seq", F.monotonically_increasing_id())
    for c in filter(None, (ts, ingest)):
        rows = time_column(rows, c, zone)
    number = F.col(value).cast("string")
    parsed = number.try_cast("double")
    rows = checked(rows, value, number.isNotNull() & ~F.trim(number).isin(*NULLS) & parsed.isNull(), "values that are no numbers")
    q = quality_of_text(F.col(quality).cast("string")) if quality else F.lit(0)
    arrived = F.col(f"{ingest}_ns") if ingest else F.lit(None).cast("long")
    return rows.select(F.lit(series_id).alias("series_id"), "seq", F.col(f"{ts}_ns").alias("ts_ns"), F.when(~F.trim(number).isin(*NULLS), parsed).alias("value"), q.alias("quality"), arrived.alias("ingest_ns"))


def time_column(rows: DataFrame, column: str, zone: str = "UTC") -> DataFrame:
    """Adds ``<column>_ns`` to rows with ``seq``. A column is all timestamps, all whole numbers or all text; what can't be
    read, and numbers whose unit puts them beyond a bigint, is an error."""
    kind = rows.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return rows.withColumn(f"{column}_ns", F.unix_micros(c.cast("timestamp_ltz")) * 1000 if kind == "timestamp" else text_time(c.cast("string"), zone))
    text = F.trim(c.cast("string"))
    whole = text.rlike("^[+-]?[0-9]+$")
    n = rows.agg(F.count_if(text.isNotNull() & whole).alias("whole"), F.count_if(text.isNotNull() & ~whole).alias("other")).first()
    if n.whole and n.other:
        checked(rows, column, F.lit(n.whole > n.other) == ~whole, "values unlike the others (whole numbers and text)")
    if n.whole:
        out = epoch_column(rows.withColumn(column, text.try_cast("long")), column).withColumnRenamed("ts_ns", f"{column}_ns")
    else:
        out = rows.withColumn(f"{column}_ns", text_time(text, zone))
    return checked(out, column, F.col(f"{column}_ns").isNull(), "times that can't be read")


def epoch_column(df: DataFrame, column: str = "ts") -> DataFrame:
    """Adds ``ts_ns`` from epoch integers, whose one unit the lower median of their magnitudes tells; null where the integer is."""
    from tideline.operators.ranks import nearest_rank

    size = df.where(F.col(column).isNotNull()).select(F.lit(0).alias("g"), F.abs(column).alias("m"))
    mid = nearest_rank(size, [0.5], "m", ["g"], half=0.0).select(epoch_unit(F.col("v")).alias("_unit"))
    return df.join(F.broadcast(mid.limit(1)), F.lit(True), "left").withColumn("ts_ns", F.try_multiply(F.col(column).cast("long"), F.col("_unit"))).drop("_unit")


def read_long(spark: SparkSession, path: str, ts: str = "ts", series: str = "series", value: str = "value", quality: str | None = "quality", ingest: str | None = None, sep: str = ",", zone: str = "UTC", strict: bool = False) -> DataFrame:
    """CSV with a row for each observation. By default bad numbers are missing, bad times null, and rows without a series
    go; ``strict`` makes each of these an error."""
    raw = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE").withColumn("seq", F.monotonically_increasing_id())
    v = F.when(~F.trim(value).isin(*NULLS), F.col(value).try_cast("double"))
    q = quality_of_text(F.col(quality)) if quality in raw.columns else F.lit(0)
    name = F.coalesce(F.trim(series), F.lit(""))
    if strict:
        raw = checked(raw, series, name == "", "rows without a series")
        raw = checked(raw, ts, text_time(F.col(ts), zone).isNull(), "times that can't be read")
        raw = checked(raw, value, F.col(value).isNotNull() & ~F.trim(value).isin(*NULLS) & v.isNull(), "values that are no numbers")
    arrived = text_time(F.col(ingest), zone) if ingest else F.lit(None).cast("long")
    return raw.select(name.alias("series_id"), "seq", text_time(F.col(ts), zone).alias("ts_ns"), v.alias("value"), q.alias("quality"), arrived.alias("ingest_ns")).where("series_id <> ''")


def unpivot(wide: DataFrame, ts: str = "ts_ns", columns: list[str] | None = None) -> DataFrame:
    """One row for each filled cell of one column a series."""
    names = columns or [c for c in wide.columns if c != ts]
    if len(set(names)) < len(names):
        raise ValueError("two columns have one name")
    return wide.unpivot([ts], names, "series_id", "value").where("value is not null")


def known_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not seen before: neither the same path, size and time, nor the same content."""
    fresh = listing.join(manifest.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return fresh.join(manifest.select("sha256").distinct(), "sha256", "left_anti")


def fetch_plan(gaps: DataFrame, longest: int, most: int) -> DataFrame:
    """Calls that fill ``gaps (series_id, gap_start, gap_end)``: spans up to ``longest``, equal spans in
    one call of up to ``most`` series. ``(from_ns, to_ns, call, n)`` in time order."""
    from pyspark.sql import Window

    cuts = gaps.select("series_id", "gap_end", F.explode(F.sequence(F.col("gap_start"), F.col("gap_end") - 1, F.lit(longest))).alias("from_ns"))
    spans = cuts.select("series_id", "from_ns", F.least(F.col("from_ns") + longest, "gap_end").alias("to_ns"))
    w = Window.partitionBy("from_ns", "to_ns").orderBy("series_id")
    numbered = spans.withColumn("call", F.call_function("div", F.row_number().over(w) - 1, F.lit(most)))
    return numbered.groupBy("from_ns", "to_ns", "call").agg(F.count("*").alias("n"))


def settled_files(listing: DataFrame, now: int, settle: int, largest: int) -> DataFrame:
    """Files ``(path, size, mtime)`` (nanoseconds) that may be read: not hidden, not changed within ``settle``, not over
    ``largest`` bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    return listing.where(~name.startswith(".") & ~name.startswith("_") & (F.col("mtime") <= now - settle) & (F.col("size") <= largest))
