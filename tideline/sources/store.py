"""The observation store: Parquet by layer, source, bucket of series and month; the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.times import months_start
from tideline.operators.normalize import normalized

BUCKETS = 64
PARTITIONS = ["layer", "source_id", "bucket", "month"]


def bucket(series):
    return F.pmod(F.xxhash64(series), F.lit(BUCKETS)).cast("int")


def write(obs: DataFrame, path: str, layer: str, source_id: str, write_ns: int) -> None:
    """Appends, one row for each time of a series (the first delivered, where there are several); rows of a series and
    month lie together, sorted, so that files prune by time."""
    one = normalized(obs) if "seq" in obs.columns else obs.groupBy("series_id", "ts_ns").agg(F.min(F.struct("value", "quality", "ingest_ns")).alias("x")).select("series_id", "ts_ns", "x.*")
    rows = one.select("series_id", "ts_ns", "value", "quality", "ingest_ns").withColumns({"write_ns": F.lit(write_ns).cast("long"), "layer": F.lit(layer), "source_id": F.lit(source_id), "bucket": bucket(F.col("series_id")), "month": months_start(F.col("ts_ns"))})
    spread = rows.repartition("bucket", "month", F.expr("ts_ns div 86400000000000"))
    spread.sortWithinPartitions("bucket", "month", "series_id", "ts_ns").write.mode("append").partitionBy(*PARTITIONS).option("compression", "zstd").parquet(path)


def last_write(rows: DataFrame) -> DataFrame:
    """One row for each time of a series: the last written."""
    rest = [c for c in rows.columns if c not in ("series_id", "ts_ns", "write_ns")]
    return rows.groupBy("series_id", "ts_ns").agg(F.max_by(F.struct(*rest), "write_ns").alias("x"), F.max("write_ns").alias("write_ns")).select("series_id", "ts_ns", "x.*", "write_ns")


def read(spark: SparkSession, path: str, layer: str, source_id: str, series: list[str], start_ns: int, end_ns: int) -> DataFrame:
    """Rows of some series in ``[start_ns, end_ns)``. Buckets and months are worked out here, so the
    scan prunes folders, and the times and names reach the files' statistics."""
    limits = spark.range(1).select(*[months_start(F.lit(t).cast("long")).alias(c) for t, c in ((start_ns, "lo"), (end_ns - 1, "hi"))], *[bucket(F.lit(s)).alias(f"b{i}") for i, s in enumerate(series)]).first()
    found = spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("source_id") == source_id) & F.col("bucket").isin(sorted(set(limits[2:]))) & F.col("month").between(limits.lo, limits.hi))
    found = found.where(F.col("series_id").isin(series) & (F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))
    return last_write(found.drop(*PARTITIONS))


def record_coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage rows by (series_id, layer, range_start): the farther end, the newer row's figures."""
    whole = new.withColumn("range_end", F.col("range_end") + F.pmod(-F.col("range_end"), F.lit(1000)))  # up to the microsecond
    both = old.unionByName(whole)
    return both.groupBy("series_id", "layer", "range_start").agg(F.max("range_end").alias("range_end"), F.max_by("n_rows", "written_at").alias("n_rows"), F.max("written_at").alias("written_at"))


def estimate_rows(cover: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of ``[start, end)`` if each range's rows are spread evenly."""
    share = F.greatest(F.lit(0), F.least(F.col("range_end"), F.lit(end)) - F.greatest(F.col("range_start"), F.lit(start))) / F.greatest(F.lit(1), F.col("range_end") - F.col("range_start"))
    return cover.groupBy("series_id").agg(F.ceil(F.sum(F.col("n_rows") * share)).alias("rows"))
