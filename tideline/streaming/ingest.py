"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.meaning import finite, usable
from tideline.functions.times import SEC
from tideline.sources import store


def read_drop(spark: SparkSession, path: str, schema: str, files_at_once: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """New files of a folder, each once; the checkpoint remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).parquet(path)


def to_store(rows: DataFrame, path: str, checkpoint: str, layer: str, source_id: str) -> StreamingQuery:
    """Appends each batch under the time at which it was first written, which is kept beside the checkpoint; a batch
    that runs again is written again under it, and reading keeps the last write, so nothing counts twice. Times
    rise with batches, over restarts and new checkpoints, and compare with those of rows that are written directly."""

    def put(batch: DataFrame, number: int) -> None:
        store.write(batch, path, layer, source_id, _write_time(batch.sparkSession, checkpoint, number))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write_time(spark: SparkSession, checkpoint: str, number: int) -> int:
    """The time in nanoseconds kept for a batch; the first to ask for it sets it. One small file a batch."""
    at = f"{checkpoint.rstrip('/')}/write-times/{number}"
    try:
        kept = spark.read.text(at).head(1)
    except AnalysisException:
        kept = []
    if kept:
        return int(kept[0][0])
    now = time.time_ns()  # none yet, or a write that was broken off
    spark.createDataFrame([(str(now),)], "value string").coalesce(1).write.mode("overwrite").text(at)
    return now


def settled(rows: DataFrame, now: int, settle: int = 300 * SEC) -> DataFrame:
    """Rows older than the time within which a source may still change."""
    return rows.where(F.col("ts_ns") < now - settle)


def bin_counts(rows: DataFrame, late: str = "5 minutes", width: str = "1 hour") -> DataFrame:
    """Good values by window of event time (``ts`` timestamp); rows later than ``late`` are dropped."""
    good = F.count_if(usable(F.col("quality")) & finite(F.col("value")))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "series_id").agg(F.count("*").alias("n"), good.alias("good"))
