"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast; more go through a shuffle join, to the same result.
BROADCAST_ROWS = 300_000
#: Where each table that `written` returned lies.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one if all runs on this
    machine (local tests); on a cluster that is an error, since executors would each write to their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back, which cuts its lineage:
    a lost executor costs at most the tasks that were running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned and nothing needs any more, and what `free` does."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if tables:
        free(tables[0].sparkSession)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of finished queries, which it keeps until the driver collects its garbage."""
    gc.collect()  # what Python still holds of them
    spark._jvm.System.gc()


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for a broadcast join only if it has at most ``most`` rows now."""
    return F.broadcast(df) if df.count() <= most else df
