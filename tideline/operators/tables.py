"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

#: Where each table that `written` returned lies.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to ``spark.checkpoint.dir`` and read back, for what is read more than once: it is worked
    out once, and a lost executor costs only the tasks that were running. Where the setting is missing, a
    temporary folder serves if all runs on this machine; on a cluster that is an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Empties tables that `written` returned and nothing reads any more: they are overwritten with none of their rows,
    which deletes their files by Spark's own writer. Other tables are left alone."""
    for table in tables:
        path = None if table is None else _PATHS.pop(table, None)
        if path:
            table.sparkSession.range(0).write.mode("overwrite").parquet(path)
