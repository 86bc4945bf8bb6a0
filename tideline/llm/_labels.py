"""Labelled rows to fit on: a bounded sample of the fold that may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on at most. Everything else covers all rows.
SAMPLE = 6000


def held_out(folds: int = 5) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is 0: the rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, folds: int = 5) -> DataFrame:
    """``(doc_id, text, label)`` of up to ``most`` labelled documents outside the held-out fold, those
    with the least hash of their id. The ids are few by construction, so they can be broadcast."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(folds))
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
