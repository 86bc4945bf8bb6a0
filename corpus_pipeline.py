"""Raw documents to token ids: quality rules, line dedup, near-duplicate removal, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._store import discard, small_or_shuffled, written
from tideline.llm.bpe import round_trip
from tideline.llm.decontaminate import contamination
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.near_dedup import near_duplicates
from tideline.llm.quality_rules import keep_good


def _told(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells the texts of one id apart, and its name. Decisions depend on a row's text alone, so they are
    applied by id and this column: ids may be missing or repeated, and no copy of the texts is needed."""
    name = "_text"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("text")), name


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` but those of ``gone (doc_id, <name>)``."""
    which = small_or_shuffled(written(gone.distinct(), "gone")).withColumnsRenamed({"doc_id": "_gone_id", name: "_gone_text"})
    return docs.join(which, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & F.col(name).eqNullSafe(F.col("_gone_text")), "left_anti").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go, null and empty texts among them; each row is
    judged on its own, whatever its id. An empty table stays empty; other columns are kept."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go from the texts; ``n_chars`` follows. No row goes; null texts stay null; rows
    without an id are left alone, rows that repeat one count as one document."""
    found = dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts the rows with the smallest id stay; others of the group go, and those without an
    id if any has one. A row is judged by its own text, whatever other rows share its id. Texts without words stay."""
    rows, name = _told(docs)
    found = near_duplicates(rows, carry=(name,))
    return _without(rows, found.where("not kept").select("doc_id", name), name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has passages of the benchmark go, whatever their id; null and empty texts stay."""
    rows, name = _told(docs)
    both = F.struct("doc_id", name)
    found = contamination(rows.select(both.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.where("contaminated").select("doc_id.*"), name)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the bytes that they decode to, a row for each row."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each result written and read again; tables that no later stage reads are
    deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Line dedup and near-duplicate removal follow links to any depth, and BPE has no SQL form.
ORACLE_SQL = None
