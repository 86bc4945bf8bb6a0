"""One query for each training-data operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality_rules import judge

    return judge(_read(spark, sf_dir, "documents"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.class_lm import score

    return score(_read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.line_dedup import dedup_lines

    found = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideline.llm.bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts of each kind and the spans as text, the base kinds' as a digest too."""
    from tideline.llm.secrets import scan

    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != "checked")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan(docs).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "checked")],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(_read(spark, sf_dir, "documents"))


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.decontaminate import contamination

    return contamination_digest(contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.toxicity import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality_rank import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.variants import variants

    return variants(_read(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.vantage import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideline.llm.alignment import align

    return align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_quality_rules,
        op3_class_lm,
        op4_html_text,
        op5_line_dedup,
        op6_byte_bpe,
        op7_secrets,
        op8_decontamination,
        op9_toxicity,
        op10_quality,
        op11_variants,
        op12_neighbours,
        op13_alignment,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: crc32 of a string's bytes by the table of its polynomial, for a column ``s``.
_CRC_TABLE = "[list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)]"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(s)), i, 2))::BIGINT FOR i IN range(1, 2 * octet_length(encode(s)), 2)]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

#: What SQL can express. Components and groups of lines follow links to any depth, and models, page text, checksums and
#: token ids have no SQL form; the search for neighbours is approximate.
ORACLE_SQL: dict[str, str] = {
    "op11_variants": f"""WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS r FROM documents),
 own AS (SELECT r, coalesce(doc_id::VARCHAR, '') || ':' || r AS s, count(*) AS k FROM runs WHERE length(r) >= 6 GROUP BY 1, 2), crc AS (SELECT {_CRC_TABLE} AS t),
 h AS (SELECT r, k, {_CRC} AS h FROM own, crc), w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k FROM h),
 v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5), gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
 near AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM gone a JOIN gone b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, a.n, v.word, v.n FROM gone a JOIN v ON v.word = a.less UNION SELECT v.word, v.n, a.word, a.n FROM gone a JOIN v ON v.word = a.less),
 best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM near GROUP BY 1),
 f AS (SELECT v.word, v.n, CASE WHEN m >= 5 * n THEN near END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
 way AS (SELECT word, word AS here, 0 AS far FROM f UNION ALL SELECT way.word, f.form, far + 1 FROM way JOIN f ON f.word = way.here WHERE f.form IS NOT NULL), ends AS (SELECT word, arg_max(here, far) AS root FROM way GROUP BY 1)
 SELECT word, n, form, root, n_near, form_n FROM f JOIN ends USING (word)""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
 sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0), win AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS v FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
 dw AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
 m AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.v = dw.v), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
 own AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM m GROUP BY 1)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
}
