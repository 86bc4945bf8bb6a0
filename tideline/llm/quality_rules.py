"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted over all documents: the raw corpus (every text)
and the trusted target (the texts that pass strict surface rules). A text's score is the mean over its
n-grams of log(p_target / p_raw), so length does not matter. A text is kept if its score reaches a
fixed threshold; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text

#: Buckets of the hashed n-grams and the buckets in one row of partial counts.
BUCKETS, PART = 1 << 16, 1 << 10
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_IS_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_IS_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(hashes: np.ndarray, count: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each document, the words in ``size``-word windows that occur twice or more in it."""
    out = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= size:
        rolled, to = _text.windows(hashes, np.where(count >= size, count, 0), first, size)
        n = np.diff(to)
        doc = np.repeat(np.arange(len(count)), n)
        at = np.arange(len(rolled)) - np.repeat(to[:-1], n) + np.repeat(first[:-1], n)
        keyed = _text.mix(rolled + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed, kind="stable")
        ranked = keyed[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(ranked), bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = at[order[twice]]
        np.add.at(out, starts, 1)
        np.add.at(out, starts + size, -1)
    return _sums(np.cumsum(out[:-1]) > 0, first)


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that have a word, and each document's first line."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    newline = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([np.flatnonzero(cut[:-1]), newline + 1]))
    start = start[start < len(data)]
    nearest = np.searchsorted(newline, start)
    stop = np.append(newline, len(data))[nearest]
    end = np.minimum(stop, bounds[np.searchsorted(bounds, start, "right")] if len(start) else stop)
    filled = np.concatenate([[0], np.cumsum(_text.NOT_SPACE[data])])
    keep = filled[end] > filled[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, bounds)


def surface(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The base counts of a chunk's texts, and shares that the strict rules look at."""
    data, bounds = _text.utf8(batch.column("text"))
    tokens = _text.Tokens(data, bounds, _text.NOT_SPACE, lower=False)
    starts, ends, first = _lines(data, bounds)
    line = _text.spans(data, starts, ends)
    doc = np.repeat(np.arange(len(tokens.count)), np.diff(first))
    keyed = _text.mix(line + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    again = np.zeros(len(keyed), bool)
    again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
    return {
        "n_words": tokens.count.astype(np.int64),
        "word_chars": _sums(_text.NOT_SPACE[data] & _IS_FIRST[data], bounds),
        "n_symbols": _sums(_IS_SYMBOL[data], bounds),
        "n_dup_lines": _sums(again, first),
        "n_repeat_words": _repeated(tokens.hashes(), tokens.count, tokens.first, 5),
        "n_lines": np.diff(first),
        "n_upper": _sums(_IS_UPPER[data], bounds),
        "n_letters": _sums(_IS_LETTER[data] & _IS_FIRST[data], bounds),
    }


def base_failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])


def trusted(x: dict[str, np.ndarray]) -> np.ndarray:
    """The strict rules of the target: 20 words or more, under 1 % symbols, no repeated line, under
    5 % repeated words, under 20 % capitals, and words of 2 to 15 characters on average."""
    n = np.maximum(x["n_words"], 1)
    return (
        (x["n_words"] >= 20)
        & (100 * x["n_symbols"] < x["word_chars"])
        & (x["n_dup_lines"] == 0)
        & (20 * x["n_repeat_words"] < n)
        & (5 * x["n_upper"] < np.maximum(x["n_letters"], 1))
        & (x["word_chars"] >= 2 * n)
        & (x["word_chars"] <= 15 * n)
    )


def ngrams(data: np.ndarray, bounds: np.ndarray, size: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte n-gram of each text, and how many each text has."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    if len(data) < size:
        return np.zeros(0, np.int64), n
    rolled = np.zeros(len(data) - size + 1, np.uint32)
    for j in range(size):
        rolled = (rolled << np.uint32(8)) | data[j : len(data) - size + 1 + j]
    hashed = ((rolled * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32)
    within = np.ones(len(rolled), bool)
    for j in range(1, size):
        at = bounds[1:-1] - j
        within[at[(at >= 0) & (at < len(within))]] = False
    # an empty or very short text can leave several bounds within one window
    return hashed[within], n


class Ratio:
    """log(p_target / p_raw) of each bucket, with one count added to each."""

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        p, q = target + 1.0, raw + 1.0
        self.log = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def _counts(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the target's and of all n-grams, over all documents. Every task adds up its own
    and sends a fixed number of rows; only the ``BUCKETS`` sums come to the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in _text.chunks(batches):
            hashed, n = ngrams(*_text.utf8(batch.column("text")), size)
            x = surface(batch)
            total[1] += np.bincount(hashed, minlength=BUCKETS)
            total[0] += np.bincount(hashed[np.repeat(trusted(x), n)], minlength=BUCKETS)
        if total.any():
            parts = np.arange(2 * BUCKETS // PART)
            yield pa.RecordBatch.from_arrays([pa.array(parts), _text.lists(total.reshape(-1), np.full(len(parts), PART))], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("counts").flatten().to_numpy().reshape(-1, PART)
            for i, part in enumerate(batch.column("part").to_pylist()):
                total[part] = total.get(part, 0) + values[i]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), _text.lists(np.concatenate(list(total.values())), np.full(len(total), PART))], ["part", "counts"])

    parts = docs.select("text").mapInArrow(of, "part long, counts array<long>")
    out = np.zeros((2 * BUCKETS // PART, PART), np.int64)
    for r in parts.repartition(F.col("part")).mapInArrow(add, "part long, counts array<long>").collect():
        out[r[0]] = r[1]
    out = out.reshape(2, BUCKETS)
    return out[0], out[1]


def _ratio(docs: DataFrame, size: int):
    target, raw = _counts(docs, size)
    return docs.sparkSession.sparkContext.broadcast(Ratio(target, raw) if target.any() else Ratio(raw, raw))


def _verdict(batch: pa.RecordBatch, ratio: Ratio, size: int, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    x = surface(batch)
    hashed, n = ngrams(*_text.utf8(batch.column("text")), size)
    total = np.concatenate([[0.0], np.cumsum(ratio.log[hashed], dtype=np.float64)])
    to = np.concatenate([[0], np.cumsum(n)])
    score = np.round((total[to[1:]] - total[to[:-1]]) / np.maximum(n, 1), 9)
    failed = base_failed(x)
    return x, failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, threshold: float = -0.25, size: int = 4) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
    kept)`` for every row of ``docs (doc_id, text)``.

    A text with fewer than ten words, or with over 20 % of its words in repeated 5-word windows, fails
    the base rules. Of the others, those whose mean log ratio is under ``threshold`` are rejected. Null
    and empty texts have no words and fail. Texts shorter than ``size`` bytes score 0. Should no text
    be trusted, all scores are 0. Repeated rows get a row each; other columns are ignored.
    """
    ratio = _ratio(docs, size)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            x, failed, score, kept = _verdict(batch, ratio.value, size, threshold)
            names = [c.split()[0] for c in BASE.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(x[c]) for c in names] + [pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *names, "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, {BASE}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, threshold: float = -0.25, size: int = 4) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass without a join. Null and empty texts
    have too few words and go. Each row is judged on its own: ids may be missing or repeated, and other columns may have
    any names. An empty table gives an empty result."""
    ratio = _ratio(docs, size)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            yield batch.filter(pa.array(_verdict(batch, ratio.value, size, threshold)[3]))

    return docs.mapInArrow(of, docs.schema)
