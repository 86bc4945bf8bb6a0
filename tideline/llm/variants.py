"""Spelling variants: words that are one inserted, deleted or replaced code point apart, and the form that each stands for.

The full neighbourhood of every word is generated over the observed alphabet and joined to the vocabulary by
equality, so no distance is ever computed. An edit leaves the first or the second half of a word as it is, so the
neighbourhood of a word is generated where the words with that half are: only halves and words cross the network,
and candidates that no word of that place can equal stay in their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._store import discard, written
from tideline.llm._text import mix

#: Letters that words are made of; A-Z are lower-cased before words are counted.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words and halves in one partition of the join.
ROWS = 200_000
#: Bits that tell a candidate that no word of its partition can equal.
BITS = 23
#: Candidates generated at once.
AT_ONCE = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_UP = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(4095, _BASE, _U)]))
_DOWN = _U(pow(_BASE, -1, 1 << 64))


def _after_deletion(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one code point if ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``(word, n)`` of all words of at least ``least_length`` code points that come ``least_count`` times. Counts are
    combined before the shuffle, so a frequent word is no hot key. Null texts have none; rows that repeat count again."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    lower = runs.select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    words = lower.select(_after_deletion(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """``(word, half, seeks)``: each word with its own halves, whose edits of the other half are wanted there
    (``seeks``), and with the halves that words of its length or of one more or less would share with it."""
    n = F.length("word")
    first = lambda of: F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), F.floor(of / 2).cast("int")))
    last = lambda of: F.concat(F.lit(">"), F.substring(F.col("word"), n - F.ceil(of / 2).cast("int") + 1, n))
    own = F.array(F.struct(first(n).alias("half"), F.lit(True).alias("seeks")), F.struct(last(n).alias("half"), F.lit(True).alias("seeks")))
    met = F.transform(F.array_distinct(F.array(*[f(n + d) for f in (first, last) for d in (-1, 0, 1)])), lambda h: F.struct(h.alias("half"), F.lit(False).alias("seeks")))
    return words.select("word", F.explode(F.concat(own, met)).alias("x")).select("word", "x.half", "x.seeks")


class _Alphabet:
    """Code points of the vocabulary, and a 64-bit number for each."""

    def __init__(self, letters: list[str]):
        self.points = np.array(sorted(map(ord, letters)), np.uint32)
        self.values = mix(self.points.astype(_U) + _U(1)) | _U(1)

    def codes(self, words: list[str], length: int) -> np.ndarray:
        return np.searchsorted(self.points, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length))

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of the words: a column for each number of letters."""
        out = np.zeros((len(codes), codes.shape[1] + 1), _U)
        np.cumsum(self.values[codes] * _UP[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out


def _edits(alphabet: _Alphabet, codes: np.ndarray, places: range) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """Of each place the distinct words that an edit there makes: (place, kind, hashes, whether to leave out), a row for
    each word and a column for each letter. Of edits that make the same word the first counts: no letter is
    inserted behind itself, and of a run of one letter the first is deleted."""
    before = alphabet.hashes(codes)
    total, letters = before[:, -1:], np.arange(len(alphabet.points))
    for i in places:
        behind = codes[:, i - 1 : i] == letters if i else np.zeros((len(codes), len(letters)), bool)
        new = alphabet.values * _UP[i]
        yield i, "insert", before[:, i : i + 1] + new + (total - before[:, i : i + 1]) * _UP[1], behind
        if i < codes.shape[1]:
            yield i, "replace", total - (before[:, i + 1 : i + 2] - before[:, i : i + 1]) + new, codes[:, i : i + 1] == letters
            yield i, "delete", before[:, i : i + 1] + (total - before[:, i + 1 : i + 2]) * _DOWN, codes[:, i : i + 1] == codes[:, i - 1 : i] if i else np.zeros((len(codes), 1), bool)


def _candidates(letters: list[str]):
    """From rows of `_halves` of one partition to ``(word, near)``: the edits of the words that seek, but for those whose
    hash no word of the partition has."""
    alphabet = _Alphabet(letters)
    chars = np.array([chr(x) for x in alphabet.points])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeking: dict[tuple[str, int], list[str]] = {}
        met: dict[int, list[str]] = {}
        for batch in batches:
            for word, half, seeks in zip(*(batch.column(c).to_pylist() for c in ("word", "half", "seeks")), strict=True):
                if seeks:
                    seeking.setdefault((half[0], len(word)), []).append(word)
                else:
                    met.setdefault(len(word), []).append(word)
        if not seeking or not met:
            return
        there = np.unique(np.concatenate([alphabet.hashes(alphabet.codes(w, n))[:, -1] for n, w in met.items()]))
        bits = np.zeros(1 << BITS, bool)
        bits[mix(there) >> _U(64 - BITS)] = True
        for (side, length), words in seeking.items():
            places = range(length // 2, length + 1) if side == "<" else range(length // 2)
            step = max(1, AT_ONCE // len(chars))
            for at in range(0, len(words), step):
                some = words[at : at + step]
                out: list[tuple[str, str]] = []
                for i, kind, hashes, left_out in _edits(alphabet, alphabet.codes(some, length), places):
                    row, letter = np.nonzero(bits[mix(hashes) >> _U(64 - BITS)] & ~left_out)
                    hit = hashes[row, letter]
                    same = there[np.minimum(np.searchsorted(there, hit), len(there) - 1)] == hit
                    for r, c in zip(row[same].tolist(), letter[same].tolist(), strict=True):
                        w = some[r]
                        out.append((w, w[:i] + ("" if kind == "delete" else chars[c]) + w[i + (kind != "insert") :]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], ["word", "near"])

    return found


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: all pairs of ``words`` (``word`` distinct, ``n``) that differ by exactly one inserted, deleted or
    replaced code point, both ways round."""
    letters = [x.c for x in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]  # one for each letter of the alphabet
    if not letters:
        return words.sparkSession.createDataFrame([], "word string, near string, near_n long")
    dealt = _halves(words.select("word")).repartition(words.count() * 6 // ROWS + 1, "half")
    made = dealt.mapInArrow(_candidates(letters), "word string, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form: forms are followed to the last by doubling the way in each round. A form comes
    at least ``ratio`` times as often as the word, so there are no circles and ways are short."""
    done = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = done.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, done = done, written(done.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(old)
        if not done.where("moved").head(1):
            return done.drop("moved")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` of a vocabulary ``(word, n)``.

    A word's form is its near word of largest ``n`` (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's; else null. ``root`` follows forms to the last, the word itself if there is none. Rows without
    a word go; an empty vocabulary gives no rows; other columns of ``words`` aren't kept. Words are counted once
    each: repeated words must be summed before.
    """
    words = written(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    told = words.join(best, "word", "left").withColumn("strong", -F.col("best.n") >= ratio * F.col("n"))
    forms = written(told.select("word", "n", F.expr("if(strong, best.near, null)").alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(strong, -best.n, null)").alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """`group_variants` of the `vocabulary` of ``docs`` (``doc_id``, ``text`` and any other columns). A null id counts as empty text in
    the crc32. Texts that are null, empty or without letters have no words; a table without words gives no rows."""
    return group_variants(vocabulary(docs, least_length, least_count, every), ratio)
