"""Document quality by Bradley-Terry ranking.

A document's strength is linear in its features: shares of kinds of characters, repeats and lengths, and the hashed
frequencies of all its byte 3-grams. Preference pairs of a good and a bad labelled document
are fitted by the logistic loss on the difference of their features. The documents are then cut at a
quantile of the labelled documents' strengths, the one that errs least on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _labels, _text
from tideline.llm.quality_rules import _sums, surface

#: The score at which a document counts as good.
CUT = 0.3
#: Buckets of the hashed byte 3-grams.
GRAMS = 256
#: Preference pairs for each document of the rarer label.
PARTNERS = 16

_IS = {name: np.array([test(b) for b in range(256)]) for name, test in {"digit": lambda b: 0x30 <= b <= 0x39, "bang": lambda b: b in b"!?", "pipe": lambda b: b == 0x7C, "stop": lambda b: b == 0x2E, "comma": lambda b: b == 0x2C, "at": lambda b: b in b"@/\\_=+{}[]\"", "symbol": lambda b: b in b"#*$%&<>"}.items()}


def features(batch: pa.RecordBatch) -> np.ndarray:
    """One row of features for each text of a chunk; texts without words have zeros."""
    x = surface(batch)
    data, bounds = _text.utf8(batch.column("text"))
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    shares = [x["n_upper"] / np.maximum(x["n_letters"], 1), x["n_repeat_words"] / words, x["n_dup_lines"] / np.maximum(x["n_lines"], 1), 1 - x["n_letters"] / chars]
    shares += [_sums(flag[data], bounds) / words for flag in _IS.values()]
    shares = np.minimum(np.stack(shares, 1), 2.0)
    length = np.stack([np.log1p(x["n_words"]), x["word_chars"] / words / 10, x["n_lines"] / words], 1)
    return np.concatenate([shares, np.sqrt(shares), length, np.minimum(length, [3.0, 0.4, 0.1]), _grams(data, bounds)], 1) * (x["n_words"] > 0)[:, None]


def _grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The square roots of the frequencies of each text's byte 3-grams (A-Z lower-cased, digits alike), by bucket."""
    low = _text.LOWER[data] if len(data) else data
    low = np.where((low >= 0x30) & (low <= 0x39), np.uint8(0x30), low).astype(np.uint32)
    n = np.maximum(np.diff(bounds) - 2, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    code = (low[at] << np.uint32(16)) | (low[at + 1] << np.uint32(8)) | low[at + 2]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    found = np.bincount(doc * GRAMS + bucket, minlength=len(n) * GRAMS).reshape(-1, GRAMS)
    return np.sqrt(found / np.maximum(n, 1)[:, None])


class Ranker:
    """The fitted strengths: standardised features times ``weights``, moved and scaled so that the
    chosen quantile has the score ``CUT``."""

    def __init__(self, x: np.ndarray, label: np.ndarray, rounds: int = 40, ridge: float = 1e-2):
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (0.0, 1.0)
        self.weights, self.cut, self.width = np.zeros(x.shape[1]), 0.0, 1.0
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            self.cut = -1.0 if len(good) or not len(bad) else 1.0
            return
        z = ((x - self.mean) / self.scale).astype(np.float32)
        n = min(len(good), len(bad)) * PARTNERS
        draw = np.random.default_rng(0)
        gap = z[good[draw.integers(len(good), size=n)]] - z[bad[draw.integers(len(bad), size=n)]]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(gap @ self.weights, -30, 30)))
            slope = gap.T @ p / n - ridge * self.weights
            curve = (gap * (p * (1 - p))[:, None]).T @ gap / n + (ridge + 1e-6) * np.eye(len(slope))
            step = np.linalg.solve(curve, slope)
            self.weights += step / max(1.0, float(np.abs(step).max()))
        strength = z @ self.weights
        grid = np.quantile(strength, np.linspace(0.0, 1.0, 201))
        wrong = [np.mean(strength[good] < c) + np.mean(strength[bad] >= c) for c in grid]
        best = np.flatnonzero(np.isclose(wrong, min(wrong)))
        self.cut = float((grid[best[0]] + grid[best[-1]]) / 2)
        self.width = float(max(strength.std(), 1e-6))

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weights
        odds = np.clip((strength - self.cut) / self.width * 2, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, most: int = _labels.SAMPLE) -> Ranker:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            x = features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), _text.lists(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float64())], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(_labels.sample(docs, labels, "quality", most).mapInArrow(of, f"doc_id {kind}, label int, x array<double>").collect())
    x = np.array([r.x for r in rows]) if rows else np.zeros((0, 2 * (4 + len(_IS)) + 6 + GRAMS))
    return Ranker(x, np.array([r.label for r in rows]))


def score(docs: DataFrame, labels: DataFrame, most: int = _labels.SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every whole text of ``docs (doc_id, text)``.

    ``labels (doc_id, quality)`` outside the held-out fold are learned from, at most ``most`` of them; of
    several labels of a document the largest counts; nulls and other values are no labels. With labels
    of one kind only, or none, all documents get one score. Null, empty and word-less texts have all
    features zero. Repeated rows get a row each; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(features(batch)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, score double")
    return found.select("doc_id", _labels.held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
