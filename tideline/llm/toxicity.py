"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word has a word input (how much more often toxic than other labelled texts hold the word) and
character inputs (the same for the hashed character 4-grams and 5-grams of the word, its ends included;
the largest counts). Both are lower confidence bounds, so rare words say little, and the network learns
from inputs that the labels of other folds of the sample gave. It reads windows of ``WINDOW`` words that overlap by half, over the whole text; the text's score is that of
its worst window. Everything is trained with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _labels, _text
from tideline.llm._store import written

WINDOW, STEP, HIDDEN = 32, 16, 8
#: Buckets of hashed words and character n-grams, and of both in one row of partial counts.
BUCKETS, PART = 1 << 17, 1 << 11
SIZES = (4, 5)
N_INPUTS = 1 + len(SIZES)
#: Parts of the sample; the inputs of each come from the labels of the others while the network learns.
FOLDS = 4
#: Windows that the network runs over at once.
LANES = 4096


class Words:
    """The words of a chunk: hashed words, and the hashed n-grams with the range that each word has."""

    def __init__(self, batch: pa.RecordBatch):
        data, bounds = _text.utf8(batch.column("text"))
        n = len(bounds) - 1
        data = _text.LOWER[data] if len(data) else data
        padded = np.full(len(data) + n + 1, 0x20, np.uint8)
        to = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(bounds)) + 1
        padded[to] = np.where(_text.ALPHANUMERIC[data], data, 0x20)
        tokens = _text.Tokens(padded, np.append((bounds[:-1] + np.arange(n)), len(padded)), _text.ALPHANUMERIC, lower=False)
        self.count, self.first = tokens.count, tokens.first
        self.word = (tokens.hashes() >> np.uint64(47)).astype(np.int64)
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in SIZES:
            rolled = np.zeros(max(len(padded) - size + 1, 0), np.uint64)
            for j in range(size):
                rolled = (rolled << np.uint64(8)) | padded[j : len(padded) - size + 1 + j] if len(rolled) else rolled
            self.grams.append((((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int32), tokens.start - 1, tokens.end + 2 - size))


def _counted(words: Words, side: np.ndarray, sides: int) -> np.ndarray:
    """In how many texts of each side a bucket occurs: ``[side, kind, bucket]``."""
    out = np.zeros((sides, N_INPUTS, BUCKETS), np.int64)

    def add(kind: int, doc: np.ndarray, bucket: np.ndarray) -> None:
        once = np.unique(doc * BUCKETS + bucket)
        out[:, kind] += np.bincount(side[once // BUCKETS] * BUCKETS + once % BUCKETS, minlength=sides * BUCKETS).reshape(sides, BUCKETS)

    doc = np.repeat(np.arange(len(words.count)), words.count)
    add(0, doc, words.word)
    for k, (gram, low, high) in enumerate(words.grams):
        n = np.maximum(high - low, 0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        add(1 + k, np.repeat(doc, n), gram[at].astype(np.int64))
    return out


def evidence(counts: np.ndarray, sure: float = 2.0) -> np.ndarray:
    """For each kind and bucket, the lower bound of the log ratio of its rates in toxic and in other
    texts, from -1 to 4, in units of 2."""
    bad, good = counts[1] + 0.5, counts[0] + 0.5
    ratio = np.log(bad / bad.sum(1, keepdims=True)) - np.log(good / good.sum(1, keepdims=True))
    return (np.clip(ratio - sure * np.sqrt(1 / bad + 1 / good), -1, 4) / 2).astype(np.float32)


def inputs(words: Words, table: np.ndarray) -> np.ndarray:
    """``[word, input]``."""
    out = np.full((len(words.word) + 1, N_INPUTS), -0.5, np.float32)
    out[-1] = 0
    out[:-1, 0] = table[0][words.word]
    for k, (gram, low, high) in enumerate(words.grams):
        some = np.flatnonzero(high > low)
        if len(some):
            value = np.append(table[1 + k][gram], np.float32(-0.5))
            out[some, 1 + k] = np.maximum.reduceat(value, np.stack([low[some], high[some]], 1).reshape(-1))[::2]
    return out


def starts(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, first word and length of every window; the last window of a text ends with it."""
    n = np.where(count > WINDOW, 1 + -(-(count - WINDOW) // STEP), (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(at * STEP, np.maximum(count[doc] - WINDOW, 0)) + first[doc]
    return doc, at, np.minimum(count[doc], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Gates are kept as ``[3 * HIDDEN]`` in the order update, reset, new; lanes run along the last axis."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = draw.normal(0, 0.4, (3 * HIDDEN, N_INPUTS))
            self.p["U" + d] = draw.normal(0, 0.3, (3 * HIDDEN, HIDDEN))
            self.p["c" + d] = np.zeros((3 * HIDDEN, 1))
        self.p |= {"a": draw.normal(0, 0.3, (1, 2 * HIDDEN)), "o": draw.normal(0, 0.3, (1, 2 * HIDDEN)), "e": np.zeros((1, 1))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.slope, self.base = 1.0, 0.0

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """``x [time, input, lane]``, ``mask [time, lane]`` to the logit of each lane."""
        p, h, time, lanes = self.p, HIDDEN, x.shape[0], x.shape[2]
        states = np.empty((time, 2 * h, lanes), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for half, d in enumerate("fb"):
            state = np.zeros((h, lanes), np.float32)
            for t in range(time) if d == "f" else range(time - 1, -1, -1):
                a, u = p["W" + d] @ x[t] + p["c" + d], p["U" + d] @ state
                g = _sigmoid(a[: 2 * h] + u[: 2 * h])
                new = np.tanh(a[2 * h :] + g[h:] * u[2 * h :])
                after = new + g[:h] * (state - new)
                m = mask[t]
                after = after if m.all() else state + m * (after - state)
                if keep:
                    saved[d].append((t, state, g, new, u[2 * h :]))
                state = after
                states[t, half * h : half * h + h] = state
        weight = np.einsum("i,tin->tn", p["a"][0], states) + (mask - 1) * 30
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tin->in", weight, states)
        logit = (p["o"] @ pooled + p["e"])[0]
        return (logit, states, weight, pooled, saved) if keep else logit

    def gradient(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        logit, states, weight, pooled, saved = self.run(x, mask, True)
        d_logit = ((_sigmoid(logit) - label) * cost / cost.sum())[None]
        g = {"o": d_logit @ pooled.T, "e": d_logit.sum(1, keepdims=True)}
        d_pooled = p["o"].T @ d_logit
        d_weight = np.einsum("in,tin->tn", d_pooled, states)
        d_raw = weight * (d_weight - (weight * d_weight).sum(0))
        g["a"] = np.einsum("tn,tin->i", d_raw, states)[None]
        d_states = weight[:, None] * d_pooled[None] + p["a"].T[None] * d_raw[:, None]
        for half, d in enumerate("fb"):
            gw, gu, gc = (np.zeros_like(p[k + d]) for k in "WUc")
            carry = np.zeros_like(states[0, :h])
            for t, before, gate, new, u_new in reversed(saved[d]):
                total = d_states[t, half * h : half * h + h] + carry
                m = mask[t]
                into = total * m
                z, r = gate[:h], gate[h:]
                d_new = into * (1 - z) * (1 - new * new)
                d_z = into * (before - new) * z * (1 - z)
                d_r = d_new * u_new * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new])
                d_u = np.concatenate([d_z, d_r, d_new * r])
                gw += d_a @ x[t].T
                gu += d_u @ before.T
                gc += d_a.sum(1, keepdims=True)
                carry = total * (1 - m) + into * z + p["U" + d].T @ d_u
            g |= {"W" + d: gw, "U" + d: gu, "c" + d: gc}
        return g

    def train(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, steps: int = 160, lanes: int = 256, rate: float = 0.02) -> None:
        """Adam on batches that hold either label in equal parts."""
        draw = np.random.default_rng(1)
        sides = [np.flatnonzero(label == s) for s in (0, 1)]
        if not all(len(s) for s in sides):
            self.p["e"][:] = 4.0 if len(sides[1]) else -4.0
            return
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([s[draw.integers(len(s), size=lanes // 2)] for s in sides])
            g = self.gradient(x[:, :, pick], mask[:, pick], label[pick], np.ones(len(pick), np.float32))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, logit: np.ndarray, label: np.ndarray) -> None:
        """A logistic fit of the labels on the texts' logits, by Newton's method."""
        if len(set(label.tolist())) < 2:
            return
        x, w = np.stack([logit, np.ones_like(logit)], 1).astype(float), np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2)
            step = np.linalg.solve(curve, x.T @ (label - p) - 1e-2 * (w - [1.0, 0.0]))
            w += step / max(1.0, float(np.abs(step).max()))
        self.slope, self.base = float(max(w[0], 1e-3)), float(w[1])


def _lanes(x: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs ``[time, input, lane]`` and mask of windows."""
    time = np.arange(WINDOW)[:, None]
    inside = time < length
    rows = np.where(inside, at + time, len(x) - 1)
    return np.ascontiguousarray(x[rows].transpose(0, 2, 1)), inside.astype(np.float32)


def logits(network: Network, table: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """The largest logit of all windows of each text; a text without words has the network's base."""
    words = Words(batch)
    x = inputs(words, table)
    doc, at, length = starts(words.count, words.first)
    out = np.full(len(words.count), -np.inf, np.float32)
    for i in range(0, len(doc), LANES):
        part = slice(i, i + LANES)
        np.maximum.at(out, doc[part], network.run(*_lanes(x, at[part], length[part])))
    out[words.count == 0] = network.p["e"][0, 0] - 4.0
    return out


def _fit(rows: DataFrame) -> tuple[np.ndarray, Network]:
    """``rows (doc_id, text, label)`` is the bounded sample."""

    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * FOLDS, N_INPUTS, BUCKETS), np.int64)
        for batch in _text.chunks(batches):
            total += _counted(Words(batch), batch.column("fold").to_numpy() * 2 + batch.column("label").to_numpy(), 2 * FOLDS)
        parts = total.reshape(-1, PART)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), _text.lists(parts[used].reshape(-1), np.full(len(used), PART))], ["part", "counts"])

    total = np.zeros((2 * FOLDS * N_INPUTS * BUCKETS // PART, PART), np.int64)
    for r in rows.mapInArrow(count, "part long, counts array<long>").toLocalIterator():
        total[r[0]] += np.array(r[1])
    total = total.reshape(FOLDS, 2, N_INPUTS, BUCKETS)
    table = evidence(total.sum(0))
    others = [evidence(total.sum(0) - total[f]) for f in range(FOLDS)]
    sent = rows.sparkSession.sparkContext.broadcast(others)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            words = Words(batch)
            fold = np.repeat(batch.column("fold").to_numpy(), words.count)
            every = [inputs(words, t) for t in sent.value]
            x = np.concatenate([np.stack(every, 1)[np.arange(len(fold)), fold], every[0][-1:]])
            doc, at, length = starts(words.count, words.first)
            sums = np.concatenate([[0.0], np.cumsum(np.maximum(x[:-1], 0).sum(1))])
            told = sums[at + length] - sums[at]
            order = np.lexsort((at, -told, doc))
            rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
            best = order[rank < 2]
            x_best, mask = _lanes(x, at[best], length[best])
            flat = x_best.transpose(2, 0, 1).reshape(len(best), -1)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(doc[best])) for c in ("doc_id", "label")] + [pa.array(rank[rank < 2], pa.int32()), pa.array(length[best], pa.int32()), _text.lists(flat.reshape(-1), np.full(len(best), WINDOW * N_INPUTS), pa.float32())], ["doc_id", "label", "rank", "length", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(pick, f"doc_id {kind}, label int, rank int, length int, x array<float>").toPandas().sort_values(["doc_id", "rank"])
    network = Network()
    if not len(found):
        return table, network
    x = np.ascontiguousarray(np.stack(found.x.to_numpy()).reshape(-1, WINDOW, N_INPUTS).transpose(1, 2, 0)).astype(np.float32)
    mask = (np.arange(WINDOW)[:, None] < found.length.to_numpy()).astype(np.float32)
    label = found.label.to_numpy().astype(np.float32)
    use = (label == 0) | (found["rank"].to_numpy() == 0)
    network.train(x[:, :, use], mask[:, use], label[use])
    logit = np.concatenate([network.run(x[:, :, i : i + LANES], mask[:, i : i + LANES]) for i in range(0, len(label), LANES)])
    worst = found.assign(logit=logit).groupby("doc_id").agg(logit=("logit", "max"), label=("label", "first"))
    network.calibrate(worst.logit.to_numpy(), worst.label.to_numpy())
    return table, network


def score(docs: DataFrame, labels: DataFrame, most: int = _labels.SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every whole text of ``docs (doc_id, text)``.

    ``labels (doc_id, toxic)`` outside the held-out fold are learned from, at most ``most`` of them; of
    several labels of a document the largest counts; nulls and other values are no labels. Without
    toxic labels all scores are low. Null, empty and word-less texts get the low score of no window.
    Repeated rows get a row each; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(_fit(written(_labels.sample(docs, labels, "toxic", most), "toxic-sample")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = model.value
        for batch in _text.chunks(batches):
            odds = np.clip(logits(network, table, batch).astype(float) * network.slope + network.base, -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, score double")
    return found.select("doc_id", _labels.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
