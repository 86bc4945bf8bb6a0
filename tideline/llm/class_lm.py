"""Language-model scores by class-based bigrams.

Words are counted over all training texts. Exchange clustering assigns words to classes: each word in turn
moves to the class that raises the likelihood of the class bigrams most. The most frequent words are exchanged
with each other until none moves; then every other word that comes ``LEAST`` times or more (up to ``HEAD`` words)
is exchanged against their classes, from the counts of the classes that it comes after and before, in
distributed passes. Only rarer words, whose neighbours tell too little, belong to classes by their form (how
they end, and whether they are ASCII), and the end of a text is a class of its own. A text's probability is
the product of p(class | class before) and p(word | class), both smoothed.

Counts of the frequent words are sent to the executors; their number has a fixed bound. Counts of all
others stay in a table that the scored texts' rare words are joined with, so every count is exact at
any size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text
from tideline.llm._labels import held_out
from tideline.llm._store import written

#: Words that are exchanged with each other, classes that words go to, and words that are clustered and whose counts
#: are sent out, at most; the times that a clustered word comes at least.
CORE, CLASSES, HEAD, LEAST = 2048, 64, 1 << 19, 20
#: Classes by form, and the class of the end.
FORMS = 6
END = CLASSES + FORMS
#: Added to each count of a word, and weight of a class's own share in its transitions.
ADDED, PULL = 0.1, 50.0
#: Words whose counts a task gathers before it passes them on.
GATHERED = 4_000_000
_SIDE = CORE + FORMS + 1
_ROWS = 64


class Words:
    """Hashes and forms of the lower-cased words of a chunk."""

    def __init__(self, batch: pa.RecordBatch):
        tokens = _text.Tokens(*_text.utf8(batch.column("text")), _text.NOT_SPACE)
        self.hash, self.count, self.first = tokens.hashes(), tokens.count, tokens.first
        last = tokens.data[tokens.end - 1] if len(tokens.end) else np.zeros(0, np.uint8)
        wide = np.concatenate([[0], np.cumsum(tokens.data >= 0x80)])
        self.form = np.where(last == 0x2E, 0, np.where(last == 0x2C, 1, 2)) + 3 * (wide[tokens.end] > wide[tokens.start])


def word_counts(texts: DataFrame) -> DataFrame:
    """``(hash, form, n)`` of every distinct word of ``texts (text)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[Words] = []

        def told() -> pa.RecordBatch:
            hashes, form = np.concatenate([w.hash for w in kept]), np.concatenate([w.form for w in kept])
            found, at, n = np.unique(hashes, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(form[at], pa.int32()), pa.array(n, pa.int64())], ["hash", "form", "n"])

        for batch in _text.chunks(batches):
            kept.append(Words(batch))
            if sum(len(w.hash) for w in kept) > GATHERED:
                yield told()
                kept = []
        if kept:
            yield told()

    return texts.select("text").mapInArrow(of, "hash long, form int, n long").groupBy("hash", "form").agg(F.sum("n").alias("n"))


class Head:
    """Counts of the frequent words, most frequent first, found by hash without a search of all."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        rank = np.lexsort((hashes, -n))
        core = np.full(len(n), -1, np.int32)
        core[rank[:CORE]] = np.arange(min(CORE, len(n)))
        order = np.argsort(hashes)
        self.hash, self.n, self.core = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(n[order], 0), np.append(core[order], -1)
        #: The class of each word, once it has one.
        self.label = np.full(len(self.n), -1, np.int32)
        self.start = np.searchsorted(self.hash[:-1], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = self.start[(hashes >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        low = np.flatnonzero(self.hash[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[self.hash[at[low]] < hashes[low]]
        return np.where((self.hash[at] == hashes) & (at < len(self.hash) - 1), at, -1)


def _sequence(unit: np.ndarray, w: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All words' units with ``end`` after each text: the one before, and the one itself."""
    text_ends = w.first[1:] + np.arange(1, len(w.first))
    own = np.full(len(unit) + len(w.count), end, np.int64)
    inside = np.ones(len(own), bool)
    inside[text_ends - 1] = False
    own[inside] = unit
    before = np.concatenate([[end], own[:-1]]) if len(own) else own
    return before, own


def _bigrams(texts: DataFrame, head) -> np.ndarray:
    """Counts ``[before, word]`` among core words, forms and the end: a matrix of fixed size."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIDE * _SIDE, np.int32)
        for batch in _text.chunks(batches):
            w = Words(batch)
            core = head.value.core[head.value.find(w.hash)]
            before, own = _sequence(np.where(core >= 0, core, CORE + w.form), w, _SIDE - 1)
            pairs, n = np.unique(before * _SIDE + own, return_counts=True)
            total[pairs] += n.astype(np.int32)
        for block in range(0, _SIDE, _ROWS):
            part = total[block * _SIDE : (block + _ROWS) * _SIDE]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _text.lists(at.astype(np.int32), np.array([len(at)]), pa.int32()), _text.lists(part[at].astype(np.int64), np.array([len(at)]))], ["block", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                sums = total.setdefault(block, np.zeros(_ROWS * _SIDE, np.int64))
                sums[batch.column("at")[i].values.to_numpy()] += batch.column("n")[i].values.to_numpy()
        for block, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _text.lists(at.astype(np.int32), np.array([len(at)]), pa.int32()), _text.lists(sums[at], np.array([len(at)]))], ["block", "at", "n"])

    kind = "block int, at array<int>, n array<long>"
    out = np.zeros(_SIDE * _SIDE, np.float64)
    for row in texts.select("text").mapInArrow(of, kind).repartition(F.col("block")).mapInArrow(add, kind).toArrow().to_batches():
        for i, block in enumerate(row.column("block").to_pylist()):
            out[block * _SIDE + row.column("at")[i].values.to_numpy()] = row.column("n")[i].values.to_numpy()
    return out.reshape(_SIDE, _SIDE)


def _contexts(texts: DataFrame, head) -> DataFrame:
    """``(row, label)``: the class of each word of the head that comes ``LEAST`` times and is not in the core, by its
    neighbours' classes. ``head`` holds a `Head` with the core's labels and the core's class counts ``joint``."""
    k = CLASSES + FORMS + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, _ = head.value
        kept, size = [], 0

        def told() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(kept), return_counts=True)
            row = pairs // (2 * k)
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), row[1:] != row[:-1]]))
            each = np.diff(np.append(new, len(row)))
            return pa.RecordBatch.from_arrays([pa.array(row[new].astype(np.int32)), _text.lists((pairs % (2 * k)).astype(np.int32), each, pa.int32()), _text.lists(n.astype(np.int32), each, pa.int32())], ["row", "at", "n"])

        for batch in _text.chunks(batches):
            w = Words(batch)
            row = h.find(w.hash)
            unit = np.where(h.label[row] >= 0, h.label[row], CLASSES + w.form)
            before, own = _sequence(unit, w, k - 1)
            _, rows = _sequence(np.where((row >= 0) & (h.core[row] < 0) & (h.n[row] >= LEAST), row, -1), w, -1)
            at = np.flatnonzero(rows >= 0)  # a word is never last: the text's end follows
            kept += [rows[at] * (2 * k) + before[at], rows[at] * (2 * k) + k + own[at + 1]]
            size += 2 * len(at)
            if size > GATHERED:
                yield told()
                kept, size = [], 0
        if size:
            yield told()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, joint = head.value
        out, into = joint[:CLASSES] + ADDED, joint[:, :CLASSES].T + ADDED
        # log of the share that each neighbour has among those of a class's words, on either side
        tells = np.concatenate([np.log(into / into.sum(1, keepdims=True)), np.log(out / out.sum(1, keepdims=True))], 1)
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in enumerate(batch.column("row").to_pylist()):
                sums = total.setdefault(row, np.zeros(2 * k))
                sums[batch.column("at")[i].values.to_numpy()] += batch.column("n")[i].values.to_numpy()
            if len(total) > 1:  # rows come in order: all but the last are whole
                done = list(total)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array(np.argmax(np.stack([total.pop(r) for r in done]) @ tells.T, 1).astype(np.int32))], ["row", "label"])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(np.argmax(np.stack(list(total.values())) @ tells.T, 1).astype(np.int32))], ["row", "label"])

    met = texts.select("text").mapInArrow(of, "row int, at array<int>, n array<int>")
    return met.repartition("row").sortWithinPartitions("row").mapInArrow(best, "row int, label int")


def _class_bigrams(texts: DataFrame, head) -> np.ndarray:
    """Counts ``[before, class]`` among classes, forms and the end: a small matrix of fixed size."""
    k = CLASSES + FORMS + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in _text.chunks(batches):
            w = Words(batch)
            label = head.value.label[head.value.find(w.hash)]
            before, own = _sequence(np.where(label >= 0, label, CLASSES + w.form), w, k - 1)
            total += np.bincount(before * k + own, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(k * k)
    for r in texts.select("text").mapInArrow(of, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = 3) -> np.ndarray:
    """The class of each of the first ``words`` units; the other units keep classes of their own.

    Starts from the ranks modulo ``classes``. In each sweep every word leaves its class and joins the
    one with the largest sum of N(c, d) log N(c, d) less N(c) log N(c) over rows and columns."""
    fixed = bigrams.shape[0] - CORE
    label = np.concatenate([np.arange(CORE) % classes, classes + np.arange(fixed)])
    k = classes + fixed
    joint = np.zeros((k, k))
    np.add.at(joint, (label[:, None].repeat(len(label), 1), label[None].repeat(len(label), 0)), bigrams)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            row, column = np.bincount(label, bigrams[w], k), np.bincount(label, bigrams[:, w], k)
            own, was = bigrams[w, w], label[w]
            row[was] -= own
            column[was] -= own
            joint[was] -= row
            joint[:, was] -= column
            joint[was, was] -= own
            out, into = joint[:classes], joint[:, :classes].T
            gain = (_xlogx(out + row) - _xlogx(out)).sum(1) + (_xlogx(into + column) - _xlogx(into)).sum(1)
            for total, more in ((joint.sum(1)[:classes], row.sum() + own), (joint.sum(0)[:classes], column.sum() + own)):
                gain -= _xlogx(total + more) - _xlogx(total)
            best = int(np.argmax(gain))
            joint[best] += row
            joint[:, best] += column
            joint[best, best] += own
            label[w] = best
            moved += best != was
        if not moved:
            break
    return label[:CORE]


class Model:
    """The head with its labels, and the class model: ``joint`` counts of classes in a row, and by form the occurrences
    and kinds of the words that have no class."""

    def __init__(self, head: Head, joint: np.ndarray, forms: np.ndarray, words: int, texts: int, distinct: int):
        self.head, self.tokens, self.distinct, self.texts = head, words + texts, distinct + (texts > 0), texts
        k = CLASSES + FORMS + 1
        share = (joint.sum(0) + 1) / (joint.sum() + k)
        self.step = np.log10((joint + PULL * share) / (joint.sum(1, keepdims=True) + PULL))
        has = head.label >= 0
        self.class_mass = np.log10(np.maximum(np.bincount(head.label[has], head.n[has], CLASSES), 1.0))
        left, kinds = forms[:, 0].astype(float), forms[:, 1].astype(float)
        self.form_mass = np.log10(left + ADDED * (kinds + 1))
        self.base_mass = float(np.log10(self.tokens + ADDED * (self.distinct + 1)))


def _train(texts: DataFrame) -> tuple[Model, DataFrame]:
    spark = texts.sparkSession
    counts = written(word_counts(texts), "words")
    n_texts = texts.count()
    size = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect(), reverse=True)
    least, held = None, 0
    for r in sizes:
        if held + r.words > HEAD:
            break
        least, held = r.size, held + r.words
    found = counts.where(size >= F.lit(least if least is not None else 1 << 30)).select("hash", "n").toArrow()
    head = Head(found.column("hash").to_numpy().view(np.uint64), found.column("n").to_numpy())
    core = head.core >= 0
    bigrams = _bigrams(texts, spark.sparkContext.broadcast(head))
    label = exchange(bigrams, int(core.sum()))
    head.label[core] = label[head.core[core]]
    unit = np.concatenate([label, CLASSES + np.arange(FORMS + 1)])
    joint = np.zeros((CLASSES + FORMS + 1,) * 2)
    np.add.at(joint, (unit[:, None].repeat(_SIDE, 1), unit[None].repeat(_SIDE, 0)), bigrams)
    # at most HEAD small rows come back
    placed = _contexts(texts, spark.sparkContext.broadcast((head, joint))).toArrow()
    if placed.num_rows:
        head.label[placed.column("row").to_numpy()] = placed.column("label").to_numpy()
        joint = _class_bigrams(texts, spark.sparkContext.broadcast(head))
    classed = spark.createDataFrame(pa.table({"hash": head.hash[:-1][head.label[:-1] >= 0].view(np.int64)})) if len(head.n) > 1 else counts.select("hash").limit(0)
    outside = counts.join(F.broadcast(classed), "hash", "left_anti").groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    forms = np.zeros((FORMS, 2), np.int64)
    for r in outside:
        forms[r.form] = r.n, r.kinds
    return Model(head, joint, forms, sum(r.tokens for r in sizes), n_texts, sum(r.words for r in sizes)), counts


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every whole text of
    ``docs (doc_id, text)``; the rows whose crc32 of the id is 0 mod ``folds`` are not learned from.

    Null and empty texts are the end alone. Words that no training text has are unknown and get the
    share of one more word of their form. ``base_score`` is the smoothed unigram log10 probability,
    ``score`` that of the class model. Without training texts all words are unknown. Repeated rows get a
    row each; rows without an id are learned from; other columns are ignored.
    """
    texts = docs.where(~held_out(folds)).select("text")
    model, counts = _train(texts)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "n_known", "base", "score", "rare", "times"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in _text.chunks(batches):
            w = Words(batch)
            row = m.head.find(w.hash)
            n, label = m.head.n[row], m.head.label[row]
            before, own = _sequence(np.where(label >= 0, label, CLASSES + w.form), w, END)
            ends = np.concatenate([[0], w.first[1:] + np.arange(1, len(w.first))])
            add = lambda x, to: (s := np.concatenate([[0.0], np.cumsum(x)]))[to[1:]] - s[to[:-1]]
            base = np.where(row >= 0, np.log10(np.maximum(n, 1) + ADDED), 0.0)
            word = np.where(label >= 0, np.log10(np.maximum(n, 1)) - m.class_mass[label], base - m.form_mass[w.form])
            last = np.log10(m.texts + ADDED) if m.texts else np.log10(ADDED)
            doc = np.repeat(np.arange(len(w.count)), w.count)
            rare = np.flatnonzero(row < 0)
            order = rare[np.lexsort((w.hash[rare], doc[rare]))]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (np.diff(doc[order]) != 0) | (w.hash[order][1:] != w.hash[order][:-1])]))
            times = np.diff(np.append(new, len(order)))
            each = np.bincount(doc[order[new]], minlength=len(w.count))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(np.round(add(row >= 0, w.first)).astype(np.int64) + (m.texts > 0))]
                + [pa.array(add(base, w.first) + last - (w.count + 1) * m.base_mass), pa.array(add(m.step[before, own], ends) + add(word, w.first))]
                + [_text.lists(w.hash[order[new]].view(np.int64), each), _text.lists(times.astype(np.int64), each)],
                names,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n_words long, n_known long, base double, score double, rare array<long>, times array<long>")
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), "x.times")
    n = F.coalesce("n", F.lit(0))
    rest = rare.join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(F.sum("times").alias("_t"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10(n + ADDED)).alias("_log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id",
        held_out(folds).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + zero("_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_log")).alias("base_score"),
        (F.col("score") + zero("_log")).alias("score"),
    )
