"""Near-duplicate documents by bottom-k sketches (MinHash with one hash function).

1. Each document's set of word shingles is hashed once; its ``k`` smallest hashes are its sketch.
   Documents with the same whole set form one class, and one of each class goes on.
2. Inverted lists of the retained values generate overlaps. Two similar documents share at least
   ``least_share`` of the longer sketch, so each document is listed only under its rarest values:
   the first ``size - least + 1`` by the number of sketches that hold them. Values that one sketch
   alone holds need no list. A passage common to many documents thus makes no list of its own
   unless most of a document is that passage.
   Each list is held against its hub first, the member whose values most others hold; what stays apart
   from the hub's component then meets in blocks.
3. Candidates whose estimate on the sketch of the union is far below the threshold go.
4. The rest are held against each other by the Jaccard coefficient of their full sets.

With 48 values and a similarity of 0.75 a pair shares 36 +- 3 values. It is listed together if it shares 21, and
goes on if the estimate is 0.5 or more: the chance to miss a pair exactly at the threshold is about 5 in 100,000
(24 or fewer of 48 draws at 0.75), much less above it. Sets of at most 48 shingles are exact, and so is any set with
``k`` at least as large; ``margin`` and ``least_share`` move the two bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text
from tideline.llm._graph import similar_components
from tideline.llm._store import discard, written

#: Members of a hub's group that one task verifies together.
GROUP = 512
#: Members on either side of a block of a mixed group.
MINOR, ALL = 256, 1024
#: How far below the threshold the estimate from a sketch may lie: four standard deviations at 48 values.
MARGIN = 0.25
#: Flipped in the hashes of a sketch, so that Spark's signed order is the order they were chosen in.
TOP = np.uint64(1 << 63)


def _text_hash() -> Column:
    """Tells the texts of one id apart, as ids may repeat."""
    return F.xxhash64("text").alias("text_hash")


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    tokens = _text.Tokens(*_text.utf8(batch.column("text")), _text.NOT_SPACE)
    hashes, to = _text.windows(tokens.hashes(), tokens.count, tokens.first, width)
    out = []
    for a, b in zip(to[:-1], to[1:]):
        x = np.sort(hashes[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a + 1 else x)
    return out


def sketches(docs: DataFrame, k: int = 48, width: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, text_hash, n_shingles, set_a, set_b, sketch)``: the size of each document's shingle set, a
    128-bit fingerprint of the set, and its ``k`` smallest hashes (as signed numbers of the same order). Null text has the
    empty set."""
    carry = (*carry, "text_hash")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            found = _sets(batch, width)
            size = np.array([len(x) for x in found])
            every = np.concatenate(found) if found else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(every ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            kept = [x[:k] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *carry)]
                + [pa.array(size, pa.int64())]
                + [pa.array((s[ends[1:]] - s[ends[:-1]]).view(np.int64)) for s in sums]
                + [_text.lists((np.concatenate(kept) ^ TOP).view(np.int64), np.minimum(size, k))],
                ["doc_id", *carry, "n_shingles", "set_a", "set_b", "sketch"],
            )

    own = docs.select("doc_id", *carry[:-1], _text_hash(), "text")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    return own.mapInArrow(of, f"{kinds}, n_shingles long, set_a long, set_b long, sketch array<long>")


def _listed(classes: DataFrame, least_share: float) -> DataFrame:
    """``(key, id, score)``: each class under the values by which it must meet any similar one. The
    score grows with the number of classes that hold its values."""
    values = classes.select("id", F.explode("sketch").alias("key"))
    shared = values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = values.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"), F.sum("df").alias("score"))
    size, alone = F.size("sketch"), F.size("sketch") - F.size("shared")
    least = F.greatest(F.lit(1), F.floor(size * least_share).cast("int"))
    first = F.greatest(F.lit(0), size - least + 1 - alone)
    return classes.join(own, "id").select("id", "score", F.explode(F.slice("shared", F.lit(1), first)).alias("x")).select(F.col("x.key").alias("key"), "id", "score")


def _estimate(x, y, k: int):
    """The share of the union's ``k`` smallest values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union)


def _verifier(texts: DataFrame, width: int, percent: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in _text.chunks(batches):
            a, b, salt = (batch.column(c).to_pylist() for c in ("a", "b", "salt"))
            links = []
            for i, x in enumerate(_sets(batch, width)):
                if a[i] == b[i]:
                    hub, own = (b[i], salt[i]), x
                elif hub == (b[i], salt[i]):
                    both = np.concatenate([own, x])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= percent * (len(both) - same):
                        links.append((a[i], b[i]))
                else:
                    raise RuntimeError("a candidate came before its hub")
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        """Candidates that share ``b`` meet in groups of about ``GROUP``, each with a copy of b's
        text, so a hub of any degree is spread over as many tasks as it needs."""
        hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
        spread = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
        others = spread.join(texts.withColumnRenamed("id", "a"), "a").select("a", "b", "salt", "text", F.lit(1).alias("turn"))
        own = hubs.join(texts.withColumnRenamed("id", "b"), "b").select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text", F.lit(0).alias("turn"))
        met = own.unionByName(others).repartition("b", "salt").sortWithinPartitions("b", "salt", "turn", "a")
        return met.select("a", "b", "salt", "text").mapInArrow(exact, "a long, b long")

    return verify


class _Block:
    """The members of a block that are not in the hub's component, with inverted lists of their
    retained values, and what has been found to be connected so far."""

    def __init__(self):
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.parts: list[int] = []
        self.lists: dict[int, list[int]] = {}
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def add(self, i: int, part: int, x: np.ndarray, k: int) -> None:
        for v in x[:k].tolist():
            self.lists.setdefault(v, []).append(len(self.ids))
        self.ids.append(i)
        self.sets.append(x)
        self.parts.append(part)

    def meet(self, i: int, part: int, x: np.ndarray, k: int, percent: int, margin: float) -> Iterator[tuple[int, int]]:
        found = [m for v in x[:k].tolist() for m in self.lists.get(v, ())]
        if not found:
            return
        overlap = np.bincount(found)
        for m in np.flatnonzero(overlap):
            y = self.sets[m]
            few, many = sorted((len(x), len(y)))
            if 100 * few < percent * many or overlap[m] < (percent / 100 - margin) * min(k, few) or self.root(part) == self.root(self.parts[m]):
                continue
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            if 100 * same >= percent * (len(both) - same):
                a, b = sorted((self.root(part), self.root(self.parts[m])))
                self.up[b] = a
                yield i, self.ids[m]


def _crosser(texts: DataFrame, width: int, percent: int, k: int, margin: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block()
        for batch in _text.chunks(batches):
            hub, i, j, role, ids, part = (batch.column(c).to_pylist() for c in ("hub", "i", "j", "role", "id", "component"))
            links = []
            for n, x in enumerate(_sets(batch, width)):
                if at != (hub[n], i[n], j[n]):
                    at, block = (hub[n], i[n], j[n]), _Block()
                if role[n] == 0:
                    block.add(ids[n], part[n], x, k)
                else:
                    links += block.meet(ids[n], part[n], x, k, percent, margin)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    def cross(groups: DataFrame) -> DataFrame:
        """Blocks of the members outside the hub's component meet blocks of all members; only links
        that join what the block has not joined yet leave it."""
        sized = groups.select("hub", "id", "component", "minor", F.ceil(F.col("n_minor") / MINOR).cast("int").alias("ni"), F.ceil(F.col("n_all") / ALL).cast("int").alias("nj"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        left = sized.where("minor").select("hub", own("ni").alias("i"), spread("nj").alias("j"), F.lit(0).alias("role"), "id", "component")
        right = sized.select("hub", spread("ni").alias("i"), own("nj").alias("j"), F.lit(1).alias("role"), "id", "component")
        met = left.unionByName(right).join(texts, "id").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "role", "id")
        return met.select("hub", "i", "j", "role", "id", "component", "text").mapInArrow(of, "a long, b long")

    return cross


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, k: int = 48, least_share: float = 0.45, margin: float = MARGIN, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, n_shingles, class_id, component_id, kept)`` for every row of ``docs (doc_id, text)``; ``carry``
    names columns that go along.

    Documents link if 100 * |intersection| >= ``percent`` * |union| of their sets of ``width``-word
    shingles. ``component_id`` is the smallest doc_id that can be reached, ``class_id`` the smallest
    with the very same set. Null, empty and word-less texts have no shingles, link with nothing and
    are kept. A text of fewer words has one shingle, all of them.

    Every row is judged by its own text: ids of any type may repeat or be null. Rows of one id with different texts are in
    the components of these texts, and ``kept`` says whether a row's id is the smallest of its component, so all rows of the id
    that stays, do. Nulls are larger than any id; rows of a component without any id all stay. Other columns of ``docs`` are
    ignored; an empty table gives an empty result. The thresholds hold at any size; nothing is capped.
    """
    found = written(sketches(docs, k, width, carry), "sketches")
    some = found.where("n_shingles > 0")
    same = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = written(same.withColumn("id", F.monotonically_increasing_id()), "classes")
    listed = written(_listed(classes.select("id", "sketch"), least_share), "lists")
    # one text of each class that is listed
    reps = classes.join(listed.select("id").distinct(), "id").select("id", F.col("at.doc_id").alias("_doc"), F.col("at.text_hash").alias("_hash"))
    own = docs.select("doc_id", _text_hash(), "text").join(reps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    texts = written(own.select("id", "text").dropDuplicates(["id"]), "texts")

    def near(stars: DataFrame) -> DataFrame:
        x, y = (classes.select(F.col("id").alias(i), F.col("n_shingles").alias(f"n_{i}"), F.col("sketch").alias(f"sketch_{i}")) for i in ("id", "hub"))
        met = stars.join(x, "id").join(y, "hub")
        few, many = F.least("n_id", "n_hub"), F.greatest("n_id", "n_hub")
        return met.select("id", "hub", ((100 * few >= percent * many) & (_estimate(F.col("sketch_id"), F.col("sketch_hub"), k) >= percent / 100 - margin)).alias("near"))

    parts = similar_components(listed, near, _verifier(texts, width, percent), _crosser(texts, width, percent, k, margin))
    discard(texts)
    placed = classes.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    roots = placed.join(least, "component").select("set_a", "set_b", "n_shingles", "class_id", "component_id")
    placed = some.select("doc_id", *carry, "n_shingles", "set_a", "set_b").join(roots, ["set_a", "set_b", "n_shingles"]).select("doc_id", *carry, "n_shingles", "class_id", "component_id")
    alone = found.where("n_shingles = 0").select("doc_id", *carry, "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    result = written(placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates")
    discard(found, classes, parts)
    return result
