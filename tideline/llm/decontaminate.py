"""Benchmark passages in documents by a positional inverted index.

The index is a stored table, partitioned by document: each of its rows is a shard of a few hundred documents
with the postings of every term in them (``terms`` sorted, ``positions`` of ``terms[i]`` from ``bounds[i]`` to
``bounds[i + 1]``). It is written once and searched as often as needed. A search sends the windows of the
benchmark to all shards. Each window starts from the postings of its rarest term in the shard, moved by the
term's place in the window, and is intersected with the moved postings of the other terms, in order of
rarity. Shards never exchange anything, so a passage that a third of all documents share is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text
from tideline.llm._store import discard, written

#: Bytes of benchmark text sent to the executors at once (about three times as much in memory); a larger
#: benchmark is searched for in blocks.
BLOCK_BYTES = 8_000_000
#: Candidate places held at once.
CANDIDATES = 1_000_000
#: Places left free between documents, and so the most slack of a proximity match.
GAP = 16


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs (doc_id, text)``; null text has no words, ids may be null or repeated. Every row of
    ``docs`` has a place in one shard."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches):
            tokens = _text.Tokens(*_text.utf8(batch.column("text")), _text.ALPHANUMERIC)
            hashes = tokens.hashes()
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
            places = (order + GAP * tokens.doc[order]).astype(np.int32)
            columns = [tokens.count.astype(np.int32), ranked[new].view(np.int64), np.append(new, len(ranked)).astype(np.int32), places]
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)] + [_text.lists(c, np.array([len(c)]), pa.from_numpy_dtype(c.dtype)) for c in columns],
                ["doc_ids", "n_words", "terms", "bounds", "positions"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_ids array<{kind}>, n_words array<int>, terms array<long>, bounds array<int>, positions array<int>")


class Phrases:
    """The distinct windows of some items, by length, and the items of each. Windows are places in the items'
    words, so the whole takes a few numbers a word."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        tokens = _text.Tokens(*_text.utf8(pa.array([t or "" for _, t in items], pa.large_string())), _text.ALPHANUMERIC)
        self.terms, place = np.unique(tokens.hashes(), return_inverse=True)
        self.words = place.astype(np.int32)
        self.items = [str(i) for i, _ in items]
        #: For each length: where distinct windows start in ``words``, the items of each, and where these begin.
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.minimum(tokens.count, width)
        for n in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == n)
            count = tokens.count[own] - n + 1
            item, at = _expand(tokens.first[own], count)
            rolled = np.zeros(len(at), np.uint64)
            for j in range(n):
                rolled = _text.mix(rolled * np.uint64(3) + self.words[at + j].astype(np.uint64) + np.uint64(j))
            order = np.lexsort((own[item], rolled))
            rolled, at, item = rolled[order], at[order], own[item][order]
            first = np.concatenate([np.ones(min(1, len(at)), bool), rolled[1:] != rolled[:-1]])
            fresh = first.copy()
            fresh[1:] |= item[1:] != item[:-1]
            bounds = np.append(np.flatnonzero(first[fresh]), fresh.sum())
            self.groups.append((n, at[first].astype(np.int32), item[fresh].astype(np.int32), bounds.astype(np.int64)))


def _expand(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``low[i] .. low[i] + count[i]``: i, and each number of the ranges."""
    of = np.repeat(np.arange(len(low)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict[str, pa.Array]):
        self.doc_ids = row["doc_ids"]
        self.n_words, self.bounds, self.positions = (row[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_words", "bounds", "positions"))
        self.terms = row["terms"].to_numpy(zero_copy_only=False).view(np.uint64)
        self.first = np.cumsum(self.n_words + GAP) - self.n_words - GAP
        self.total = int((self.n_words + GAP).sum())
        #: Postings of all terms as one sorted list: the term, then the place.
        self.step = self.total + 2 * GAP + 2
        self.postings = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds)) * self.step + self.positions + GAP

    def holds(self, term: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """Whether the posting list of ``term`` has a position within ``slack`` of ``place``."""
        low = np.maximum(place + GAP - slack, 0) + term * self.step
        at = np.minimum(np.searchsorted(self.postings, low), len(self.postings) - 1)
        return (self.postings[at] >= low) & (self.postings[at] <= np.maximum(place + GAP + slack, 0) + term * self.step)

    def search(self, phrases: Phrases, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``doc, start, end, item`` of every match, in places of the shard and rows of the phrases."""
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        if not len(self.terms):
            return out[0]
        at = np.minimum(np.searchsorted(self.terms, phrases.terms), len(self.terms) - 1)
        known = np.where(self.terms[at] == phrases.terms, at, -1)[phrases.words]
        length = np.diff(self.bounds)
        for n, starts, owners, owner_bounds in phrases.groups:
            which = np.arange(len(starts))
            for j in range(n):
                which = which[known[starts[which] + j] >= 0]
            mine = known[starts[which][:, None] + np.arange(n)]
            order = np.argsort(length[mine], axis=1, kind="stable")
            rare = mine[np.arange(len(mine)), order[:, 0]] if len(mine) else np.zeros(0, np.int64)
            cost = np.cumsum(length[rare])
            a = 0
            while a < len(mine):
                b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CANDIDATES, "right")))
                of, post = _expand(self.bounds[rare[a:b]], length[rare[a:b]])
                of += a
                start = self.positions[post] - order[of, 0]
                for j in range(1, n):
                    place = order[of, j]
                    keep = self.holds(mine[of, place], start + place, slack)
                    of, start = of[keep], start[keep]
                # with slack a match may begin up to that before its document; between documents are GAP places
                doc = np.searchsorted(self.first, start + slack, "right") - 1
                of = which[of]
                i, own = _expand(owner_bounds[of], np.diff(owner_bounds)[of])
                out.append((doc[i], start[i], start[i] + n, owners[own].astype(np.int64)))
                a = b
        return tuple(np.concatenate(x) for x in zip(*out))


def _rows(index: DataFrame, phrases: Phrases, schema: str, make) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                yield make(row.get("shard"), Shard({n: v.values for n, v in row.items() if n != "shard"}), sent.value)

    return index.mapInArrow(of, schema)


def _kind(index: DataFrame) -> str:
    return index.schema["doc_ids"].dataType.elementType.simpleString()


def matches(index: DataFrame, phrases: Phrases, slack: int = 0) -> DataFrame:
    """``(doc_id, item_id, start, end)``: exact phrase matches, or with ``slack`` (``GAP`` at most) proximity
    matches, in which every word lies within ``slack`` words of its place in the phrase. ``start`` is the
    place, in words of the document, that the rarest word gives (with slack it may lie up to that before 0, or
    ``end`` past the last word). Rows of one id each give their own matches; an empty index or no phrases
    give none."""
    if not 0 <= slack <= GAP:
        raise ValueError(f"slack must be from 0 to {GAP}")

    def make(_, shard: Shard, p: Phrases) -> pa.RecordBatch:
        doc, start, end, item = shard.search(p, slack)
        base = shard.first[doc]
        return pa.RecordBatch.from_arrays([shard.doc_ids.take(pa.array(doc)), pa.array([p.items[x] for x in item], pa.string()), pa.array(start - base), pa.array(end - base)], ["doc_id", "item_id", "start", "end"])

    return _rows(index, phrases, f"doc_id {_kind(index)}, item_id string, start long, end long", make)


def _items(doc: np.ndarray, item: np.ndarray, n: int, names: list[str]) -> pa.Array:
    found: list[set] = [set() for _ in range(n)]
    for d, i in set(zip(doc.tolist(), item.tolist())):
        found[d].add(names[i])
    return pa.array([sorted(x) for x in found], pa.list_(pa.string()))


def _summary(index: DataFrame, phrases: Phrases, slack: int) -> DataFrame:
    def make(number: pa.Scalar, shard: Shard, p: Phrases) -> pa.RecordBatch:
        doc, start, end, item = shard.search(p)
        change = np.zeros(shard.total + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
        places = np.flatnonzero(np.diff(hit))
        n_hit = hit[shard.first + shard.n_words] - hit[shard.first]
        n = len(shard.doc_ids)
        close, _, _, near = shard.search(p, slack) if slack else (doc, start, end, item)
        return pa.RecordBatch.from_arrays(
            [pa.array([number.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), shard.doc_ids, pa.array(shard.n_words), _text.lists((places - np.repeat(shard.first, n_hit)).astype(np.int32), n_hit, pa.int32()), _items(doc, item, n, p.items), _items(close, near, n, p.items)],
            ["shard", "row", "doc_id", "n_words", "hit_words", "items", "near_items"],
        )

    return _rows(index, phrases, f"shard long, row int, doc_id {_kind(index)}, n_words long, hit_words array<int>, items array<string>, near_items array<string>", make)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, by blocks of about ``block_bytes``; more than one block only past that size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, slack: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``, whatever its id: ``n_words``, ``hit_words`` (places of
    the words that lie in a window of ``benchmark (item_id, text)``), ``n_hit``, ``items`` (sorted as strings),
    ``n_items``, ``near_items`` (items of which a window occurs with every word within ``slack`` of its place),
    and ``contaminated`` (some hits, at least ``percent`` % of the words).

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one.
    Null and empty texts have no words and are never contaminated; items without words or id match
    nothing; rows that repeat an item_id count as one item; an empty benchmark leaves all clean; equal windows
    count for each of their items. An empty table gives an empty result. Other columns of either table are
    ignored. The result is the same in one block or several.
    """
    index = written(build_index(docs).withColumn("shard", F.monotonically_increasing_id()), "postings")
    parts = [_summary(index, Phrases(block, width), slack) for block in _blocks(benchmark, block_bytes)]
    found = parts[0]
    if len(parts) > 1:
        for x in parts[1:]:
            found = found.unionByName(x)
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("shard", "row", "doc_id").agg(F.max("n_words").alias("n_words"), *[every(c) for c in ("hit_words", "items", "near_items")])
    n_hit = F.size("hit_words").cast("long")
    told = found.select("doc_id", "n_words", "hit_words", "items", "near_items", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ((n_hit > 0) & (n_hit * 100 >= percent * F.col("n_words"))).alias("contaminated"))
    result = written(told, "contamination")
    discard(index)
    return result
