"""Approximate nearest neighbours by vantage-point trees, one for each shard of the vectors.

Shards are cells around pivots, cut further where a cell is large. A search goes through the tree of its own cell first; the
distance of the last one found there is the bound for all other cells and, inside each, for the branches of its tree. By the
triangle inequality what lies behind a bound can't be nearer; ``factor`` stretches the inequality: a factor of one is exact,
larger ones skip what is unlikely to be nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm._store import discard, written

#: Distinct vectors in a shard, about.
SHARD = 4096
#: Cells at most; a cell that holds more than a shard is cut into several trees.
PIVOTS = 4096
#: Vectors that the pivots are fitted on at most. All vectors are indexed.
SAMPLE = 32_768
#: Vectors in a leaf, queries that search a tree at once, and groups of one vector's ids that are first cut on their own.
LEAF, QUERIES, SALTS = 64, 1024, 16
#: How far the triangle inequality is stretched.
FACTOR = 4.0

_NODE = np.dtype([("start", "i4"), ("mid", "i4"), ("end", "i4"), ("left", "i4"), ("right", "i4"), ("near_lo", "f8"), ("near_hi", "f8"), ("far_lo", "f8"), ("far_hi", "f8")])


def usable(vec: str) -> Column:
    """Whether a vector takes part: not null, empty or zero, without components that are null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, odd) & F.exists(vec, lambda x: x != 0), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, of all rows of ``a`` to all of ``b``, from the differences, so that near ones keep all their digits."""
    out, step = np.empty((len(a), len(b))), max(1, 500_000 // max(1, b.size))
    for at in range(0, len(a), step):
        gap = a[at : at + step, None, :] - b[None]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Means of the sample's cells after some rounds from its first rows."""
    pivots = sample[:count].copy()
    for _ in range(rounds if count > 1 else 0):
        cell = np.concatenate([distances(sample[k : k + 256], pivots).argmin(1) for k in range(0, len(sample), 256)])
        n = np.bincount(cell, minlength=count)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        pivots[n > 0] = sums[n > 0] / n[n > 0, None]
    return pivots


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the vectors in a tree, and its nodes: at ``start`` a vantage point, then its nearer half, from ``mid`` the
    farther half, with the least and greatest distance of either. Leaves have no halves (``mid`` is -1)."""
    order = np.arange(len(vectors))
    nodes: list[tuple] = []

    def grow(start: int, end: int) -> int:
        at = len(nodes)
        nodes.append((start, -1, end, -1, -1, 0, 0, 0, 0))
        if end - start > LEAF:
            own = order[start:end]
            far = int(distances(vectors[own[:1]], vectors[own])[0].argmax())  # a point at the rim parts the others best
            own[[0, far]] = own[[far, 0]]
            d = distances(vectors[own[:1]], vectors[own[1:]])[0]
            by = np.argsort(d, kind="stable")
            own[1:], d = own[1:][by], d[by]
            half = len(d) // 2
            mid = start + 1 + half
            nodes[at] = (start, mid, end, grow(start + 1, mid), grow(mid, end), d[0], d[half - 1], d[half], d[-1])
        return at

    grow(0, len(vectors))
    return order, np.array(nodes, _NODE)


class _Search:
    """A batch of queries going through one tree. ``best``: the ``keep`` least distances of each query so far."""

    def __init__(self, queries: np.ndarray, limit: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, keep: int, factor: float):
        self.queries, self.vectors, self.nodes, self.factor = queries, vectors, nodes, factor
        self.best = np.full((len(queries), keep), np.inf)
        self.limit, self.found = limit, []

    def reach(self) -> np.ndarray:
        """How far a vector may be and still count; what rounding may add is let through."""
        return np.minimum(self.best[:, -1], self.limit) * (1 + 1e-9) + 1e-12

    def meet(self, who: np.ndarray, start: int, end: int) -> np.ndarray:
        d = distances(self.queries[who], self.vectors[start:end])
        both = np.concatenate([self.best[who], d], axis=1)
        keep = self.best.shape[1]
        self.best[who] = np.sort(np.partition(both, keep - 1, axis=1)[:, :keep], axis=1)
        row, at = np.nonzero(d <= self.reach()[who, None])
        self.found.append((who[row], at + start, d[row, at]))
        return d

    def down(self) -> None:
        """Each query to one leaf, for a first bound; what it meets on the way is met again later."""
        stack = [(0, np.arange(len(self.queries)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if node["mid"] < 0:
                self.meet(who, node["start"], node["end"])
                continue
            d = distances(self.queries[who], self.vectors[node["start"] : node["start"] + 1])[:, 0]
            near = d <= (node["near_hi"] + node["far_lo"]) / 2
            stack += [(child, who[mask]) for child, mask in ((node["left"], near), (node["right"], ~near)) if mask.any()]
        self.best[:], first = np.inf, self.best.copy()
        self.limit = np.minimum(self.limit, first[:, -1])
        self.found = []

    def through(self) -> None:
        stack = [(0, np.arange(len(self.queries)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if node["mid"] < 0:
                self.meet(who, node["start"], node["end"])
                continue
            d = self.meet(who, node["start"], node["start"] + 1)[:, 0]
            reach = self.reach()[who]
            for child, lo, hi in ((node["right"], node["far_lo"], node["far_hi"]), (node["left"], node["near_lo"], node["near_hi"])):
                ahead = who[self.factor * np.maximum(np.maximum(lo - d, d - hi), 0) <= reach]
                if len(ahead):
                    stack.append((child, ahead))


def _searched(keep: int, factor: float):
    """Of a tree and the queries that visit it the ``keep`` nearest rows for each query, ties to smaller ids."""

    def run(visits: pa.Table, trees: pa.Table) -> pa.Table:
        out = {"q": pa.int64(), "score": pa.float64(), "vec_id": pa.int64()}
        if not len(visits) or not len(trees):
            return pa.table({k: pa.array([], t) for k, t in out.items()})
        tree = trees.slice(0, 1).to_pylist()[0]
        queries = matrix(visits.column("vec").combine_chunks())
        vectors = np.frombuffer(tree["vectors"], np.float64).reshape(-1, queries.shape[1])
        search = _Search(queries, visits.column("limit").to_numpy(), vectors, np.frombuffer(tree["nodes"], _NODE), keep, factor)
        search.down()
        search.through()
        who, at, d = (np.concatenate(x) for x in zip(*search.found, strict=True))
        near = d <= search.reach()[who]
        who, at, d = who[near], at[near], d[near]
        first, ids = np.frombuffer(tree["first"], np.int64), np.frombuffer(tree["ids"], np.int64)
        count = np.diff(first)[at]
        which = np.repeat(np.arange(len(at)), count)
        ids = ids[np.repeat(first[at], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        who, d = who[which], d[which]
        order = np.lexsort((ids, d, who))
        who, d, ids = who[order], d[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < keep
        return pa.table({"q": visits.column("q").to_numpy()[who[top]], "score": d[top], "vec_id": ids[top]})

    return run


def _tree():
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("vec").combine_chunks())
        order, nodes = build(vectors)
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64)
        return pa.table({"cell": [key[0].as_py()], "part": [key[1].as_py()], "vectors": [vectors[order].tobytes()], "nodes": [nodes.tobytes()], "ids": [ids.flatten().to_numpy().astype(np.int64).tobytes()], "first": [first.tobytes()]})

    return run


def _routed(pivots: np.ndarray):
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                d = distances(matrix(batch.column("vec")), pivots)
                cell = d.argmin(1)
                yield batch.append_column("cell", pa.array(cell.astype(np.int64))).append_column("r", pa.array(d[np.arange(len(cell)), cell]))

    return run


def _ahead(pivots: np.ndarray, cells: np.ndarray, lo: np.ndarray, hi: np.ndarray, factor: float):
    """Queries with the cells, other than their own, that may hold something nearer than ``limit``. A vector of a cell is at most
    as far from its pivot as the cell reaches, and no farther than from the query's own pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                d = distances(matrix(batch.column("vec")), pivots)
                gap = np.maximum((d - d.min(1)[:, None]) / 2, np.maximum(lo - d, d - hi))[:, cells]
                reach = batch.column("limit").to_numpy() * (1 + 1e-9) + 1e-12
                row, col = np.nonzero(factor * gap <= reach[:, None])
                yield batch.take(pa.array(row)).append_column("cell", pa.array(cells[col]))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = FACTOR, shard: int = SHARD, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each row that is a query the ``k`` nearest other rows found, nearest first, ties to smaller ids.

    Rows without an id and vectors that are not `usable` take no part; a row that repeats another's id and vector counts once, and an id
    is no neighbour of itself. Vectors of another length than the query's are none of its candidates. An empty table, or one
    without queries, gives no rows; other columns aren't kept. ``factor`` one is exact.
    """
    clean = vectors.where(F.col(vec_id).isNotNull() & usable(vec)).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), is_query.alias("asks")).withColumn("h", F.xxhash64("vec"))
    # of equal vectors no more ids than a result can hold are wanted, the smallest; hot vectors are cut in parts first
    keep = k + 1
    ids = clean.select("h", "vec", "id").distinct()
    for part in ([F.pmod("id", F.lit(SALTS))], []):
        ids = ids.withColumn("at", F.row_number().over(Window.partitionBy("h", "vec", *part).orderBy("id"))).where(F.col("at") <= keep).drop("at")
    classes = written(ids.groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = clean.where("asks").select("id", "h", "vec")
    found = None
    for size in sorted(x.n for x in classes.select(F.size("vec").alias("n")).distinct().limit(1000).collect()):
        some = lambda df: df.where(F.size("vec") == size)  # noqa: E731, B023
        one = _nearest(some(classes), some(asked), keep, factor, shard)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranks = found.where("query_id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranks.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(classes: DataFrame, asked: DataFrame, keep: int, factor: float, shard: int) -> DataFrame:
    """``(query_id, vec_id, score)``, the query's own row among them, for vectors of one length."""
    n = classes.count()
    count = min(PIVOTS, -(-n // shard))
    sample = np.array([x.vec for x in classes.orderBy("h", "vec").select("vec").limit(min(SAMPLE, 16 * count)).collect()])
    pivots = fit_pivots(sample, min(count, len(sample)))
    routed = written(classes.select("h", "vec", "ids").mapInArrow(_routed(pivots), "h long, vec array<double>, ids array<long>, cell long, r double"), "routed")
    parts = routed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).withColumn("parts", F.ceil(F.col("n") / shard)).drop("n")
    met = sorted((x.cell, x.lo, x.hi) for x in parts.collect())  # one row for each pivot
    cells = np.array([x[0] for x in met], np.int64)
    lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    lo[cells], hi[cells] = [x[1] for x in met], [x[2] for x in met]
    of_cell = F.broadcast(parts.select("cell", "parts"))
    dealt = routed.join(of_cell, "cell").select("cell", F.pmod(F.xxhash64("h"), "parts").alias("part"), "vec", "ids")
    trees = written(dealt.groupBy("cell", "part").applyInArrow(_tree(), "cell long, part long, vectors binary, nodes binary, ids binary, first binary"), "trees")

    vectors = written(asked.groupBy("h", "vec").agg(F.min("id").alias("q")), "queries")  # equal queries are searched for once
    home = vectors.select("q", "vec").mapInArrow(_routed(pivots), "q long, vec array<double>, cell long, r double").join(of_cell, "cell")
    first = written(_visited(home.select("q", "vec", F.lit(float("inf")).alias("limit"), "cell", F.pmod(F.xxhash64("q"), "parts").alias("part")), trees, keep, factor), "first")
    bounds = first.groupBy("q").agg(F.when(F.count("*") >= keep, F.max("score")).otherwise(float("inf")).alias("limit"))
    reached = vectors.select("q", "vec").join(bounds, "q", "left").select("q", "vec", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    ahead = reached.mapInArrow(_ahead(pivots, cells, lo, hi, factor), "q long, vec array<double>, limit double, cell long").join(of_cell, "cell")
    spread = ahead.select("q", "vec", "limit", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    been = home.select("q", "cell", F.pmod(F.xxhash64("q"), "parts").alias("part"))
    more = _visited(spread.join(been, ["q", "cell", "part"], "left_anti"), trees, keep, factor)
    every = first.unionByName(more).withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("at") <= keep).drop("at")
    best = written(every, "nearest")
    discard(routed, trees, first)
    named = asked.select(F.col("id").alias("query_id"), "h", "vec").distinct().join(vectors, ["h", "vec"]).select("query_id", "q")
    return named.join(best, "q").select("query_id", "vec_id", "score")


def _visited(visits: DataFrame, trees: DataFrame, keep: int, factor: float) -> DataFrame:
    """``(q, score, vec_id)`` of ``visits`` ``(q, vec, limit, cell, part)`` in their trees. A tree that many queries visit goes to
    several tasks with it."""
    table = written(visits, "visits")
    blocks = table.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    dealt = table.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("q", F.lit(7)), "blocks")).drop("blocks")
    there = trees.join(blocks, ["cell", "part"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).drop("blocks")
    key = ["cell", "part", "block"]
    return dealt.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_searched(keep, factor), "q long, score double, vec_id long")
