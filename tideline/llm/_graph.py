"""Connected groups of similar items without all pairs inside a group.

Links and components are DataFrames throughout; nothing about single items comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._store import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: Edges in one partition.
EDGES = 200_000


def _few(edges: DataFrame, n: int) -> DataFrame:
    """``edges``, of which there are ``n``, in as many partitions as they need: late rounds are small."""
    return edges.coalesce(n // EDGES + 1)


def connected_components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(id, component)`` for all linked ids; component is the smallest id
    that can be reached. Alternates large-star and small-star steps, each two aggregations,
    until no edge changes; the rounds grow with the logarithm of the longest path."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        near = _few(edges, state[0])
        both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        was, state = state, _state(edges)
        if was == state:
            break
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = written(members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return found


def similar_components(members: DataFrame, near: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id, component)`` of the verified links among items that share a key.

    ``members``, a table as of `written` that is deleted here: ``(key, id, score)`` and any columns that ``near`` reads; ``near``: takes candidates ``(id, hub)``
    with these columns of both (``<name>_a`` of id, ``<name>_b`` of hub) and returns ``(id, hub, near)``, false
    only where there can't be a link; ``verify``: candidate ``(a, b)`` rows to the true links.

    First, each member of a key's list is held against the list's hub only, its member of the highest
    score (the one most like the others), which joins most of a group of copies at linear cost. All
    lists with one hub then form a group. ``cross`` gets ``(hub, id, component, minor)`` for the groups
    in which some members (``minor``) are not yet in the hub's component, and returns true links, enough
    to connect what is connected through them. No pair that could change a component goes untested, and
    a group of mutual copies never yields all of its pairs.
    """
    wide = [c for c in members.columns if c not in ("key", "id", "score")]
    hubs = members.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"), *wide)).alias("top"))
    hubs = hubs.select("key", (-F.col("top.id")).alias("hub"), *[F.col(f"top.{c}").alias(f"{c}_b") for c in wide])
    sided = members.select("key", "id", *[F.col(c).alias(f"{c}_a") for c in wide])
    met = sided.join(hubs, "key").where("id <> hub").drop("key")
    once = met.groupBy("id", "hub").agg(*[F.first(c).alias(c) for c in met.columns if c not in ("id", "hub")]) if wide else met.distinct()
    stars = written(near(once), "stars")
    discard(members)
    links = written(verify(stars.where("near").select(F.col("id").alias("a"), F.col("hub").alias("b"))), "links")
    found = connected_components(links)

    central = stars.select("hub").distinct().join(found.withColumnRenamed("id", "hub"), "hub", "left").select("hub", F.coalesce("component", "hub").alias("main"))
    placed = stars.select("id", "hub").join(found, "id", "left").join(central, "hub").select("hub", "id", F.coalesce("component", "id").alias("component"), "main")
    placed = placed.unionByName(central.select("hub", F.col("hub").alias("id"), F.col("main").alias("component"), "main"))
    placed = placed.withColumn("minor", F.col("component") != F.col("main")).drop("main")
    mixed = placed.groupBy("hub").agg(F.count_if("minor").alias("n_minor"), F.count("*").alias("n_all")).where("n_minor > 0 and n_all > 2")
    groups = written(placed.join(mixed, "hub"), "groups")
    discard(stars, links)
    if groups.isEmpty():
        discard(groups)
        return found
    more = written(cross(groups), "more")
    discard(groups)
    if not more.isEmpty():
        old, found = found, _joined(found, more)
        discard(old)
    discard(more)
    return found


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links ``(a, b)``: only the components that these touch are walked through."""
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = connected_components(between).select(F.col("id").alias("component"), F.col("component").alias("to"))
    ends = more.select(F.col("a").alias("id")).union(more.select("b")).distinct().join(found, "id", "left_anti")
    every = found.unionByName(ends.select("id", F.col("id").alias("component")))
    result = written(every.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")
    return result
