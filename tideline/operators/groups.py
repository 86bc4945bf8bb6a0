"""Operators over several series on one time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.times import DAY, floor_div
from tideline.operators.ranks import pick


def pairs(aligned: DataFrame, members: list[str]) -> DataFrame:
    """``(a, b, bin, x, y)`` for members i < j of a group (at most 32) where both have a bin."""
    place = F.element_at(F.create_map(*[F.lit(v) for i, m in enumerate(members) for v in (m, i)]), F.col("series_id"))
    placed = aligned.where(F.col("series_id").isin(members)).withColumn("pos", place)
    x = placed.select("bin", F.col("series_id").alias("a"), F.col("pos").alias("pa"), F.col("mean").alias("x"))
    y = placed.select("bin", F.col("series_id").alias("b"), F.col("pos").alias("pb"), F.col("mean").alias("y"))
    return x.join(y, "bin").where("pa < pb").drop("pa", "pb")


def pearson(x: str, y: str) -> Column:
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count("*") >= 3, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def spearman_segments(joined: DataFrame, grid: int, width: int = DAY, least: int = 24) -> DataFrame:
    """``(a, b, segment, n, rho)`` by segments counted from the epoch; ties share their mean rank."""
    seg = joined.withColumn("segment", floor_div(F.col("bin") * grid, width))
    own = ["a", "b", "segment"]
    for v in "xy":
        order, peers = Window.partitionBy(*own).orderBy(v), Window.partitionBy(*own, v)
        seg = seg.withColumn(f"r{v}", F.rank().over(order) + (F.count("*").over(peers) - 1) / 2)
    return seg.groupBy(*own).agg(F.count("*").alias("n"), pearson("rx", "ry").alias("rho")).where(F.col("n") >= least)


def lag_profile(joined: DataFrame, most: int = 6) -> DataFrame:
    """``(a, b, lag, n, r)``: correlation of first differences with the second moved by each lag."""
    before = joined.select("a", "b", (F.col("bin") + 1).alias("bin"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    d = joined.join(before, ["a", "b", "bin"]).select("a", "b", "bin", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"))
    left = d.select("a", "b", "dx", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "bin").withColumn("bin", F.col("bin") + F.col("lag"))
    return left.join(d.select("a", "b", "bin", "dy"), ["a", "b", "bin"]).groupBy("a", "b", "lag").agg(F.count("*").alias("n"), pearson("dx", "dy").alias("r"))


def disagreement(aligned: DataFrame, members: list[str]) -> DataFrame:
    """``(bin, series_id, off)``: each member's distance from the bin's nearest-rank median."""
    own = aligned.where(F.col("series_id").isin(members))
    mid = own.groupBy("bin").agg(F.collect_list("mean").alias("m")).where(F.size("m") >= 2).select("bin", pick(F.col("m"), 0.5).alias("mid"))
    return own.join(mid, "bin").select("bin", "series_id", (F.col("mean") - F.col("mid")).alias("off"))


def residual(aligned: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """``(bin, residual, sum_in)``: inputs less outputs where every member has the bin."""
    own = aligned.where(F.col("series_id").isin(inputs + outputs))
    into = F.col("series_id").isin(inputs)
    sums = own.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.when(into, F.col("mean")).otherwise(-F.col("mean"))).alias("residual"), F.sum(F.when(into, F.col("mean")).otherwise(0.0)).alias("sum_in"))
    return sums.where(F.col("n") == len(inputs) + len(outputs)).drop("n")


def balance(res: DataFrame, low: float = -0.01, high: float = 0.05) -> DataFrame:
    """Adds ``excess``: how far the residual lies outside the loss band of the inputs."""
    base = F.greatest(F.lit(0.0), F.col("sum_in"))
    return res.withColumn("excess", F.greatest(F.lit(0.0), F.col("residual") - high * base, low * base - F.col("residual")))


def grid_episodes(flagged: DataFrame, key: list[str], grid: int, shortest: int) -> DataFrame:
    """Runs of neighbouring flagged bins; short runs go first, then runs closer than ``shortest`` join."""
    from tideline.operators.sequence import merged

    w = Window.partitionBy(*key).orderBy("bin")
    runs = flagged.withColumn("_i", F.col("bin") - F.row_number().over(w)).groupBy(*key, "_i").agg((F.min("bin") * grid).alias("start_ns"), ((F.max("bin") + 1) * grid).alias("end_ns"))
    return merged(runs.where(F.col("end_ns") - F.col("start_ns") >= shortest).drop("_i"), key, gap=shortest, inclusive=False)
