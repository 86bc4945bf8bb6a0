"""Checks of groups of series on one time grid. All groups go through one plan: members are rows of a table.

``groups (group_id, kind, series_id, position, sign)``: members in order, ``sign`` 1 for inputs and -1 for outputs of a
balance. A group is judged only if each of its members has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.times import DAY, HOUR, MIN, floor_div, since
from tideline.operators.normalize import good_values
from tideline.operators.checks import SIGMA
from tideline.operators.groups import pearson
from tideline.operators.ranks import nearest_rank, pick
from tideline.operators.rules import Found, Run, episodes, skip, told, union
from tideline.operators.sequence import merged
from tideline.operators.tables import written

GROUPS = "group_id string, kind string, series_id string, position int, sign int"
#: Fixed value: the share of an episode that has to point at one member.
SUSPECT = 0.8


def _members(run: Run, groups: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Members of complete groups with ``grid`` (the widest interval among them) and figures of their profile, and the
    groups that lack a member."""
    own = groups.where(F.col("kind").isin(*kinds))
    with_data = own.join(run.prof.select("series_id", "interval", F.coalesce("own_resolution", "resolution", F.lit(0.0)).alias("res")), "series_id", "left")
    state = with_data.groupBy("group_id").agg(F.max("interval").alias("grid"), F.count("*").alias("size"), F.count_if(F.col("interval").isNull()).alias("missing"), F.max("res").alias("coarsest"), F.min_by("series_id", "position").alias("first"))
    whole = with_data.join(state.where("missing = 0 and size >= 2").drop("missing"), "group_id").drop("interval")
    return whole, skip(own.join(state.where("missing > 0 or size < 2").select("group_id"), "group_id"), "the group is not complete")


def _aligned(run: Run, members: DataFrame, grid: int | None) -> DataFrame:
    """``(group_id, bin, x, ...)``: means of good values of each member by bins of the group's grid."""
    wide = members.withColumn("grid", F.lit(grid).cast("long")) if grid else members
    rows = good_values(run.near).select("series_id", "ts_ns", "value").join(wide, "series_id").withColumn("bin", floor_div(F.col("ts_ns"), F.col("grid")))
    keys = [c for c in wide.columns if c != "kind"]
    return rows.groupBy(*keys, "bin").agg(F.avg("value").alias("x"))


def _window(run: Run, found: DataFrame) -> DataFrame:
    """Findings with the part of their series' window that they cover."""
    length = F.greatest(F.lit(1), since(F.col("w_start"), F.col("w_end")))
    return run.of(found, "w_start", "w_end").withColumn("covered", (F.col("end_ns") - F.col("start_ns")) / length)


def bin_episodes(bins: DataFrame, shortest: int) -> DataFrame:
    """``(group_id, start_ns, end_ns)`` of flagged ``bins (group_id, grid, bin)``: neighbours join, short runs go, then runs
    less than ``shortest`` apart join."""
    island = bins.withColumn("_i", F.col("bin") - F.row_number().over(Window.partitionBy("group_id").orderBy("bin")))
    found = island.groupBy("group_id", "grid", "_i").agg((F.min("bin") * F.col("grid")).alias("start_ns"), ((F.max("bin") + 1) * F.col("grid")).alias("end_ns"))
    return merged(found.where(F.col("end_ns") - F.col("start_ns") >= shortest).drop("_i"), ["group_id", "grid"], gap=shortest, inclusive=False)


def correlation_break(run: Run, groups: DataFrame, width: int = DAY, least: int = 24, max_lag: int = 6, references: int = 7, least_reference: int = 4, min_ref: float = 0.5, delta: float = 0.3, flip: float = 0.2, lag_margin: float = 0.1, lag_tolerance: int = 1, grid: int | None = None) -> Found:
    """Pairs of related series that stop moving together, or begin to lead or lag."""
    members, missing = _members(run, groups, ("related", "redundant"))
    wide = members.withColumn("grid", F.lit(grid).cast("long")) if grid else members
    x = written(_aligned(run, wide.select("series_id", "grid").distinct(), grid), "aligned")
    member = lambda n: wide.select("group_id", "grid", F.col("series_id").alias(n), F.col("position").alias(f"p_{n}"))
    duos = written(member("a").join(member("b"), ["group_id", "grid"]).where("p_a < p_b").select("group_id", "grid", "a", "b").distinct(), "pairs")
    # a pair that is in several groups of one grid is worked out once
    key, pair = ["group_id", "a", "b"], ["grid", "a", "b"]
    side = lambda n: x.select("grid", "bin", F.col("series_id").alias(n), F.col("x").alias(f"x_{n}"))
    pairs = side("a").join(duos.select(*pair).distinct(), ["grid", "a"]).join(side("b"), ["grid", "b", "bin"]).withColumn("segment", floor_div(F.col("bin") * F.col("grid"), width))
    ranked = pairs
    for n in "ab":
        order, peers = Window.partitionBy(*pair, "segment").orderBy(f"x_{n}"), Window.partitionBy(*pair, "segment", f"x_{n}")
        ranked = ranked.withColumn(f"r_{n}", F.rank().over(order) + (F.count("*").over(peers) - 1) / 2)
    rho = ranked.groupBy(*pair, "segment").agg(F.count("*").alias("n_points"), pearson("r_a", "r_b").alias("rho")).where((F.col("n_points") >= least) & F.col("rho").isNotNull())
    by_bin = Window.partitionBy(*pair, "segment").orderBy("bin")
    step = lambda n: F.when(F.lag("bin").over(by_bin) == F.col("bin") - 1, F.col(f"x_{n}") - F.lag(f"x_{n}").over(by_bin))
    d = pairs.select(*pair, "segment", "bin", step("a").alias("da"), step("b").alias("db"))
    # steps by bins, not rows: the frame of a lag holds the row of that bin, if there is one
    later = F.array(*[F.struct(F.lit(lag).alias("lag"), F.max("db").over(by_bin.rangeBetween(lag, lag)).alias("db")) for lag in range(-max_lag, max_lag + 1)])
    moved = d.withColumn("_later", later).where("da is not null").select(*pair, "segment", "da", F.explode("_later").alias("_m")).select(*pair, "segment", "da", "_m.*").where("db is not null")
    lags = moved.groupBy(*pair, "segment", "lag").agg(F.count("*").alias("n"), pearson("da", "db").alias("r")).where((F.col("n") >= least // 2) & F.col("r").isNotNull())
    lags = lags.join(rho.select(*pair, "segment", F.signum("rho").alias("direction")), [*pair, "segment"]).withColumn("r", F.col("r") * F.col("direction"))
    best = lags.groupBy(*pair, "segment").agg(F.max_by("lag", F.struct(F.round("r", 12).alias("r"), (-F.abs("lag")).alias("l"))).alias("lag"), F.max("r").alias("strength"), F.map_from_entries(F.collect_list(F.struct("lag", "r"))).alias("profile"))
    seg = rho.join(best, [*pair, "segment"], "left").withColumn("_k", F.row_number().over(Window.partitionBy(*pair).orderBy("segment"))).withColumn("start_ns", F.col("segment") * width).withColumn("end_ns", (F.col("segment") + 1) * width)
    seg = written(seg.join(duos, pair), "pair-segments")
    early = F.col("_k") <= references
    ref = seg.groupBy(*key).agg(F.count("*").alias("all"), F.collect_list(F.when(early, F.col("rho"))).alias("rhos"), F.collect_list(F.when(early, F.col("lag"))).alias("lags"))
    ref = ref.withColumn("rho_ref", pick(F.col("rhos"), 0.5)).withColumn("lag_ref", pick(F.col("lags"), 0.5)).withColumn("lag_mad", pick(F.transform("lags", lambda v: F.abs(v - F.col("lag_ref"))), 0.5))
    enough = (F.col("all") > references) & F.lit(references >= least_reference)
    judged = seg.where(~early).join(ref.where(enough & (F.abs("rho_ref") >= min_ref)), key)
    broken = (F.abs(F.col("rho") - F.col("rho_ref")) > delta) | ((F.signum("rho") != F.signum("rho_ref")) & (F.abs("rho") > flip))
    named = lambda df: df.withColumn("series_id", F.col("a")).withColumn("partner", F.col("b"))
    worst = F.max_by("rho", F.abs(F.col("rho") - F.col("rho_ref")))
    apart = _window(run, named(episodes(judged.where(broken), [*key, "rho_ref"], worst.alias("rho"), F.sum("n_points").alias("n_points"))))
    steady = (F.size("lags") >= least_reference) & (F.col("lag_mad") <= lag_tolerance)
    shifted = judged.where(~broken & steady & (F.col("strength") >= min_ref) & (F.abs(F.col("lag") - F.col("lag_ref")) > lag_tolerance) & (F.col("strength") - F.try_element_at("profile", F.col("lag_ref")) >= lag_margin))
    late = _window(run, named(episodes(shifted, [*key, "grid", "lag_ref"], F.max_by("lag", F.abs(F.col("lag") - F.col("lag_ref"))).alias("lag_steps"))))
    own = lambda name, v: F.struct(F.concat(F.lit(f"{name}:"), F.col("b")).alias("name"), v.cast("double").alias("value"))
    metrics = seg.select(F.col("a").alias("series_id"), F.col("start_ns").alias("ts_ns"), F.explode(F.array(own("rho", F.col("rho")), own("lag_steps", F.col("lag")))).alias("m")).select("series_id", "m.name", "ts_ns", "m.value").where("value is not null")
    few = ref.where(~enough).select(F.col("a").alias("series_id"))
    findings = union(told(apart, "high", F.col("covered"), "group_id", "partner", "rho", "rho_ref", "segments", "n_points"), told(late, "high", F.col("covered"), "group_id", "partner", "lag_steps", "lag_ref", "grid", "segments"))
    return Found(findings, metrics, union(missing, skip(few, "too few segments for a reference")))


def redundant_disagreement(run: Run, groups: DataFrame, tolerance: float | None = None, min_duration: int = 15 * MIN, grid: int | None = None) -> Found:
    """Series that measure the same and differ by more than their usual scatter."""
    members, missing = _members(run, groups, ("redundant",))
    x = _aligned(run, members, grid)
    each = x.groupBy("group_id", "grid", "size", "coarsest", "first", "bin").agg(F.sort_array(F.collect_list(F.struct("position", "series_id", "x"))).alias("m")).where(F.size("m") >= 2)
    pair = F.get("m", F.lit(0))["x"] - F.get("m", F.lit(1))["x"]
    each = each.withColumn("mid", pick(F.transform("m", lambda r: r["x"]), 0.5)).withColumn("dev", F.transform("m", lambda r: F.struct(r["series_id"].alias("series_id"), F.when(F.col("size") == 2, pair).otherwise(r["x"] - F.col("mid")).alias("d"))))
    each = written(each.drop("m", "mid"), "deviations")
    # the median member of an odd bin is 0 away from itself and tells nothing; of a pair both have one difference
    sizes = each.withColumn("abs", F.array_sort(F.transform("dev", lambda r: F.abs(r["d"])))).withColumn("drop", F.when((F.col("size") == 2) | (F.size("dev") % 2 == 1), 1).otherwise(0))
    pooled = sizes.select("group_id", "coarsest", F.explode(F.slice("abs", F.col("drop") + 1, F.greatest(F.lit(0), F.size("abs") - F.col("drop")))).alias("v"))
    auto = nearest_rank(pooled, [0.5], "v", ["group_id", "coarsest"]).select("group_id", F.greatest(4 * SIGMA * F.col("v"), 2 * F.col("coarsest")).alias("tolerance"))
    limit = auto.withColumn("tolerance", F.lit(tolerance)) if tolerance is not None else auto
    judged = each.join(limit, "group_id").withColumn("off", F.filter("dev", lambda r: F.abs(r["d"]) > F.col("tolerance")))
    one = (F.col("size") >= 3) & (F.size("dev") >= 3) & (F.size("off") == 1)
    judged = written(judged.withColumn("suspect", F.when(one, F.get("off", F.lit(0))["series_id"])).withColumn("largest", F.array_max(F.transform("dev", lambda r: F.abs(r["d"])))), "disagreements")
    flagged = judged.where(F.size("off") > 0)
    eps = bin_episodes(flagged.select("group_id", "grid", "bin"), min_duration)
    at = F.col("bin") * F.col("grid")
    inside = flagged.join(eps.select("group_id", "start_ns", "end_ns"), "group_id").where((at >= F.col("start_ns")) & (at < F.col("end_ns")))
    key = ["group_id", "first", "start_ns", "end_ns", "tolerance"]
    votes = inside.groupBy(*key, "suspect").agg(F.count("*").alias("c"), F.max("largest").alias("high"), F.sum("largest").alias("total"))
    named = votes.groupBy(*key).agg(F.sum("c").alias("n_points"), F.max("high").alias("max_abs_diff"), F.sum("total").alias("total"), F.max_by("suspect", F.when(F.col("suspect").isNotNull(), F.col("c"))).alias("suspect"), F.max(F.when(F.col("suspect").isNotNull(), F.col("c"))).alias("most"))
    named = named.withColumn("suspect", F.when(F.col("most") >= SUSPECT * F.col("n_points"), F.col("suspect"))).withColumn("series_id", F.coalesce("suspect", "first")).withColumn("mean_abs_diff", F.col("total") / F.col("n_points"))
    daily = judged.groupBy("group_id", F.col("first").alias("series_id"), (floor_div(at, DAY) * DAY).alias("ts_ns")).agg(F.max("largest").alias("value")).select("series_id", F.concat(F.lit("max_abs_diff:"), F.col("group_id")).alias("name"), "ts_ns", "value")
    return Found(told(_window(run, named), "high", F.col("covered"), "group_id", "suspect", "tolerance", "max_abs_diff", "mean_abs_diff", "n_points"), daily, missing)


def balance_residual(run: Run, groups: DataFrame, loss_min: float = -0.01, loss_max: float = 0.05, k: float = 3.0, uncertainty: float = 0.01, min_duration: int = HOUR, grid: int | None = None) -> Found:
    """Balances that do not close within their usual loss and the members' uncertainty, and the member that explains it."""
    members, missing = _members(run, groups, ("balance",))
    x = _aligned(run, members, grid)
    part = F.col("x") * F.col("sign")
    bins = x.groupBy("group_id", "grid", "size", "bin").agg(
        F.count("*").alias("n"),
        F.sum(part).alias("residual"),
        F.sum(F.when(F.col("sign") > 0, F.col("x")).otherwise(0.0)).alias("sum_in"),
        F.sum("x").alias("both"),
        F.sqrt(F.sum(F.pow(F.greatest(uncertainty * F.abs("x"), F.col("res")), F.lit(2)))).alias("sigma"),
        F.min_by("series_id", F.when(F.col("sign") > 0, F.col("position"))).alias("first_input"),
        F.collect_list(F.struct("series_id", "sign", "x")).alias("m"),
    ).where("n = size")
    base = F.greatest(F.lit(0.0), F.col("sum_in"))
    excess = F.greatest(F.lit(0.0), F.col("residual") - loss_max * base, loss_min * base - F.col("residual"))
    bins = bins.withColumn("excess", excess).withColumn("flagged", F.col("excess") > k * F.col("sigma")).withColumn("share", F.when(F.col("sum_in") > 0, F.col("residual") / F.col("sum_in"))).withColumn("above", F.col("residual") > loss_max * base).withColumn("throughput", F.col("both") / 2).withColumn("z", F.try_divide("excess", "sigma"))
    bins = written(bins, "balances")
    eps = bin_episodes(bins.where("flagged").select("group_id", "grid", "bin"), min_duration)
    at = F.col("bin") * F.col("grid")
    inside = bins.where("flagged").join(eps.select("group_id", "start_ns", "end_ns"), "group_id").where((at >= F.col("start_ns")) & (at < F.col("end_ns")))
    key = ["group_id", "start_ns", "end_ns"]
    told_of = inside.groupBy(*key, "first_input").agg(F.avg("residual").alias("residual_mean"), F.avg("share").alias("loss_share_mean"), F.max("z").alias("z_max"), F.count("*").alias("n_points"), F.when(F.count_if("above") * 2 >= F.count("*"), "above_band").otherwise("below_band").alias("reason"))

    # shares of the throughput, usual and in the episode; what changes for all alike is the common mode
    members_of = lambda df: df.where("throughput > 0").select("*", F.explode("m").alias("r"))
    share = F.avg(F.col("r.x") / F.col("throughput"))
    usual = members_of(bins.where("not flagged")).groupBy("group_id", "r.series_id", "r.sign").agg(share.alias("usual"))
    now = members_of(inside).groupBy(*key, "r.series_id").agg(share.alias("now"))
    change = now.join(usual, ["group_id", "series_id"])
    w = Window.partitionBy(*key)
    change = change.withColumn("idle", F.max((F.abs("usual") < 1e-12).cast("int")).over(w)).where("idle = 0").withColumn("g", F.col("now") / F.col("usual") - 1)
    common = change.groupBy(*key).agg(F.percentile("g", F.lit(0.5)).alias("common"))
    change = change.join(common, key).withColumn("c", F.col("sign") * F.col("usual") * (F.col("g") - F.col("common"))).withColumn("delta", F.sum("c").over(w)).where(F.abs("delta") >= 1e-9).withColumn("ratio", F.col("c") / F.col("delta"))
    blame = change.groupBy(*key).agg(F.max_by("series_id", F.when(F.col("ratio") >= SUSPECT, F.col("ratio"))).alias("suspect"), F.max("ratio").alias("most"), F.map_from_entries(F.collect_list(F.struct("series_id", F.round("ratio", 3)))).alias("contributions"))
    named = told_of.join(blame, key, "left").withColumn("suspect", F.when(F.col("most") >= SUSPECT, F.col("suspect"))).withColumn("series_id", F.coalesce("suspect", "first_input"))
    daily = bins.groupBy("group_id", "first_input", (floor_div(at, DAY) * DAY).alias("ts_ns")).agg(F.avg("residual").alias("residual_mean"), F.avg("share").alias("loss_share_mean"))
    own = lambda n: F.struct(F.concat(F.lit(f"{n}:"), F.col("group_id")).alias("name"), F.col(n).alias("value"))
    metrics = daily.select(F.col("first_input").alias("series_id"), "ts_ns", F.explode(F.array(own("residual_mean"), own("loss_share_mean"))).alias("m")).select("series_id", "m.name", "ts_ns", "m.value").where("value is not null")
    return Found(told(_window(run, named), "high", F.col("covered"), "group_id", "suspect", "residual_mean", "z_max", "loss_share_mean", "contributions", "reason", "n_points"), metrics, missing)


RULES = {
    "correlation_break": ("consistency", "high", correlation_break),
    "redundant_disagreement": ("accuracy", "high", redundant_disagreement),
    "balance_residual": ("consistency", "high", balance_residual),
}
