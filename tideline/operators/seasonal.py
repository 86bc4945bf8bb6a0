"""Seasonal figures of series that were brought to one step, and straight stretches of values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.meaning import finite
from tideline.functions.times import DAY, END_OF_TIME, floor_div
from tideline.operators.normalize import align
from tideline.operators.sequence import neighbour, running, runs
from tideline.operators.tables import written

#: Bins of a series in one chunk of its running sums, and in one row while its empty bins are filled in.
BINS = 20_000
#: Bins of a period, periods of a series and autocorrelation at least.
LEAST_STEPS, LEAST_PERIODS, LEAST_ACF = 4, 3, 0.3
#: The periods that are tried.
CANDIDATES = (DAY, 7 * DAY, 365 * DAY)


def regularise(obs: DataFrame, step: int) -> DataFrame:
    """``(series_id, i, v)``: means by bins of ``step`` from the epoch, from the first to the last bin;
    null where a bin is empty. A series that has some far-off time has all bins up to it, listed in chunks."""
    means = align(obs, step)
    span = means.groupBy("series_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    chunks = span.select("series_id", "hi", F.explode(F.sequence("lo", "hi", F.lit(BINS).cast("long"))).alias("from"))
    spine = chunks.select("series_id", F.explode(F.sequence("from", F.least(F.col("from") + (BINS - 1), F.col("hi")))).alias("bin"))
    return spine.join(means, ["series_id", "bin"], "left").select("series_id", F.col("bin").alias("i"), F.col("mean").alias("v"))


def detrend(spine: DataFrame, period: int) -> DataFrame:
    """Adds ``d``: the value less the centred moving average over ``period`` bins (half weights at the
    ends if it is even), null where that average has less than half its weight or leaves the series.

    The average is the difference of two running sums, which are worked out in chunks of a series and meet by bin number, so
    neither a series nor a period is one task's."""
    h = period // 2
    has = F.col("v").isNotNull().cast("double")
    sums = running(running(spine.withColumn("_x", F.coalesce("v", F.lit(0.0))).withColumn("_h", has), "_s", F.col("_x"), order="i", chunk=BINS), "_c", F.col("_h"), order="i", chunk=BINS)
    end = lambda name, by: sums.select("series_id", (F.col("i") + by).alias("i"), *[F.col(c).alias(f"{name}{c}") for c in ("_s", "_c", "_x", "_h")])
    both = end("to", -h).join(end("from", h), ["series_id", "i"])
    within = lambda c, x: F.col(f"to{c}") - F.col(f"from{c}") + F.col(f"from{x}") - (0 if period % 2 else (F.col(f"to{x}") + F.col(f"from{x}")) / 2)
    trend = both.select("series_id", "i", within("_s", "_x").alias("_total"), within("_c", "_h").alias("_weight")).where(F.col("_weight") >= period / 2)
    return spine.join(trend, ["series_id", "i"], "left").withColumn("d", F.col("v") - F.col("_total") / F.col("_weight")).drop("_total", "_weight")


def acf(spine: DataFrame, lag: int, value: str = "d") -> DataFrame:
    """``(series_id, n, acf)``: the correlation of values ``lag`` bins apart where both are known."""
    later = spine.select("series_id", (F.col("i") - lag).alias("i"), F.col(value).alias("y"))
    both = spine.select("series_id", "i", F.col(value).alias("x")).join(later, ["series_id", "i"]).where("x is not null and y is not null")
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), r.alias("acf"))


def strength(spine: DataFrame, period: int) -> DataFrame:
    """``(series_id, strength)``: 1 less the share of the detrended variance that the phase means leave,
    from 0 to 1. Phases are counted from each series' first bin."""
    return strength_left(detrend(spine, period), period)


def strength_left(flat: DataFrame, period: int) -> DataFrame:
    """`strength` of what `detrend` gave."""
    first = flat.groupBy("series_id").agg(F.min("i").alias("_lo"))
    d = flat.join(first, "series_id").where("d is not null").withColumn("phase", (F.col("i") - F.col("_lo")) % period)
    phases = d.groupBy("series_id", "phase").agg(F.avg("d").alias("s"))
    known = phases.groupBy("series_id").agg(F.count("*").alias("p"), F.avg("s").alias("centre")).where(F.col("p") == period)
    left = d.join(phases, ["series_id", "phase"]).join(known, "series_id").withColumn("r", F.col("d") - F.col("s") + F.col("centre"))
    share = F.try_divide(F.var_pop("r"), F.var_pop("d"))
    return left.groupBy("series_id").agg(F.when(F.count("*") >= 2 * period, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(share, F.lit(1.0))))).alias("strength"))


def dominant(spine: DataFrame, step: int, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """``(series_id, dominant_period_ns, seasonal_strength)`` of series that have a period: the shortest of ``candidates`` with at least
    ``LEAST_STEPS`` bins, of which the series holds ``LEAST_PERIODS``, whose detrended autocorrelation is ``LEAST_ACF`` or more.

    Autocorrelations and phase means are sums that merge over the bins of a series in any order; ``spine`` (as of
    `regularise`, best a table) is read twice for each candidate."""
    n = spine.groupBy("series_id").agg(F.count("*").alias("_n"))
    found = None
    for c in sorted(c for c in candidates if c > 0):
        period = int(c / step + 0.5)
        if period < LEAST_STEPS:
            continue
        long = n.where(F.col("_n") >= LEAST_PERIODS * period).select("series_id")
        flat = written(detrend(spine.join(long, "series_id"), period), "flat")
        held = acf(flat, period).where(F.col("acf") >= LEAST_ACF).select("series_id")
        own = strength_left(flat, period).where("strength is not null").join(held, "series_id").select("series_id", F.lit(c).cast("long").alias("c"), "strength")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spine.sparkSession.createDataFrame([], "series_id string, dominant_period_ns long, seasonal_strength double")
    return found.groupBy("series_id").agg(F.min("c").alias("dominant_period_ns"), F.min_by("strength", "c").alias("seasonal_strength"))


def _flat(v: np.ndarray, period: int) -> np.ndarray:
    """``detrend`` for one array."""
    kernel = np.ones(period + 1 - period % 2)
    if period % 2 == 0:
        kernel[[0, -1]] = 0.5
    if len(v) < len(kernel):
        return np.full(len(v), np.nan)
    known = np.isfinite(v)
    total, weight = np.convolve(np.where(known, v, 0.0), kernel, "valid"), np.convolve(known, kernel, "valid")
    out, h = np.full(len(v), np.nan), period // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out[h : len(v) - h] = np.where(weight >= period / 2, v[h : len(v) - h] - total / weight, np.nan)
    return out


def strength_of(v: np.ndarray, period: int) -> float | None:
    d = _flat(v, period)
    known = np.flatnonzero(np.isfinite(d))
    phase = known % max(period, 1)
    if period < 2 or len(known) < 2 * period or len(np.unique(phase)) < period:
        return None
    mean = np.bincount(phase, d[known], period) / np.bincount(phase, minlength=period)
    rest, whole = np.var(d[known] - (mean - mean.mean())[phase]), np.var(d[known])
    return 0.0 if whole <= 1e-15 else float(np.clip(1 - rest / whole, 0, 1))


def period_of(v: np.ndarray, step: int, candidates: list[int]) -> tuple[int, float] | None:
    """The shortest candidate period with enough bins and repeats whose autocorrelation holds."""
    for c in sorted(candidates):
        p = int(np.floor(c / step + 0.5))
        if p < LEAST_STEPS or len(v) < LEAST_PERIODS * p:
            continue
        d = _flat(v, p)
        x, y = d[:-p], d[p:]
        both = np.isfinite(x) & np.isfinite(y)
        if both.sum() < 3 or x[both].std() == 0 or y[both].std() == 0 or np.corrcoef(x[both], y[both])[0, 1] < LEAST_ACF:
            continue
        s = strength_of(v, p)
        return None if s is None else (c, s)
    return None


def breaks(spine: DataFrame, step: Column | int, references: int = 4, drop: float = 0.5, least: float = 0.6, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """``(series_id, start_ns, end_ns, period_ns, strength, strength_ref, reason, n_segments)``: stretches in
    which the usual period weakens or gives way to another. Segments of max(4 periods, 7 days) counted
    from the epoch with at least half their bins; the first ``references`` tell what is usual.

    ``spine`` is as of `regularise`, or leaves empty bins out; ``step`` may be a column of it, one number a series. Segments
    are worked out in groups as long as the longest one, and only those with at least half their bins as arrays, so neither a
    long series nor a far-off time is one task's; a row for each segment is all that meets by series."""
    lengths = {p: max(4 * p, 7 * DAY) for p in candidates}
    many = {p: max(lengths.values()) // n for p, n in lengths.items()}
    placed = spine.select("series_id", "i", F.col("v").cast("double").alias("v"), (F.lit(step) if isinstance(step, int) else step).cast("long").alias("step"))
    ends = placed.groupBy("series_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(n).cast("long").alias("length"), F.lit(many[p]).cast("long").alias("many")) for p, n in lengths.items()]))
    # A bin may begin before the first time there is.
    start = F.coalesce(F.try_multiply("i", "step"), F.lit(-(2**63)).cast("long"))
    known = placed.where(finite(F.col("v"))).join(ends, "series_id").select("*", start.alias("start"), each.alias("of")).select("*", "of.*").where(F.col("step") <= F.call_function("div", F.col("p"), F.lit(LEAST_STEPS)))
    known = known.withColumn("k", floor_div(F.col("start"), F.col("length"))).withColumn("part", floor_div(F.col("k"), F.col("many")))

    def figures(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, length, step, lo, hi, out = int(key[1]), lengths[int(key[1])], int(rows["step"].iloc[0]), int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0]), []
        fitting = [c for c in candidates if 3 * c <= length]
        segment, i, v = (rows[c].to_numpy() for c in ("k", "i", "v"))
        for k in np.unique(segment).tolist():
            own = segment == k
            if 2 * own.sum() < length // step:
                continue
            first, last = max(lo, min(-(-k * length // step), int(i[own].min()))), min(hi, -(-(k + 1) * length // step) - 1)
            x = np.full(last - first + 1, np.nan)
            x[i[own] - first] = v[own]
            found = period_of(x, step, fitting) or (None, None)
            out.append((key[0], p, k, strength_of(x, int(np.floor(p / step + 0.5))), *found))
        return pd.DataFrame(out, columns=["series_id", "p", "k", "strength", "found", "found_strength"]).astype({"strength": float, "found": "Int64", "found_strength": float})

    segments = known.select("series_id", "p", "part", "k", "i", "v", "step", "lo", "hi").groupBy("series_id", "p", "part").applyInPandas(figures, "series_id string, p long, k long, strength double, found long, found_strength double")

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["series_id", "start_ns", "end_ns", "period_ns", "strength", "strength_ref", "reason", "n_segments"]
        out = []
        for p in candidates:
            own = rows[rows["p"] == p].sort_values("k")
            parts = list(zip(own["k"].tolist(), own["strength"].tolist(), own["found"].fillna(0).astype("int64").tolist(), own["found_strength"].tolist()))
            if len(parts) <= references or 2 * sum(found == p for _, _, found, _ in parts[:references]) < references:
                continue
            usual = sorted(s for _, s, _, _ in parts[:references] if s == s)
            ref = usual[int((len(usual) - 1) * 0.5 + 0.5)] if usual else 0.0
            if ref < least:
                break
            for k, s, found, other in parts[references:]:
                changed = found not in (0, p) and other >= least
                if s == s and (changed or s < (1 - drop) * ref):
                    if out and out[-1]["k"] == k - 1:
                        out[-1]["k"] = k
                        out[-1]["all"].append((s, changed))
                    else:
                        out.append({"k": k, "first": k, "all": [(s, changed)], "p": p, "ref": ref, "length": lengths[p]})
            break
        inside = lambda t: max(-(2**63), min(t, END_OF_TIME))
        told = [(rows["series_id"].iloc[0], inside(o["first"] * o["length"]), inside((o["k"] + 1) * o["length"]), o["p"], float(np.mean([s for s, _ in o["all"]])), o["ref"], "period_changed" if 2 * sum(c for _, c in o["all"]) >= len(o["all"]) else "weaker", len(o["all"])) for o in out]
        return pd.DataFrame(told, columns=columns)

    return segments.groupBy("series_id").applyInPandas(judge, "series_id string, start_ns long, end_ns long, period_ns long, strength double, strength_ref double, reason string, n_segments long")


#: Rows of a series in one chunk of its stretches.
ROWS = 50_000


def straight_runs(norm: DataFrame, atol: Column | float, least: int = 6) -> DataFrame:
    """``(series_id, first_i, n, first_ts, last_ts, next_ts)``: stretches of ``least`` or more rows whose second differences
    are within ``atol`` (which may be a column of ``norm``) and whose first are not. Where two stretches share a row, the
    earlier keeps it.

    Stretches that touch form a chain. Chains are numbered in chunks of a series and stream through their tasks in order, with
    the end of one stretch held; those too short to count in any chain go first."""
    tol = (F.lit(atol) if isinstance(atol, (int, float)) else atol).cast("double")
    x = running(norm.select("series_id", "ts_ns", tol.alias("_atol"), F.when(finite(F.col("value")), F.col("value")).alias("_v")), "_n", F.lit(1)).withColumn("i", F.col("_n") - 1)
    x = neighbour(x, "_b1", F.struct("_v", "ts_ns")).withColumn("_d", F.col("_v") - F.col("_b1._v"))
    x = neighbour(x, "_b2", F.struct(F.col("_d"), F.col("_b1.ts_ns").alias("ts_ns")))
    smooth = (F.abs(F.col("_d") - F.col("_b2._d")) <= F.col("_atol")) & (F.abs("_b2._d") > F.col("_atol"))
    start = F.struct(F.col("i"), F.abs("_d").alias("d"), F.col("_atol").alias("atol"), F.col("_b1.ts_ns").alias("t1"), F.col("_b2.ts_ns").alias("t2"))
    # a stretch has the two rows before as well
    found = runs(x, smooth, first=start).where(F.col("n") + 2 >= least).select("series_id", F.col("first.i").alias("a"), (F.col("first.i") + F.col("n") - 1).alias("b"), "first.d", "first.atol", "first.t1", "first.t2", "last_ts", "next_ts")
    near = neighbour(found, "_prior", F.col("b"), order="a", chunk=ROWS)
    chained = running(near.withColumn("_new", F.when(F.col("_prior") == F.col("a") - 2, 0).otherwise(1)), "chain", F.col("_new"), order="a", chunk=ROWS)
    columns = ["series_id", "first_i", "n", "first_ts", "last_ts", "next_ts"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, end = None, -1
        for rows in batches:
            out = []
            for name, chain, a, b, d, tol, t1, t2, last, after in zip(*(rows[c].tolist() for c in ("series_id", "chain", "a", "b", "d", "atol", "t1", "t2", "last_ts")), rows["next_ts"].astype("Int64").tolist()):
                if at != (name, chain):
                    at, end = (name, chain), -1
                start = max(a - 2, end)
                if b + 1 - start >= least and (start == a - 2 or d > tol):
                    out.append((name, start, b + 1 - start, t2 if start == a - 2 else t1, last, after))
                    end = b + 1
            yield pd.DataFrame(out, columns=columns).astype({"next_ts": "Int64"})

    ordered = chained.select("series_id", "chain", "a", "b", "d", "atol", "t1", "t2", "last_ts", "next_ts").repartition("series_id", "chain").sortWithinPartitions("series_id", "chain", "a")
    return ordered.mapInPandas(walk, "series_id string, first_i long, n long, first_ts long, last_ts long, next_ts long")
