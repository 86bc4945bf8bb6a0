"""Order-dependent kernels, over groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.meaning import finite, usable
from tideline.functions.times import snap_to_nice
from tideline.operators.normalize import steps
from tideline.operators.ranks import counted
from tideline.operators.sequence import neighbour, running

#: Rows of a series in one block.
BLOCK = 50_000


def flat_runs(norm: DataFrame, atol: Column | float, least: int = 10) -> DataFrame:
    """``(series_id, first_ts, last_ts, next_ts, n, value)``: runs of ``least`` or more good values within ``atol`` of the
    run's first, each run starting where the one before ended. ``atol`` may be a column of ``norm``. A step of over 2
    ``atol`` ends any run, so stretches between such steps are independent. A stretch streams through its task in
    order with one open run held, however long it is."""
    good = usable(F.col("quality")) & finite(F.col("value"))
    rows = norm.withColumn("_good", good).withColumn("_atol", (F.lit(atol) if isinstance(atol, (int, float)) else atol).cast("double"))
    near = neighbour(rows.withColumn("_v", F.when(F.col("_good"), F.col("value"))), "_prior", F.col("_v"))
    near = neighbour(near, "_ahead", F.col("ts_ns"), after=True)
    new = F.when(F.col("_good") & F.coalesce(F.abs(F.col("value") - F.col("_prior")) <= 2 * F.col("_atol"), F.lit(False)), 0).otherwise(1)
    stretches = running(near.withColumn("_new", new), "stretch", F.col("_new")).where("_good")
    sized = stretches.groupBy("series_id", "stretch").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    columns = ["series_id", "first_ts", "last_ts", "next_ts", "n", "value"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, run = None, None  # the stretch, and its open run: first and last time, rows, value, time after

        for rows in batches:
            out: list[tuple] = []

            def close() -> None:
                if run and run[2] >= least:
                    out.append((at[0], run[0], run[1], run[4], run[2], run[3]))

            names, numbers = rows["series_id"].to_numpy(), rows["stretch"].to_numpy()
            t, v, tol = (rows[c].to_numpy() for c in ("ts_ns", "value", "_atol"))
            ahead = rows["_ahead"].astype("Int64")
            cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])) + 1, [len(rows)]]) if len(rows) else []
            for low, high in zip(cuts[:-1], cuts[1:]):
                if at != (names[low], numbers[low]):
                    close()
                    at, run = (names[low], numbers[low]), None
                s = low
                while s < high:
                    if run is None:
                        run = [int(t[s]), int(t[s]), 0, float(v[s]), None]
                    off = np.flatnonzero(np.abs(v[s:high] - run[3]) > tol[s])
                    e = s + int(off[0]) if len(off) else high
                    if e > s:
                        after = ahead.iloc[e - 1]
                        run[1], run[2], run[4] = int(t[e - 1]), run[2] + e - s, None if pd.isna(after) else int(after)
                    if e < high:
                        close()
                        run = None
                    s = e
            yield pd.DataFrame(out, columns=columns).astype({"next_ts": "Int64"})
        if run and run[2] >= least:
            yield pd.DataFrame([(at[0], run[0], run[1], run[4], run[2], run[3])], columns=columns).astype({"next_ts": "Int64"})

    wanted = stretches.join(sized.select("series_id", "stretch"), ["series_id", "stretch"]).select("series_id", "stretch", "ts_ns", "value", "_atol", "_ahead")
    ordered = wanted.repartition("series_id", "stretch").sortWithinPartitions("series_id", "stretch", "ts_ns")
    return ordered.mapInPandas(cut, "series_id string, first_ts long, last_ts long, next_ts long, n long, value double")


def hampel(norm: DataFrame, floor: Column | float, half: int = 10, limit: float = 4.0) -> DataFrame:
    """``(series_id, ts_ns, value, median, z, i)`` (``i``: the row's number in its series) of good values over ``limit`` deviations from the median of
    the finite ones of the ``2 half + 1`` rows around, three at least. Series are cut into blocks with ``half`` rows of either
    neighbour, so a long one is spread over many tasks."""
    rows = norm.withColumn("_floor", (F.lit(floor) if isinstance(floor, (int, float)) else floor).cast("double"))
    values = running(rows.withColumn("value", F.when(finite(F.col("value")), F.col("value"))), "_i", F.lit(1)).withColumn("_i", F.col("_i") - 1)
    at = F.col("_i")
    blocks = F.array_distinct(F.transform(F.array(F.greatest(at - half, F.lit(0)), at, at + half), lambda i: F.call_function("div", i, F.lit(BLOCK))))
    dealt = values.select("series_id", "ts_ns", "value", "quality", "_i", "_floor", F.explode(blocks).alias("_b"))

    def hits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        v, n = rows["value"].to_numpy(dtype=float), len(rows)
        padded = np.concatenate([np.full(half, np.nan), v, np.full(half, np.nan)])
        around = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)
        count = (~np.isnan(around)).sum(1)
        rank = np.maximum(np.floor((count - 1) * 0.5 + 0.5).astype(int), 0)
        med = around[np.arange(n), rank]
        off = np.sort(np.abs(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1) - med[:, None]), axis=1)[np.arange(n), rank]
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.abs(v - med) / np.maximum(1.4826 * off, rows["_floor"].to_numpy())
        own = (rows["_i"].to_numpy() // BLOCK == rows["_b"].iloc[0]) & np.isin(rows["quality"].to_numpy(), (0, 3)) & (count >= 3) & (z > limit)
        return pd.DataFrame({"series_id": rows["series_id"], "ts_ns": rows["ts_ns"], "value": v, "median": med, "z": z, "i": rows["_i"]})[own]

    return dealt.groupBy("series_id", "_b").applyInPandas(hits, "series_id string, ts_ns long, value double, median double, z double, i long")


def modal(counts: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, modal_ns)`` of ``counts (*by, v, c)`` of positive steps: the steps, in order, fall into buckets within 1 %
    of their first; the middle of the fullest (the first of equals) is rounded to a nice interval. Groups of one
    step have none. Groups stream through their task in order, with one bucket held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best, seen, held = None, (0, 0), 0, ([], [])

        def settle() -> None:
            nonlocal best, held
            total = sum(held[1])
            if total > best[0]:
                best = (total, int(held[0][int(np.searchsorted(np.cumsum(held[1]), total // 2, "right"))]))
            held = ([], [])

        for rows in batches:
            out = []
            for *key, step, c in rows[[*by, "v", "c"]].itertuples(index=False):
                if at != key:
                    settle()
                    if at is not None and seen >= 2:
                        out.append((*at, best[1]))
                    at, best, seen = key, (0, 0), 0
                if held[0] and step > held[0][0] + max(1, int(held[0][0] * 0.01)):
                    settle()
                held[0].append(step)
                held[1].append(c)
                seen += c
            yield pd.DataFrame(out, columns=[*by, "raw"])
        settle()
        if at is not None and seen >= 2:
            yield pd.DataFrame([(*at, best[1])], columns=[*by, "raw"])

    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in by)
    ordered = counts.select(*by, "v", "c").repartition(*by).sortWithinPartitions(*by, "v")
    return ordered.mapInPandas(fold, f"{kinds}, raw long").select(*by, snap_to_nice(F.col("raw")).alias("modal_ns"))


def modal_interval(norm: DataFrame) -> DataFrame:
    """``(series_id, interval_ns)``: the modal step of each series."""
    return modal(counted(steps(norm).where("step > 0"), "step"), ["series_id"]).withColumnRenamed("modal_ns", "interval_ns")


def change_points(medians: DataFrame, least: int = 7, most: int = 2000, beta: float = 3.0, jump_sigmas: float = 3.0, jump_spread: float = 0.5, effect: float = 2.0) -> DataFrame:
    """``(series_id, bucket, until, before, after, jump, local_jump, effect, sigma, n_points)``: abrupt, lasting changes of the
    level of bucket medians ``(series_id, bucket, med)``, which may carry ``spread``, the robust deviation of the series,
    and ``own_resolution``. ``until`` is the bucket of the next change point (null: none), ``n_points`` counts all.

    Cuts are those of optimal partitioning with pruning (squared error, penalty ``beta`` sigma^2 ln m, parts of ``least``
    buckets or half of all, if that is fewer). A cut counts if the levels (medians) on either side differ by
    ``jump_sigmas`` of the noise and ``jump_spread`` of the spread, if the buckets right beside it do so too, in the
    same direction (a ramp cut into steps doesn't), and by ``effect`` of what the parts scatter. Series of under 8
    buckets have none; over ``most`` are an error, as ``checks.bucket_medians`` makes no more."""
    columns = ["series_id", "bucket", "until", "before", "after", "jump", "local_jump", "effect", "sigma", "n_points"]

    def rank(x: np.ndarray) -> float:
        return float(np.sort(x)[int((len(x) - 1) * 0.5 + 0.5)])

    def cuts_of(x: np.ndarray, penalty: float, size: int) -> list[int]:
        m = len(x)
        s, q = np.concatenate([[0], np.cumsum(x - x.mean())]), np.concatenate([[0], np.cumsum((x - x.mean()) ** 2)])
        cost, back, live = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.array([0])
        cost[0] = -penalty
        for e in range(size, m + 1):
            live = np.append(live, e - size) if e - size > 0 and np.isfinite(cost[e - size]) else live
            fit = q[e] - q[live] - (s[e] - s[live]) ** 2 / (e - live)
            total = cost[live] + fit + penalty
            k = int(np.argmin(total))
            cost[e], back[e] = total[k], live[k]
            live = live[cost[live] + fit <= cost[e]]
        cuts, e = [], m
        while back[e] > 0:
            e = back[e]
            cuts.append(int(e))
        return cuts[::-1]

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        x, at, m = rows["med"].to_numpy(), rows["bucket"].to_numpy(), len(rows)
        if m > most:
            raise ValueError(f"{m} buckets in a series, {most} at most")
        if m < 8:
            return pd.DataFrame(columns=columns)
        d = np.diff(x)
        fine = float(rows["own_resolution"].iloc[0]) if "own_resolution" in rows else np.nan
        sigma = max(1.4826 * rank(np.abs(d - rank(d))) / np.sqrt(2), 1e-9 if np.isnan(fine) else fine, 1e-9)
        spread = float(rows["spread"].iloc[0]) if "spread" in rows else 0.0
        size = min(max(least, 2), max(m // 2, 2))
        cuts = cuts_of(x, beta * sigma**2 * np.log(m), size)
        bounds = [0, *cuts, m]
        parts = [x[a:b] for a, b in zip(bounds, bounds[1:])]
        level = [rank(p) for p in parts]
        wanted = max(jump_sigmas * sigma, 0.0 if np.isnan(spread) else jump_spread * spread)
        found = []
        for k, cut in enumerate(cuts):
            jump = level[k + 1] - level[k]
            local = rank(parts[k + 1][:size]) - rank(parts[k][-size:])
            if min(abs(jump), abs(local)) < wanted or np.sign(jump) != np.sign(local):
                continue
            scatter = rank(np.concatenate([np.abs(parts[i] - level[i]) for i in (k, k + 1)]))
            size_of = abs(jump) / max(1.4826 * scatter, sigma)
            if size_of >= effect:
                found.append((rows["series_id"].iloc[0], int(at[cut]), int(at[cuts[k + 1]]) if k + 1 < len(cuts) else None, level[k], level[k + 1], jump, local, size_of, sigma, len(cuts)))
        return pd.DataFrame(found, columns=columns).astype({"until": "Int64"})

    return medians.groupBy("series_id").applyInPandas(split, "series_id string, bucket long, until long, before double, after double, jump double, local_jump double, effect double, sigma double, n_points long")
