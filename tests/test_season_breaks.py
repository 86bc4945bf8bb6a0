"""Breaks of the usual period: in series of any number of intervals, however far apart their times, and by segments."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.times import DAY, HOUR, MIN
from tideline.operators import normalize, seasonal
from tideline.plans import registry

#: A Thursday at midnight, where segments of 7 and of 28 days begin.
START = 1_705_536_000 * 10**9
CHECK = registry.PREFIX + "seasonality_break"


def rhythm(step, seed, days=63, until=42):
    """A daily shape that is lost after ``until`` days."""
    r = random.Random(seed)
    return [50 + (10 * math.sin(k * step / DAY * math.tau) if k * step < until * DAY else 0) + r.gauss(0, 0.5) for k in range(days * DAY // step)]


def deliver(spark, rows):
    return spark.createDataFrame(rows, "series_id string, seq long, ts_ns long, value double").selectExpr("*", "0 as quality", "cast(null as bigint) as ingest_ns")


MINUTES = (60, 72, 80, 90, 96, 120, 144, 160, 180, 240, 288, 360)  # before: eight of these, the others skipped


@pytest.fixture(scope="module")
def run(spark):
    obs = deliver(spark, [(f"m{m}", k, START + k * m * MIN, v) for m in MINUTES for k, v in enumerate(rhythm(m * MIN, m))])
    return registry.run_checks(obs, [registry.Config(CHECK)])


def test_any_number_of_intervals(run):
    assert {(r.series_id, r.start_ns, r.end_ns) for r in run.findings.collect()} == {(f"m{m}", START + 42 * DAY, START + 63 * DAY) for m in MINUTES}
    assert run.skipped.collect() == []


def test_metrics_of_any_number_of_intervals(run):
    assert sorted((r.series_id, r.name, r.ts_ns) for r in run.metrics.collect()) == sorted((f"m{m}", "seasonal_strength", START + 42 * DAY) for m in MINUTES)


def test_scores_of_any_number_of_intervals(run):
    """A series that was skipped kept its full score."""
    assert run.scores.where("plausibility < 100").count() == len(MINUTES)


def test_times_far_apart(spark):
    """A time 80 years before the others is 700,000 hours away; before, the series was skipped."""
    rows = [("far", k, START + k * HOUR, v) for k, v in enumerate(rhythm(HOUR, 1))]
    obs = deliver(spark, [*rows, ("far", len(rows), START - 80 * 365 * DAY, 50.0), *[("near", *r[1:]) for r in rows]])
    out = registry.run_checks(obs, [registry.Config(CHECK)])
    assert {(r.series_id, r.start_ns, r.end_ns) for r in out.findings.collect()} == {(s, START + 42 * DAY, START + 63 * DAY) for s in ("far", "near")}
    assert out.skipped.collect() == []
    spine = seasonal.regularise(obs, HOUR)
    assert {r.series_id: r["count"] for r in spine.groupBy("series_id").count().collect()} == {"far": 80 * 365 * 24 + len(rows), "near": len(rows)}
    n, known, distinct = spine.where("series_id = 'far'").agg(F.count("*"), F.count("v"), F.count_distinct("i")).first()
    assert n == distinct and known == len(rows) + 1


def test_ends_of_time(spark):
    obs = deliver(spark, [("s", k, t, 1.0) for k, t in enumerate([-(2**63), -(2**63) + 1, 0, 2**63 - 2, 2**63 - 1])])
    assert registry.run_checks(obs, [registry.Config(CHECK)]).findings.collect() == []


def whole(rows, step, references=4, drop=0.5, least=0.6):
    """`seasonal.breaks` for one series, over an array of all its bins."""
    i, v = np.array([r[0] for r in rows]), np.array([np.nan if r[1] is None else r[1] for r in rows])
    for p in seasonal.CANDIDATES:
        length = max(4 * p, 7 * DAY)
        fitting = [c for c in seasonal.CANDIDATES if 3 * c <= length]
        seg = i * step // length
        parts = [(int(k), v[seg == k]) for k in np.unique(seg)]
        parts = [(k, x) for k, x in parts if 2 * np.isfinite(x).sum() >= length // step]
        if p // step < seasonal.LEAST_STEPS or len(parts) <= references or 2 * sum((seasonal.period_of(x, step, fitting) or (0,))[0] == p for _, x in parts[:references]) < references:
            continue
        n = int(np.floor(p / step + 0.5))
        usual = sorted(s for s in (seasonal.strength_of(x, n) for _, x in parts[:references]) if s is not None)
        ref = usual[int((len(usual) - 1) * 0.5 + 0.5)]
        out = []
        for k, x in parts[references:] if ref >= least else []:
            s, other = seasonal.strength_of(x, n), seasonal.period_of(x, step, fitting)
            if s is not None and (s < (1 - drop) * ref or other is not None and other[0] != p and other[1] >= least):
                out.append((k * length, p, s))
        return out
    return []


@pytest.mark.parametrize("step", [HOUR, 100 * MIN, 7 * HOUR], ids=["hour", "100min", "7h"])
def test_segments_as_over_the_whole_series(spark, step):
    """Weekly and daily shapes with holes and breaks, begun and ended within a segment: the same as over arrays of all bins,
    with empty bins or without."""
    r, data = random.Random(step), {}
    for s in range(6):
        lost = r.randrange(5, 30)
        weeks = [r.random() < 0.25 and w >= lost for w in range(40)]
        shape = (lambda t: 20 * ((t // DAY) % 7 in (5, 6))) if s % 2 else (lambda t: 10 * math.sin(t / DAY * math.tau))
        first = START // step + r.randrange(200)
        data[f"s{s}"] = [(i, None if r.random() < 0.1 or s > 3 and (i * step // DAY) % 60 < 9 else 50 + (0 if weeks[(i * step - START) // (7 * DAY) % 40] else shape(i * step)) + r.gauss(0, 0.5)) for i in range(first, first + r.randrange(200, 274) * DAY // step)]
        for end in (0, -1):
            data[f"s{s}"][end] = (data[f"s{s}"][end][0], 50.0)
    spine = spark.createDataFrame([(s, i, v) for s, rows in data.items() for i, v in rows], "series_id string, i long, v double")
    want = {s: whole(rows, step) for s, rows in data.items()}
    assert step > 6 * HOUR or any(want.values())
    for df in (spine, spine.where("v is not null")):
        got = {s: [] for s in data}
        for x in seasonal.breaks(df, step).orderBy("start_ns").collect():
            got[x.series_id].append(x)
        for s in data:
            length = 4 * 7 * DAY if want[s] and want[s][0][1] == 7 * DAY else 7 * DAY
            cut = [x.start_ns + k * length for x in got[s] for k in range(x.n_segments)]
            assert cut == [k for k, _, _ in want[s]] and {x.period_ns for x in got[s]} == {p for _, p, _ in want[s]}
            assert sum(x.strength * x.n_segments for x in got[s]) == pytest.approx(sum(x for _, _, x in want[s]))
