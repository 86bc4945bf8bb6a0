"""Periods of series: found in daily and weekly shapes, not in noise, the same in chunks of any size."""

import math
import random

import numpy as np
import pytest

from tideline.functions.times import DAY, HOUR
from tideline.operators import normalize, profiles, seasonal
from tideline.operators.tables import written

START = 1_704_326_400 * 10**9


def spine_of(spark, **series):
    rows = [(s, k, None if x is None else float(x)) for s, v in series.items() for k, x in enumerate(v)]
    return written(spark.createDataFrame(rows, "series_id string, i long, v double"), "spine")


def test_periods(spark):
    r = random.Random(1)
    hours = range(8 * 7 * 24)
    daily = [10 * math.sin(i / 24 * math.tau) + r.gauss(0, 2) for i in hours]
    weekly = [5.0 * ((i // 24) % 7 in (5, 6)) + r.gauss(0, 0.5) for i in hours]
    spine = spine_of(spark, daily=daily, holes=[None if 100 < i < 160 else x for i, x in enumerate(daily)], weekly=weekly, noise=[r.gauss(0, 1) for _ in hours], short=daily[: 2 * 24], flat=[1.0] * 500)
    got = {x.series_id: (x.dominant_period_ns, x.seasonal_strength) for x in seasonal.dominant(spine, HOUR).collect()}
    assert {s: p for s, (p, _) in got.items()} == {"daily": DAY, "holes": DAY, "weekly": 7 * DAY}
    assert got["daily"][1] > 0.8 and got["weekly"][1] > 0.8
    assert got["daily"][1] == pytest.approx(seasonal.strength_of(np.array(daily), 24))
    assert seasonal.dominant(spine.limit(0), HOUR).collect() == [] and seasonal.dominant(spine, 12 * HOUR, (DAY,)).collect() == []


def test_chunks_do_not_matter(spark, monkeypatch):
    r = random.Random(2)
    v = [None if r.random() < 0.1 else r.gauss(50, 5) for _ in range(300)]
    for period in (7, 24):
        spine = spine_of(spark, s=v)
        whole = [x.d for x in seasonal.detrend(spine, period).orderBy("i").collect()]
        with monkeypatch.context() as m:
            m.setattr(seasonal, "BINS", 10)
            cut = [x.d for x in seasonal.detrend(spine, period).orderBy("i").collect()]
        want = seasonal._flat(np.array([np.nan if x is None else x for x in v]), period)
        for got in (whole, cut):
            assert [x is None for x in got] == np.isnan(want).tolist()
            assert np.allclose([x for x in got if x is not None], want[np.isfinite(want)])


def test_profiles_with_periods(spark):
    rows = [(s, k, START + k * step, 10 * math.sin(k * step / DAY * math.tau) + k % 3) for s, step, n in (("quarter", HOUR // 4, 4 * 24 * 9), ("slow", 2 * HOUR, 12 * 9), ("few", HOUR, 30)) for k in range(n)]
    obs = spark.createDataFrame(rows, "series_id string, seq long, ts_ns long, value double").selectExpr("*", "0 as quality", "cast(null as bigint) as ingest_ns")
    near = written(profiles.beside(normalize.normalized(obs)), "near")
    got = {x.series_id: x for x in profiles.with_period(written(profiles.profile(near), "prof"), near).collect()}
    assert (got["quarter"].dominant_period_ns, got["slow"].dominant_period_ns, got["few"].dominant_period_ns) == (DAY, DAY, None)
    assert got["quarter"].seasonal_strength > 0.9 and got["few"].seasonal_strength is None
