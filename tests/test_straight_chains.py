"""Stretches that touch, over the bounds of chunks, and how they are dealt to tasks."""

import random

import numpy as np
import pytest

from tests.test_engine import series
from tideline.operators import normalize, seasonal


def brute(v, atol, least):
    """Rows of each stretch by one walk over the series."""
    d = np.diff(v)
    smooth = [i for i in range(2, len(v)) if abs(d[i - 1] - d[i - 2]) <= atol and abs(d[i - 2]) > atol]
    parts = [p.tolist() for p in np.split(smooth, np.flatnonzero(np.diff(smooth) > 1) + 1)]
    out, end = [], -1
    for a, b in ((p[0], p[-1]) for p in parts):
        start = max(a - 2, end)
        if b + 1 - start >= least and (start == a - 2 or abs(d[a - 1]) > atol):
            out.append((start, b + 1 - start))
            end = b + 1
    return out


@pytest.mark.parametrize("least", [3, 4, 6])
def test_touching_stretches(spark, monkeypatch, least):
    monkeypatch.setattr(seasonal, "ROWS", 7, raising=False)
    v = [float(random.Random(i).randrange(12)) for i in range(600)]
    found = seasonal.straight_runs(normalize.normalized(series(spark, v)), 4.0, least)
    assert sorted((x.first_i, x.n) for x in found.collect()) == brute(v, 4.0, least)
    # before: a call of Python for each chain, and a window over all stretches of a series
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
