"""Health of sources, hits of labels, metadata that is filled in, moments of huge values, times to the nanosecond."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.times import DAY, END_OF_TIME, HOUR, MIN, SEC, before_end, resolve_window
from tideline.operators import charts, lifecycle, outcomes, ranks
from tideline.operators.scores import merged_coverage
from tideline.plans import registry
from tideline.sources import files, synth

T = 1_699_920_000 * SEC


def test_health_by_a_plain_fold(spark):
    r = random.Random(4)
    rows = [(f"s{k % 7}", k, r.randrange(50), r.choice(["failed", "succeeded"]) if k % 7 else "failed", f"e{k}", r.choice(["poll", "probe"]), k) for k in range(300)]
    want = {}
    for source, k, at, status, error, trigger, n in sorted(rows, key=lambda x: (x[2], x[1])):
        h = want.setdefault(source, {"failures": 0, "success": None, "error": None, "fetch": None})
        h["failures"] = 0 if status == "succeeded" else h["failures"] + 1
        if status == "succeeded":
            h["success"] = at
        else:
            h["error"] = (error, at)
        if trigger == "poll":
            h["fetch"] = (k, status, n)
    got = outcomes.next_health(spark.createDataFrame(rows, "source_id string, fetch_id long, at_ns long, status string, error string, trigger string, rows long"), ["poll"]).collect()
    assert len(got) == 7
    for x in got:
        h = want[x.source_id]
        assert x.status == ("ok" if not h["failures"] else "degraded" if h["failures"] < 3 else "failing")
        assert (x.consecutive_failures, x.last_success_ns, (x.last_error, x.last_error_ns), (x.last_fetch_id, x.last_fetch_status, x.last_rows)) == (h["failures"], h["success"], h["error"], h["fetch"])


def test_stale_runs_and_old_fetches(spark):
    runs = spark.createDataFrame([(1, "running", 5), (2, "running", 50), (3, "done", 0), (4, "running", None)], "id long, status string, beat_ns long")
    assert {x.id: x.status for x in outcomes.reap(runs, 100, 60).collect()} == {1: "failed", 2: "running", 3: "done", 4: "failed"}
    assert outcomes.prune(spark.createDataFrame([(5,), (40,)], "at_ns long"), 100, 60).count() == 1


def test_checks_against_labels(spark):
    """Planted faults as labels: what is found, and what is told beside them."""
    clean = synth.generate(spark, 4 * 1440, ["a", "b"], start=T, noise=0.5)
    obs = synth.missing(synth.gap(clean, 2000, 300, "a"), 1000, 100, "b")
    labels = spark.createDataFrame([("a", T + 2000 * MIN, T + 2300 * MIN), ("b", T + 1000 * MIN, T + 1100 * MIN)] * 2 + [("b", T + 4000 * MIN, T + 4001 * MIN)], "series_id string, start_ns long, end_ns long")
    found = registry.run_checks(obs, [registry.Config(registry.PREFIX + "completeness"), registry.Config(registry.PREFIX + "value_type")]).findings.where("severity = 'high'")
    got = {x.check_id.split(".")[1]: x for x in outcomes.label_hits(labels, found).collect()}
    assert (got["completeness"].windows, got["completeness"].hit, got["completeness"].outside) == (3, 2, 0)
    assert (got["value_type"].hit, got["value_type"].findings, got["value_type"].false_share) == (1, 1, 0.0)
    beside = found.limit(1).withColumn("start_ns", F.lit(T - DAY)).withColumn("end_ns", F.lit(T - DAY + 1))
    assert outcomes.label_hits(labels, beside).first().false_share == 1.0
    touching = found.limit(1).withColumn("series_id", F.lit("b")).withColumn("start_ns", F.lit(T + 4001 * MIN)).withColumn("end_ns", F.lit(T + 4002 * MIN))
    assert outcomes.label_hits(labels, touching).first().hit == 1


def test_metadata_fills_and_drops_clashing_limits(spark):
    known = spark.createDataFrame([("a", "bar", None, None), ("b", None, 5.0, None), ("c", None, None, None)], "series_id string, unit string, low double, high double")
    new = spark.createDataFrame([("a", "psi", 1.0, 2.0), ("b", "m", 0.0, 4.0), ("d", "K", 9.0, 3.0), ("e", "K", 1.0, 3.0)], "series_id string, unit string, low double, high double").withColumn("other", F.lit(1))
    rows = lambda **more: {x.series_id: (x.unit, x.low, x.high, x.changed) for x in lifecycle.merge_metadata(known, new, **more).collect()}
    assert rows() == {"a": ("bar", 1.0, 2.0, ["low", "high"]), "b": ("m", 5.0, None, ["unit"]), "c": (None, None, None, []), "d": ("K", None, None, ["unit"]), "e": ("K", 1.0, 3.0, ["unit", "low", "high"])}
    assert rows(overwrite=True)["a"] == ("psi", 1.0, 2.0, ["unit", "low", "high"]) and rows(overwrite=True)["b"] == ("m", 0.0, 4.0, ["unit", "low", "high"])


def test_moments_of_huge_values(spark):
    rows = [("huge", k, (1.0 if k % 2 else -1.0) * 1e308) for k in range(100)] + [("big", k, 1e308 + k * 1e306) for k in range(50)] + [("plain", k, float(k)) for k in range(5)]
    norm = spark.createDataFrame(rows, "series_id string, ts_ns long, value double").withColumn("quality", F.lit(0)).repartition(7)
    got = {x.series_id: x for x in charts.window_stats(norm).collect()}
    assert got["huge"].mean == pytest.approx(0, abs=1e293) and got["huge"].sd == pytest.approx(1e308)
    assert got["big"].mean == pytest.approx(1e308 + 24.5e306) and got["big"].sd == pytest.approx(1e306 * (2499 / 12) ** 0.5)
    assert (got["plain"].mean, got["plain"].sd, got["plain"].first_ns) == (2.0, pytest.approx(2**0.5), 0)


def test_times_to_the_nanosecond_and_empty_epochs(spark):
    texts = ["2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00.1234567Z", "2024-01-01 00:00:00.123456", "1969-12-31T23:59:59.999999999Z", "2024-01-01T02:00:00.000000001+02:00"]
    got = [x.t for x in spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i").select(files.text_time(F.col("s")).alias("t")).collect()]
    day = 1_704_067_200 * SEC
    assert got == [day + 123456789, day + 123456700, day + 123456000, -1, day + 1]
    empty = files.epoch_column(spark.createDataFrame([(1, None), (2, None)], "i int, ts long")).collect()
    assert [x.ts_ns for x in empty] == [None, None]


def test_windows(spark):
    assert resolve_window(10 * DAY, "7d") == (3 * DAY, 10 * DAY) and resolve_window(0, start=1, end=2) == (1, 2)
    for bad in ({"last": "30m"}, {"last": "401d"}, {"start": 2, "end": 2}, {}):
        with pytest.raises(ValueError):
            resolve_window(0, **bad)
    rows = spark.createDataFrame([(1,), (END_OF_TIME,)], "t long")
    assert rows.where(before_end(F.col("t"), END_OF_TIME)).count() == 2 and rows.where(before_end(F.col("t"), 1)).count() == 0


def test_coverage_of_many_spans_in_a_day(spark):
    """100,000 spans of one day against a plain sweep over their bounds."""
    import time

    r = random.Random(1)
    spans = [("k", s, s + r.randrange(1, DAY // 50), round(r.random(), 6)) for s in (r.randrange(DAY - DAY // 50) for _ in range(100_000))]
    began = time.time()
    got = merged_coverage(spark.createDataFrame(spans, "key string, s long, e long, w double"), ["key"]).first().integral
    assert time.time() - began < 60
    points = sorted({x for _, s, e, _ in spans for x in (s, e)})
    import bisect

    best = [0.0] * len(points)
    left = list(range(len(points) + 1))

    def find(i):
        while left[i] != i:
            left[i] = left[left[i]]
            i = left[i]
        return i

    for _, s, e, w in sorted(spans, key=lambda x: -x[3]):  # the largest takes what nobody has yet
        i, end = find(bisect.bisect_left(points, s)), bisect.bisect_left(points, e)
        while i < end:
            best[i], left[i] = w, i + 1
            i = find(i)
    want = sum(w * (b - a) for w, a, b in zip(best, points, points[1:]))
    assert got == pytest.approx(want, rel=1e-9)


def test_ranks_of_narrow_values(spark, monkeypatch):
    """Values near 50 that differ in late digits are cut into many ranges, in passes over counts."""
    monkeypatch.setattr(ranks, "SORTED", 2000)
    r = random.Random(2)
    values = sorted(50 + r.random() * 0.005 for _ in range(20_000))
    df = spark.createDataFrame([("hot", v) for v in values] + [("few", 1.0)] * 3 + [("odd", v) for v in (-1.0, 0.0, float("inf"), float("-inf"), 5e-324)], "series_id string, value double")
    qs = [0.0, 0.001, 0.5, 0.999, 1.0]
    got = {(x.series_id, x.q): x.v for x in ranks.nearest_rank(df, qs).collect()}
    assert [got["hot", q] for q in qs] == [values[int((len(values) - 1) * q + 0.5)] for q in qs]
    assert {got["few", q] for q in qs} == {1.0} and [got["odd", q] for q in (0.0, 0.5, 1.0)] == [float("-inf"), 0.0, float("inf")]
    whole = spark.createDataFrame([("t", 10**18 + k) for k in range(5000)], "series_id string, value long")
    assert ranks.nearest_rank(whole, [0.5]).first().v == 10**18 + 2500
