"""Planted faults, brute-force kernels, the store, streaming and the entry's guard."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import times
from tideline.functions.times import DAY, HOUR, MIN, SEC
from tideline.operators import charts, checks, kernels, lifecycle, normalize, ranks, scores, sequence
from tideline.sources import files, store
from tideline.streaming import ingest

T = 1_700_000_000 * SEC
SCHEMA = normalize.OBS


def series(spark, values, sid="s", step=MIN, start=T, quality=None):
    rows = [(sid, i, start + i * step, v, (quality or {}).get(i, 0), start + i * step + SEC) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def wave(n, seed=1, period=1440):
    r = random.Random(seed)
    return [float(50 + 10 * np.sin(2 * np.pi * i / period) + r.gauss(0, 0.5)) for i in range(n)]


def test_durations():
    assert [times.parse_duration(x) for x in ("250ms", "90s", "5m", "1.5h", "2d")] == [250_000_000, 90 * SEC, 5 * MIN, 90 * MIN, 2 * DAY]
    assert times.format_duration(26 * HOUR) == "1d 2h" and times.format_duration(0) == "0s"
    with pytest.raises(ValueError):
        times.parse_duration("soon")


@pytest.mark.parametrize("chunk", [7 * MIN, DAY, 400 * DAY])
def test_chunks_do_not_show(spark, chunk):
    """Neighbours, sums and runs are the same however series are cut."""
    r = random.Random(5)
    data = {s: sorted(r.sample(range(3000), 200)) for s in "ab"}
    df = spark.createDataFrame([(s, t * MIN, float(t % 3 == 0)) for s, ts in data.items() for t in ts], "series_id string, ts_ns long, value double")
    got = {(x.series_id, x.ts_ns): x for x in sequence.running(sequence.neighbour(sequence.neighbour(df, "before", F.col("ts_ns"), chunk=chunk), "after", F.col("ts_ns"), after=True, chunk=chunk), "total", F.col("value"), chunk=chunk).collect()}
    runs = {(x.series_id, x.first_ts, x.last_ts, x.n) for x in sequence.runs(df, F.col("value") > 0, chunk=chunk).collect()}
    want = set()
    for s, ts in data.items():
        total, run = 0.0, None
        for i, t in enumerate(ts):
            total += t % 3 == 0
            x = got[s, t * MIN]
            assert (x.before, x.after, x.total) == (ts[i - 1] * MIN if i else None, ts[i + 1] * MIN if i + 1 < len(ts) else None, total)
            if t % 3 == 0:
                run = (run[0], t, run[2] + 1) if run else (t, t, 1)
            if run and (t % 3 or i + 1 == len(ts)):
                want.add((s, run[0] * MIN, run[1] * MIN, run[2]))
                run = None
    assert runs == want


def test_ranks_by_brute_force(spark):
    r = random.Random(2)
    groups = {"one": [3.0], "even": [1.0, 2.0, 3.0, 4.0], "same": [7.0] * 500, "many": [r.gauss(0, 1) for _ in range(3000)], "ties": [float(r.randrange(5)) for _ in range(999)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "series_id string, value double")
    for x in ranks.nearest_rank(df, [0.0, 0.25, 0.5, 0.999, 1.0]).collect():
        v = sorted(groups[x.series_id])
        assert x.v == v[int(np.floor((len(v) - 1) * x.q + 0.5))]
    assert {x.series_id: x.v for x in ranks.nearest_rank(df, [0.5]).collect()}["even"] == 3.0


def test_planted_gap_and_score(spark):
    v = wave(1440)
    obs = series(spark, v).where(~F.col("seq").between(360, 431))
    norm = normalize.normalized(obs)
    (gap,) = checks.gaps(norm, MIN).collect()
    assert (gap.start_ns, gap.end_ns) == (T + 359 * MIN, T + 432 * MIN)
    (s,) = scores.score(checks.completeness_findings(norm, MIN), checks.windows(norm)).collect()
    assert s.completeness == pytest.approx(100 * (1 - 0.6 * 73 / 1440), abs=0.1) and s.validity == 100 and s.overall > 99
    assert checks.gaps(normalize.normalized(series(spark, v)), MIN).isEmpty()


def test_planted_flatline(spark):
    v = wave(2000)
    v[700:900] = [v[700]] * 200
    found = kernels.flat_runs(normalize.normalized(series(spark, v)), 1e-9).collect()
    assert [(x.first_ts, x.n) for x in found] == [(T + 700 * MIN, 200)]


def test_flat_runs_by_brute_force(spark):
    r = random.Random(4)
    v = [float(r.choice([0, 0, 0, 1, 2, 9])) for _ in range(3000)]
    want, i = [], 0
    while i < len(v):
        j = i + 1
        while j < len(v) and abs(v[j] - v[i]) <= 1:
            j += 1
        if j - i >= 5:
            want.append((T + i * MIN, j - i))
        i = j
    assert sorted((x.first_ts, x.n) for x in kernels.flat_runs(normalize.normalized(series(spark, v)), 1.0, 5).collect()) == want


def test_planted_spikes(spark, monkeypatch):
    v = wave(1500)
    for i in (10, 700, 701, 1499):
        v[i] += 80
    norm = normalize.normalized(series(spark, v))
    whole = sorted((x.ts_ns, round(x.z, 9)) for x in kernels.hampel(norm, 0.5).collect())
    assert {T + i * MIN for i in (10, 700, 701, 1499)} <= {t for t, _ in whole}
    monkeypatch.setattr(kernels, "BLOCK", 97)
    assert sorted((x.ts_ns, round(x.z, 9)) for x in kernels.hampel(norm, 0.5).collect()) == whole


def test_change_points_and_interval(spark):
    r = random.Random(6)
    steps = [(sid, b, (20.0 if b < 40 else level) + r.gauss(0, 0.3)) for sid, level in (("moves", 30.0), ("still", 20.0)) for b in range(100)]
    found = kernels.change_points(spark.createDataFrame(steps, "series_id string, bucket long, med double")).collect()
    assert [(x.series_id, x.bucket, x.until) for x in found] == [("moves", 40, None)]
    (x,) = kernels.modal_interval(normalize.normalized(series(spark, wave(50), step=61 * SEC))).collect()
    assert x.interval_ns == MIN


def test_merge_run_grows(spark):
    known = spark.createDataFrame([(1, "s", "c", ["a"], 0, 10, "open", "r1", "r1", 1), (2, "s", "c", ["a"], 100, 110, "resolved", "r1", "r1", 1), (3, "s", "c", ["b"], 0, 10, "acked", "r1", "r1", 1)], "id long, series_id string, check_id string, shape array<string>, start_ns long, end_ns long, status string, first_run string, last_run string, occurrences long")
    new = spark.createDataFrame([(11, "s", "c", ["a"], 8, 20, "r2"), (12, "s", "c", ["a"], 18, 30, "r2"), (13, "s", "c", ["a"], 100, 110, "r2")], "id long, series_id string, check_id string, shape array<string>, start_ns long, end_ns long, run_id string")
    got = {r.id: (r.start_ns, r.end_ns, r.occurrences, r.status) for r in lifecycle.merge_run(known, new).collect()}
    assert got == {1: (0, 30, 2, "open"), 2: (100, 110, 1, "resolved"), 3: (0, 10, 1, "acked"), 13: (100, 110, 1, "open")}


def test_transitions_and_throttle(spark):
    f = spark.createDataFrame([(1, "open"), (2, "resolved"), (3, "open")], "id long, status string")
    c = spark.createDataFrame([(1, "muted", "noise"), (2, "acked", ""), (3, "muted", " ")], "id long, to string, reason string")
    assert {r.id: (r.status, r.changed) for r in lifecycle.transition(f, c).collect()} == {1: ("muted", True), 2: ("resolved", False), 3: ("open", False)}
    m = spark.createDataFrame([("r", t) for t in (0, 1, 2, 50, 200)], "rule_id string, at long")
    assert sorted((r.due_at, r.items) for r in lifecycle.throttle(m, 100).collect()) == [(0, 1), (100, 3), (200, 1)]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    a = series(spark, [1.0] * 100, step=HOUR).unionByName(series(spark, [5.0] * 10, "t"))
    store.write(a, path, "raw", "x", 1)
    store.write(series(spark, [2.0] * 10, step=HOUR), path, "raw", "x", 2)
    got = store.read(spark, path, "raw", "x", ["s"], T, T + 20 * HOUR)
    assert sorted(r.value for r in got.collect()) == [1.0] * 10 + [2.0] * 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_epoch_units(spark):
    for value, unit in ((1_700_000_000, SEC), (1_700_000_000_000, times.MS), (1_700_000_000_000_000, times.US), (T, 1)):
        df = spark.createDataFrame([(value,), (value + 1,), (None,)], "ts long")
        assert [r.ts_ns for r in files.epoch_column(df).orderBy("ts").collect()] == [None, value * unit, (value + 1) * unit]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,series,value,quality\n2024-01-01T00:00:00Z, a ,1.5,good\n2024-01-01 00:01:00,a,oops,bad\n2024-1-1 0:2:0,,3,\n2024-01-01T01:00:00+01:00,b,NA,E\n")
    got = sorted((r.series_id, r.ts_ns, r.value, r.quality) for r in files.read_long(spark, str(tmp_path / "a.csv")).collect())
    t = 1_704_067_200 * SEC
    assert got == [("a", t, 1.5, 0), ("a", t + MIN, None, 2), ("b", t, None, 3)]


@pytest.mark.parametrize("session", ["UTC", "Asia/Tokyo"])
def test_times_of_text(spark, session):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        texts = ["2024-01-01T00:00:00Z", "2024-01-01 01:00:00+01:00", "2024-1-1 0:0:0", "2023-12-31T19:00:00.000-0500", "2024-01-01", "oops", "", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        t = 1_704_067_200 * SEC
        assert [r[0] for r in df.select(files.text_time(F.col("t"))).collect()] == [t] * 5 + [None] * 3
        assert df.limit(3).select(files.text_time(F.col("t"), "Europe/Berlin")).collect()[2][0] == t - HOUR
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_one_series(spark, tmp_path):
    t = 1_704_067_200
    def put(name, text):  # noqa: E306
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good = put("a.csv", f"time,v,q,got\n{t},1.5,good,{t + 1}\n{t + 60},NA,bad,{t + 61}\n")
    want = [("s", t * SEC, 1.5, 0, (t + 1) * SEC), ("s", (t + 60) * SEC, None, 2, (t + 61) * SEC)]
    got = files.read_series(spark, good, "s", "time", "v", "q", "got")
    assert [(r.series_id, r.ts_ns, r.value, r.quality, r.ingest_ns) for r in got.orderBy("seq").collect()] == want
    got.select(F.timestamp_micros(F.expr("ts_ns div 1000")).alias("time"), F.col("value").alias("v")).write.parquet(str(tmp_path / "p"))
    assert sorted(r.ts_ns for r in files.read_series(spark, str(tmp_path / "p"), "s", "time", "v", kind="parquet").collect()) == [w[1] for w in want]
    for text, says in ((f"ts,value\n{t},1\n2024-01-01,2\n{t},3\n", "unlike"), ("ts,value\n2024-01-01,1\nsoon,2\n", "'soon'"), (f"ts,value\n{t},x\n", "no numbers"), ("a,b\n1,2\n", "no column")):
        with pytest.raises(files.BadColumn, match=says):
            files.read_series(spark, put("b.csv", text), "s")
    long = put("c.csv", "ts,series,value\n2024-01-01,a,1\n2024-01-02,,2\n")
    assert files.read_long(spark, long).count() == 1
    with pytest.raises(files.BadColumn, match="without a series"):
        files.read_long(spark, long, strict=True)


def test_streaming(spark, tmp_path):
    drop, path, mark = (str(tmp_path / x) for x in ("drop", "store", "mark"))
    series(spark, [1.0] * 20).write.parquet(drop)
    for _ in range(2):
        ingest.to_store(ingest.read_drop(spark, drop, SCHEMA), path, mark, "raw", "x").awaitTermination()
    assert store.read(spark, path, "raw", "x", ["s"], T, T + HOUR).count() == 20
    series(spark, [9.0] * 5).write.mode("append").parquet(drop)
    ingest.to_store(ingest.read_drop(spark, drop, SCHEMA), path, mark, "raw", "x").awaitTermination()
    assert sorted(r.value for r in store.read(spark, path, "raw", "x", ["s"], T, T + HOUR).collect()) == [1.0] * 15 + [9.0] * 5


def test_m4_keeps_extremes(spark):
    v = wave(5000)
    v[1234] = 500.0
    got = charts.m4(normalize.normalized(series(spark, v)), T, T + 5000 * MIN, 20).collect()
    assert len(got) <= 80 and max(r.value for r in got) == 500.0


def test_without_llm(tmp_path):
    """The entry works without the training-data operators and the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tideline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})


def test_seasonality_break(spark):
    from tideline.operators import seasonal

    v = [50 + 10 * np.sin(2 * np.pi * i / 24) + random.Random(i).gauss(0, 0.3) for i in range(24 * 70)]
    v[24 * 49 :] = [50.0 + random.Random(i).gauss(0, 0.3) for i in range(24 * 21)]
    spine = seasonal.regularise(series(spark, [float(x) for x in v], step=HOUR, start=0), HOUR)
    (x,) = seasonal.breaks(spine, HOUR).collect()
    assert (x.start_ns, x.end_ns, x.period_ns, x.reason) == (49 * DAY, 70 * DAY, DAY, "weaker") and x.strength < 0.3 < 0.9 < x.strength_ref
    one = np.array(v[: 24 * 14])
    got = seasonal.strength(spine.where(F.col("i") < 24 * 14), 24).first().strength
    assert got == pytest.approx(seasonal.strength_of(one, 24)) and seasonal.period_of(one, HOUR, [DAY, 7 * DAY])[0] == DAY


def test_straight_runs(spark):
    from tideline.operators import seasonal

    v = [float(random.Random(i).gauss(0, 5)) for i in range(200)]
    v[50:70] = [float(i) for i in range(20)]
    v[70:90] = [19.0 - 3 * i for i in range(1, 21)]
    got = sorted((x.first_i, x.n) for x in seasonal.straight_runs(normalize.normalized(series(spark, v)), 1e-9).collect())
    assert got == [(50, 20), (70, 20)]


def test_registry():
    from tideline.plans import registry

    for bad in (registry.Config("tby.none"), registry.Config("tby.spikes", {"nope": 1})):
        with pytest.raises(ValueError):
            registry.validate([bad])
    assert len(registry.catalogue()) == len(registry.REGISTRY) == 24
