"""Data sources: made-up points that prune and split at will, and pages that lose and repeat nothing."""

import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.functions.times import DAY, HOUR, MIN, SEC
from tideline.sources import connectors

T = 1_704_067_200 * SEC
POINTS = [{"series_id": "a"}, {"series_id": "b", "base": 5.0, "amplitude": 2.0, "period_s": 3600, "noise": 0.0}, {"series_id": "c", "faults": ["flatline", "spikes"]}]


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    connectors.register(spark)


def synthetic(spark, **more):
    options = {"points": json.dumps(POINTS), "start_ns": T + 1, "end_ns": T + 2 * DAY, "seed": 3} | more
    return spark.read.format("tideline_synthetic").options(**options).load()


def test_any_split_gives_the_same_rows(spark):
    whole = sorted(map(tuple, synthetic(spark).collect()))
    assert len(whole) == 3 * (2 * 1440 - 1) and whole[0][1] == T + MIN
    parts = synthetic(spark, rows=100)
    assert parts.rdd.getNumPartitions() == 3 * 29 and sorted(map(tuple, parts.collect())) == whole
    assert sorted(map(tuple, synthetic(spark, start_ns=T + DAY).collect())) == [r for r in whole if r[1] >= T + DAY]
    assert sorted(map(tuple, synthetic(spark, seed=4).collect())) != whole


def test_filters_prune_partitions(spark):
    df = synthetic(spark, rows=60)
    some = df.where((F.col("series_id") == "b") & (F.col("ts_ns") >= T + HOUR) & (F.col("ts_ns") < T + 3 * HOUR))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 120
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString() or some.count() == 120
    assert df.where(F.col("series_id").isin("a", "c") & (F.col("ts_ns") == T + HOUR)).count() == 2
    assert df.where("series_id = 'none'").count() == 0 and df.where(f"ts_ns > {T} and ts_ns <= {T + MIN}").count() == 3


def test_values_and_faults():
    ts = np.arange(T, T + 2 * DAY, MIN)
    plain = connectors.values(connectors.Point("b", 5.0, 2.0, 3600, 0.0), 0, MIN, ts)
    assert plain[15] == pytest.approx(7.0) and plain.min() == pytest.approx(3.0)
    point = connectors.Point("c", faults=("flatline",))
    flat = connectors.values(point, 3, MIN, ts)
    assert len(set(flat[120:180])) == 1 and len(set(flat[180:240])) == 60
    assert connectors.values(point, 3, MIN, ts[500:600]).tolist() == flat[500:600].tolist()
    spiky = connectors.values(connectors.Point("c", faults=("spikes",)), 3, MIN, ts) - connectors.values(connectors.Point("c"), 3, MIN, ts)
    assert sorted(set(spiky.round(6))) == [0.0, 80.0] and (spiky > 1).sum() in (2, 3)
    noise = connectors.values(connectors.Point("n", 0.0, 0.0, 60, 1.0), 1, MIN, np.arange(T, T + 40 * DAY, MIN))
    assert -1 <= noise.min() < -0.99 and 0.99 < noise.max() < 1 and abs(noise.mean()) < 0.01
    assert (connectors.values(point, 3, MIN, np.arange(-5 * DAY, 0, HOUR)) != 0).all()


def test_bad_points(spark):
    with pytest.raises(Exception, match="distinct"):
        synthetic(spark, points=json.dumps([{"series_id": "a"}] * 2)).count()


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Series of which up to nine rows have one time."""
    path, r, rows = tmp_path_factory.mktemp("archive"), random.Random(5), {}
    for s in ("p", "q"):
        at, own = T, []
        while len(own) < 400:
            own += [(at, float(len(own) + k), k % 4) for k in range(r.choice((1, 1, 2, 5, 9)))]
            at += r.choice((1, MIN, 3 * HOUR))
        rows[s] = own
        pq.write_table(pa.table(dict(zip(("ts_ns", "value", "quality"), map(list, zip(*own))))), path / f"{s}.parquet")
    return str(path), rows


def options(path, **more):
    return {"series": json.dumps(["p", "q"]), "config": json.dumps({"path": f"file://{path}"}), "start_ns": T, "end_ns": T + 400 * DAY} | more


@pytest.mark.parametrize("limit", [1, 3, 7, 1000])
def test_pages_lose_and_repeat_nothing(archive, limit):
    path, rows = archive
    source = connectors.FileConnector({"path": f"file://{path}"})
    got = list(connectors.pages(source, "p", T, T + 400 * DAY, limit))
    assert [x for page in got for x in page] == rows["p"] and all(len(p) <= limit for p in got)
    inner = [r for r in rows["q"] if T + DAY <= r[0] < T + 3 * DAY]
    assert [x for page in connectors.pages(source, "q", T + DAY, T + 3 * DAY, limit) for x in page] == inner


def test_windows_in_batch(spark, archive):
    path, rows = archive
    df = spark.read.format("tideline_pages").options(**options(path, page=4, window_ns=5 * DAY)).load()
    want = sorted((s, *r) for s in rows for r in rows[s])
    assert sorted(map(tuple, df.collect())) == want
    late = df.where((F.col("series_id") == "q") & (F.col("ts_ns") >= T + 10 * DAY))
    assert sorted(map(tuple, late.collect())) == [r for r in want if r[0] == "q" and r[1] >= T + 10 * DAY]


def test_stream_over_restarts(spark, archive, tmp_path):
    """A batch may end in the middle of a time, and a query be stopped and started."""
    path, rows = archive
    want = sorted((s, *r) for s in rows for r in rows[s])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(3):
        stream = spark.readStream.format("tideline_pages").options(**options(path, page=7, pages=5)).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert sorted(map(tuple, spark.read.parquet(out).select("series_id", "ts_ns", "value", "quality").collect())) == want


def test_connector_interface(archive):
    path, _ = archive
    source = connectors.FileConnector({"path": f"file://{path}"})
    source.check()
    assert source.search("P", 5) == ["p"] and source.search("", 1) == ["p"]
    with pytest.raises(FileNotFoundError):
        connectors.FileConnector({"path": "file:///none/such"}).check()

    class Stuck(connectors.Connector):
        def page(self, series, start, end, skip, limit):
            return connectors.Page([], True)

    with pytest.raises(RuntimeError):
        list(connectors.pages(Stuck({}), "s", 0, 5, 2))
    with pytest.raises(NotImplementedError):
        Stuck({}).search("x", 1)


def test_pacer():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    pacer = connectors.Pacer(2, share=3, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        pacer.wait()
    now[0] += 100
    pacer.wait()
    assert slept == [1.5, 1.5]
    connectors.Pacer(0).wait()
