"""Each check finds a planted fault in its place and leaves clean series alone; runs with metrics, skips and groups."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.functions.times import DAY, HOUR, MIN, SEC
from tideline.operators import group_rules, normalize, profiles, rules
from tideline.operators.tables import written
from tideline.plans import registry
from tideline.sources import synth

T = 1_699_920_000 * SEC  # midnight
N = 4 * 1440


@pytest.fixture(scope="module")
def clean(spark):
    return written(synth.generate(spark, N, ["a", "b"], start=T, noise=0.5), "clean")


def judged(spark, obs, *names, meta=None, now=None, groups=None, **params):
    known = None if meta is None else spark.createDataFrame([], profiles.META).unionByName(spark.createDataFrame(*meta), allowMissingColumns=True)
    out = registry.run_checks(obs, [registry.Config(registry.PREFIX + n, params) for n in names], meta=known, now=now, groups=groups)
    return out


def rows(out):
    return [(r, json.loads(r.evidence)) for r in out.findings.orderBy("series_id", "start_ns").collect()]


def test_clean_series_pass(spark, clean):
    out = judged(spark, clean, *rules.RULES, now=T + N * MIN)
    assert [(r.check_id, r.evidence) for r in out.findings.collect()] == []
    assert {r.overall for r in out.scores.collect()} == {100.0}
    names = {r.name for r in out.metrics.collect()}
    assert {"completeness", "stale_age_ns", "latency_p95_ns", "regularity", "nan_ratio", "flat_fraction", "spike_count", "noise_ratio", "distinct_density", "linear_share", "level_changes"} <= names
    assert {(r.check_id.split(".")[1], r.reason) for r in out.skipped.collect()} == {("physical_range", "no limits"), ("non_negative", "may be negative")}


PLANTED = [
    ("completeness", lambda o: synth.gap(o, 2000, 300, "a"), 1999, 2300, "high"),
    ("quality_flags", lambda o: synth.flagged(o, 1000, 200, 2, "a"), 1000, 1200, "high"),
    ("value_type", lambda o: synth.missing(o, 1000, 100, "a"), 1000, 1100, "high"),
    ("flatline", lambda o: synth.flatline(o, 1000, 300, "a"), 1000, 1300, "high"),
    ("operational_range", lambda o: synth.constant(o, 1000, 4, 500.0, "a").unionByName(o.limit(0)), None, None, "medium"),
    ("scale_shift", lambda o: synth.scaled(o, 1440, 1440, 10.0, series="a"), 1440, 2880, "critical"),
    ("spikes", lambda o: synth.constant(o, 2500, 1, 300.0, "a"), 2500, 2501, "medium"),
    ("rate_of_change", lambda o: synth.scaled(o, 2500, 1, 1.0, 200.0, "a"), 2499, None, "medium"),
    ("interpolation_artifacts", lambda o: o.withColumn("value", F.when((F.col("series_id") == "a") & F.col("seq").between(1000, 2999), F.col("seq") * 0.5).otherwise(F.col("value"))), 1000, None, "medium"),
    ("distribution_drift", lambda o: o, None, None, "medium"),
    ("timestamp_integrity", lambda o: synth.duplicated(o, 700, 1, 5.0, "a"), None, None, "high"),
    ("sampling_regularity", lambda o: o.where(~((F.col("series_id") == "a") & F.col("seq").between(1440, 2879) & (F.col("seq") % 2 == 1))), 1440, None, "medium"),
]


@pytest.mark.parametrize("name,plant,first,end,severity", [p for p in PLANTED if p[0] not in ("operational_range", "distribution_drift")], ids=lambda x: x if isinstance(x, str) else "")
def test_planted(spark, clean, name, plant, first, end, severity):
    found = rows(judged(spark, plant(clean), name))
    assert {r.series_id for r, _ in found} == {"a"}
    r = max((r for r, _ in found if r.severity == severity), key=lambda r: r.end_ns - r.start_ns if end is not None and end - first > 1 else r.affected)
    if first is not None:
        assert abs(r.start_ns - (T + first * MIN)) <= MIN
    if end is not None:
        assert abs(r.end_ns - (T + end * MIN)) <= MIN
    assert 0 < r.affected <= 1


def test_limits_and_signs(spark, clean):
    obs = synth.constant(clean, 100, 10, -7.0, "a")
    meta = ([("a", "m3/h", 0.0), ("b", "%", None)], "series_id string, unit string, low double")
    found = rows(judged(spark, obs, "physical_range", "non_negative", meta=meta))
    assert {(r.check_id.split(".")[1], r.series_id, r.severity, (r.start_ns - T) // MIN, (r.end_ns - T) // MIN) for r, _ in found} == {("physical_range", "a", "critical", 100, 110), ("non_negative", "a", "high", 100, 110)}
    many = obs.withColumn("value", F.when((F.col("series_id") == "a") & (F.col("seq") % 180 == 7), -9.0).otherwise(F.col("value")))
    ((r, e),) = rows(judged(spark, many, "physical_range", meta=meta))
    assert r.severity == "low" and e["summary_of"] == 33 and len(e["largest"]) == 5


def test_stale_and_late(spark, clean):
    out = rows(judged(spark, clean.where("series_id = 'a' or seq < 5000"), "staleness", now=T + N * MIN))
    assert [(r.series_id, e["age_ns"]) for r, e in out] == [("b", (N - 4999) * MIN)]
    slow = clean.withColumn("ingest_ns", F.when(F.col("series_id") == "a", F.col("ts_ns") + HOUR).when(F.col("seq") == 3, F.col("ts_ns") - HOUR).otherwise(F.col("ingest_ns")))
    out = judged(spark, slow.unionByName(clean.where("series_id = 'a'").withColumn("series_id", F.lit("c")).withColumn("ingest_ns", F.lit(None).cast("long"))), "latency")
    assert {(r.series_id, r.severity) for r, _ in rows(out)} == {("a", "medium"), ("b", "high")}
    assert [r.series_id for r in out.skipped.collect()] == ["c"]


def test_resting_floor(spark, clean):
    """Runs on the floor are idling when they are usual, and an outage when one is far longer."""
    obs = clean.where("series_id = 'a'")
    for first, n in ((0, 90), (600, 90), (1200, 90), (1800, 90), (2400, 90), (3000, 600)):
        obs = synth.constant(obs, first, n, 0.0)
    found = rows(judged(spark, obs, "flatline"))
    assert [((r.start_ns - T) // MIN, e["on_floor"]) for r, e in found] == [(3000, True)]


def test_long_series(spark):
    """Segments of days: noise, resolution, drift, distribution and level of ten weeks at quarters of an hour."""
    n = 70 * 96
    base = written(synth.generate(spark, n, ["a", "b"], interval=15 * MIN, start=T, period=96.0, noise=0.5, amplitude=2.0), "weeks")
    day = lambda d: d * 96
    a, seq, v = F.col("series_id") == "a", F.col("seq"), F.col("value")
    put = lambda where, value: base.withColumn("value", F.when(a & where, value).otherwise(v))
    plans = {
        "noise_level": (put(seq.between(day(30), day(32) - 1), v + 6 * synth.normal(5, seq)), 30, 32),
        "resolution_loss": (put(seq.between(day(30), day(32) - 1), F.round(v / 5) * 5), 30, 32),
        "distribution_drift": (put(seq.between(day(30), day(33) - 1), v + 9), 30, 33),
        "level_drift": (put(F.lit(True), v + seq / 96 * 0.2), 0, 70),
        "changepoint": (put(seq >= day(40), v + 20), 40, 70),
        "seasonality_break": (put(seq >= day(49), 50 + 0.5 * synth.normal(6, seq)), None, None),
    }
    for name, (obs, first, end) in plans.items():
        params = {"least": 90} if name == "distribution_drift" else {}
        found = rows(judged(spark, obs, name, **params))
        assert {r.series_id for r, _ in found} == {"a"}, name
        if first is not None:
            assert any(abs(r.start_ns - T - first * DAY) <= DAY and (name == "changepoint" or abs(r.end_ns - T - end * DAY) <= DAY) for r, _ in found), (name, found)
    ramp = put(F.lit(True), v + seq / 96 * 0.5)
    assert rows(judged(spark, ramp, "changepoint")) == [], "a ramp is no step"


def test_groups(spark):
    n = 20 * 96
    x = synth.generate(spark, n, ["in"], interval=15 * MIN, start=T, period=96.0, noise=3.0)
    own = lambda name, value: x.withColumn("series_id", F.lit(name)).withColumn("value", value)
    v, seq, jitter = F.col("value"), F.col("seq"), lambda s: 0.05 * synth.normal(s, F.col("seq"))
    late = seq.between(10 * 96, 12 * 96 - 1)
    obs = x.unionByName(own("half", v * 0.5 + jitter(3))).unionByName(own("rest", v * 0.5 * F.when(late, 0.6).otherwise(1.0) + jitter(4)))
    obs = obs.unionByName(own("twin", v + jitter(5) + F.when(late, 9.0).otherwise(0.0))).unionByName(own("third", v + jitter(6))).unionByName(own("other", F.when(late, 50 + 10 * synth.normal(8, seq)).otherwise(v) + jitter(7)))
    members = [("sum", "balance", "in", 0, 1), ("sum", "balance", "half", 1, -1), ("sum", "balance", "rest", 2, -1), ("same", "redundant", "in", 0, 1), ("same", "redundant", "twin", 1, 1), ("same", "redundant", "third", 2, 1), ("like", "related", "in", 0, 1), ("like", "related", "other", 1, 1), ("lame", "balance", "in", 0, 1), ("lame", "balance", "gone", 1, -1)]
    out = judged(spark, obs, *group_rules.RULES, groups=spark.createDataFrame(members, group_rules.GROUPS))
    got = {(r.check_id.split(".")[1], r.series_id, (r.start_ns - T) // DAY, -((T - r.end_ns) // DAY)): e for r, e in rows(out) if r.end_ns - r.start_ns >= HOUR}
    assert set(got) == {("balance_residual", "rest", 10, 12), ("redundant_disagreement", "twin", 10, 12), ("correlation_break", "in", 10, 12)}
    assert got["balance_residual", "rest", 10, 12]["reason"] == "above_band" and got["correlation_break", "in", 10, 12]["partner"] == "other"
    assert {r.series_id for r in out.skipped.where("check_id like '%balance%'").collect()} == {"in", "gone"}
    assert {r.name.split(":")[0] for r in out.metrics.collect()} == {"rho", "lag_steps", "max_abs_diff", "residual_mean", "loss_share_mean"}


def test_run_of_nothing(spark, clean):
    out = registry.run_checks(clean.limit(0), now=T)
    assert [df.count() for df in out] == [0, 0, 0, 0]
    assert registry.last_metrics(out.metrics, out.metrics).count() == 0


def test_extreme_times(spark):
    """The first and last times that a bigint holds."""
    ends = [-(2**63), -(2**63) + 1, 0, 2**63 - 2, 2**63 - 1]
    obs = spark.createDataFrame([("s", i, t, float(i), 0, t) for i, t in enumerate(ends)], normalize.OBS)
    out = judged(spark, obs, "completeness", "sampling_regularity", "quality_flags", "value_type", "physical_range", "rate_of_change", "level_drift", meta=([("s", 1.5)], "series_id string, high double"), now=0)
    assert all(r.start_ns <= r.end_ns for r in out.findings.collect()) and out.scores.count() == 1


def test_synth_is_the_same_however_cut(spark):
    a = synth.generate(spark, 25_000, 2, seed=3)
    assert a.count() == 50_000 and synth.generate(spark, 0).count() == 0
    hashed = lambda df: df.select(F.bit_xor(F.xxhash64(*df.columns))).first()[0]
    assert hashed(a) == hashed(synth.generate(spark, 25_000, 2, seed=3).repartition(7)) != hashed(synth.generate(spark, 25_000, 2, seed=4))
    v = a.agg(F.avg("value"), F.stddev("value")).first()
    assert abs(v[0] - 50) < 1 and 6 < v[1] < 8
