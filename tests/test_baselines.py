"""Windows, fits and versions of baselines, and runs that are held against them."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.functions.times import DAY, HOUR, MIN, SEC
from tideline.operators import baselines, normalize, profiles
from tideline.operators.tables import written
from tideline.plans import registry
from tideline.sources import synth

T = 1_699_920_000 * SEC
N = 4 * 1440


@pytest.fixture(scope="module")
def clean(spark):
    return written(synth.generate(spark, N, ["a", "b"], start=T, noise=0.5), "clean")


@pytest.fixture(scope="module")
def given(spark, clean):
    return written(profiles.profile(written(profiles.beside(normalize.normalized(clean)), "rows")), "given")


def found(obs, *names, profiles=None, **params):
    out = registry.run_checks(obs, [registry.Config(registry.PREFIX + n, params) for n in names], profiles=profiles)
    return [(x.check_id.split(".")[1], x.series_id, json.loads(x.evidence)) for x in out.findings.collect()]


def test_windows_are_halved_until_rows_fit(spark):
    cover = [("a", T, T + 60 * DAY, 6000), ("b", T, T + 2 * DAY, 10), ("c", T, T + DAY, 5000), ("d", T + 9 * DAY, T + 10 * DAY, 350), ("d", T, T + 9 * DAY, 90)]
    got = {x.series_id: (x.from_ns, x.to_ns, x.est_rows) for x in baselines.fit_window(spark.createDataFrame(cover, "series_id string, range_start long, range_end long, n_rows long"), 399).collect()}
    assert got == {"a": (T + 57 * DAY, T + 60 * DAY, 300), "b": (T, T + 2 * DAY, 10), "c": (None, T + DAY, None), "d": (T + 3 * DAY, T + 10 * DAY, 410)} | {"d": (T + 7 * DAY, T + 10 * DAY, 370)}


def covered(spark, rows, days=4):
    return spark.createDataFrame([(s, T, T + days * DAY, n) for s, n in rows], "series_id string, range_start long, range_end long, n_rows long")


FINDINGS = "series_id string, start_ns long, end_ns long, severity string, status string"


def test_fit_learns_from_trusted_rows(spark, clean):
    obs = synth.flagged(synth.missing(clean, 200, 30, "a"), 100, 50, 2, "a").unionByName(clean.limit(0))
    critical = spark.createDataFrame([("a", T + 300 * MIN, T + 310 * MIN, "critical", "open"), ("a", T + 400 * MIN, T + 400 * MIN, "critical", "open"), ("a", T, T + DAY, "critical", "resolved"), ("a", T, T + DAY, "high", "open"), ("b", T - DAY, T, "critical", "open")], FINDINGS)
    few = normalize.normalized(obs.where("series_id = 'b' or seq < 5000").unionByName(obs.where("seq < 40 and series_id = 'a'").withColumn("series_id", F.lit("few"))))
    cover = covered(spark, [("a", 5000), ("b", N), ("few", 40), ("none", 10), ("large", 10**9)])
    got = {x.series_id: x for x in baselines.fit(few, cover, critical, 100_000).collect()}
    assert {s: x.status for s, x in got.items()} == {"a": "fitted", "b": "fitted", "few": "too_few", "none": "no_data", "large": "too_large"}
    a = got["a"]
    assert a.n_samples == 5000 - 50 - 30 - 11 and (a.excluded.bad, a.excluded.findings) == (50, 11)
    assert [(w.start_ns, w.end_ns) for w in a.excluded.windows] == [(T + 300 * MIN, T + 310 * MIN), (T + 400 * MIN, T + 400 * MIN + 1)]
    want = profiles.profile(written(profiles.beside(baselines.trusted(few.where("series_id = 'a'"), critical).where("taken is null").drop("taken")), "want")).first()
    assert all(a.profile[c] == want[c] for c in baselines.KEPT) and a.profile.good == 1.0


def test_a_window_may_hold_more_than_expected(spark, clean):
    got = baselines.fit(normalize.normalized(clean), covered(spark, [("a", 10), ("b", 10)]), spark.createDataFrame([], FINDINGS), 1000).collect()
    assert {(x.series_id, x.status) for x in got} == {("a", "too_large"), ("b", "too_large")}


def test_versions_change_only_with_the_fit(spark, clean):
    cover, none = covered(spark, [("a", N), ("b", N)]), spark.createDataFrame([], FINDINGS)
    first = written(baselines.fit(normalize.normalized(clean), cover, none, 10**6), "first")
    moved = written(baselines.fit(normalize.normalized(synth.constant(clean, 10, 5, 99.0, "b")), cover, none, 10**6), "moved")
    state, told = baselines.store(None, first, 1)
    assert {tuple(x) for x in told.collect()} == {("a", "stored", 1), ("b", "stored", 1)}
    state = written(state, "v1")
    again, told = baselines.store(state, first, 2)
    assert {tuple(x) for x in told.collect()} == {("a", "unchanged", 1), ("b", "unchanged", 1)} and again.count() == 2
    state, told = baselines.store(state, moved, 3)
    assert {tuple(x) for x in told.collect()} == {("a", "unchanged", 1), ("b", "stored", 2)}
    state = written(state, "v2")
    assert {(x.series_id, x.version, x.at_ns) for x in state.collect()} == {("a", 1, 1), ("b", 1, 1), ("b", 2, 3)}
    assert {(x.series_id, x.version) for x in baselines.store(state, first, 4, keep=2)[0].collect()} == {("a", 1), ("b", 2), ("b", 3)}
    assert baselines.profiles_of(state).where("series_id = 'b'").first().highest == 99.0


def test_due_series(spark):
    now = T + 10 * DAY
    series = spark.createDataFrame([("new", None), ("old", T), ("older", T - DAY), ("fresh", now - HOUR), ("bare", None)], "series_id string, baseline_at long")
    cover = spark.createDataFrame([(s,) for s in ("new", "old", "older", "fresh")] * 2, "series_id string")
    assert [x.series_id for x in baselines.due(series, cover, now).collect()] == ["new", "older", "old"]
    assert [x.series_id for x in baselines.due(series, cover, now, most=1).collect()] == ["new"]


def shifted(clean, by, series="a"):
    return clean.withColumn("value", F.when(F.col("series_id") == series, F.col("value") + by).otherwise(F.col("value")))


def test_a_shift_of_the_whole_window_shows_only_against_a_baseline(clean, given):
    """Held against itself a series that has moved as a whole looks as ever."""
    obs = shifted(clean, 40.0)
    assert found(obs, "operational_range", "distribution_drift") == []
    got = found(obs, "operational_range", "distribution_drift", profiles=given)
    assert {(c, s) for c, s, _ in got} == {("operational_range", "a"), ("distribution_drift", "a")}
    assert {e["baseline"] for _, _, e in got} == {"baseline"}


def test_series_without_a_baseline_are_held_against_themselves(clean, given):
    obs = clean.withColumn("value", F.col("value") + F.col("seq") / 288)
    got = found(obs, "level_drift", profiles=given.where("series_id = 'a'"), least_segments=3)
    assert {(s, e["baseline"]) for _, s, e in got} == {("a", "baseline"), ("b", "self")}


def test_noise_and_units_against_a_baseline(clean, given):
    noisy = clean.withColumn("value", F.when(F.col("series_id") == "a", F.col("value") + 30 * F.randn(3)).otherwise(F.col("value")))
    got = found(noisy, "noise_level", profiles=given, least_segments=3)
    assert [(s, e["whole_window"], e["direction"], e["baseline"]) for _, s, e in got] == [("a", True, "noisier", "baseline")]
    tenfold = clean.withColumn("value", F.when(F.col("series_id") == "a", F.col("value") * 10).otherwise(F.col("value")))
    assert found(tenfold, "scale_shift") == []
    got = found(tenfold, "scale_shift", profiles=given)
    assert {(s, e["candidate"], e["baseline"]) for _, s, e in got} == {("a", "x10", "baseline")} and len(got) == 4


def test_ramp_is_judged_by_the_baselines_noise(spark, given):
    """A ramp over two weeks drifts by more than the noise of a steady baseline."""
    ramp = synth.generate(spark, 14 * 1440, ["a"], start=T, noise=0.5).withColumn("value", F.col("value") + F.col("seq") / 1440)
    ((_, s, e),) = found(ramp, "level_drift", profiles=given)
    assert s == "a" and e["baseline"] == "baseline" and e["segment_ns"] == DAY and 0.8 < e["slope_per_day"] < 1.2
    calm = given.withColumn("noise_sigma", F.lit(1e6))
    assert found(ramp, "level_drift", profiles=calm) == []


def test_mostly_constant_baselines_have_no_flat_runs(clean, given):
    obs = synth.flatline(clean, 1000, 300)
    assert {s for _, s, _ in found(obs, "flatline", profiles=given)} == {"a", "b"}
    quiet = given.withColumn("constant_fraction", F.when(F.col("series_id") == "a", 0.9).otherwise(0.1))
    assert {s for _, s, _ in found(obs, "flatline", profiles=quiet)} == {"b"}
    frozen = clean.withColumn("value", F.lit(5.0))
    assert {s for _, s, _ in found(frozen, "flatline", profiles=quiet)} == {"a", "b"}


def test_rates_and_steps_of_a_baseline(clean, given):
    steep = given.withColumn("rate_p999", F.lit(1e9))
    obs = synth.scaled(clean, 2500, 1, 1.0, 200.0, "a")
    assert {(s, e["baseline"]) for _, s, e in found(obs, "rate_of_change", profiles=given)} == {("a", "baseline")} and found(obs, "rate_of_change", profiles=steep) == []
    coarse = clean.withColumn("value", F.round("value"))
    got = found(coarse, "resolution_loss", profiles=given)
    assert {(s, e["baseline"]) for _, s, e in got} == {("a", "baseline"), ("b", "baseline")}
    spiky = synth.constant(clean, 2500, 1, 300.0, "a")
    assert {s for _, s, _ in found(spiky, "spikes", profiles=given)} == {"a"} and found(spiky, "spikes", profiles=given.withColumn("resolution", F.lit(1e6))) == []
