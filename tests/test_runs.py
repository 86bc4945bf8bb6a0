"""What a run works out: only what its query returns."""

from tideline.functions.times import SEC
from tideline.operators.tables import written
from tideline.plans import queries, registry
from tideline.sources import synth

T = 1_699_920_000 * SEC
SF = "/root/testdata/sf0.001"


def test_each_query_makes_its_own_run(spark, monkeypatch):
    asked = []

    def run(obs, write, **rest):
        asked.append(write)
        return registry.Result(*[obs] * 4)

    monkeypatch.setattr(registry, "run_checks", run)
    for name in ("run_all_checks", "run_metrics", "run_scores", "run_scores"):
        queries.QUERIES[name](spark, SF)
    assert asked == [("findings",), ("metrics",), ("findings",), ("findings",)]  # before: one run, kept by path


def test_only_what_is_asked_is_written(spark, monkeypatch):
    names = []
    monkeypatch.setattr(registry, "written", lambda df, name: names.append(name) or written(df, name))
    obs, one = synth.generate(spark, 1440, ["a", "b"], start=T), [registry.Config(registry.PREFIX + "completeness")]
    both = registry.run_checks(obs, one)
    names.clear()
    out = registry.run_checks(obs, one, write=("metrics",))
    assert names == ["rows", "profiles", "metrics"]
    assert sorted(out.metrics.collect()) == sorted(both.metrics.collect()) and sorted(out.scores.collect()) == sorted(both.scores.collect())
