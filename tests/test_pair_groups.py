"""A pair of series is worked out once, however many groups it is in."""

from pyspark.sql import functions as F

from tideline.functions.times import DAY, SEC
from tideline.operators import group_rules, normalize, profiles, rules
from tideline.operators.tables import written
from tideline.sources import synth

T = 1_699_920_000 * SEC


def test_pair_of_two_groups_is_worked_out_once(spark, monkeypatch):
    obs = synth.generate(spark, 2 * 1440, ["a", "b"], start=T, noise=0.5)
    near = written(profiles.beside(normalize.normalized(obs)), "rows")
    prof = written(profiles.profile(near), "profiles")
    groups = spark.createDataFrame([(g, k, s, i, 1) for g, k in (("g", "related"), ("h", "redundant")) for i, s in enumerate("ab")], group_rules.GROUPS)
    sizes = {}
    monkeypatch.setattr(group_rules, "written", lambda df, name: sizes.update({name: (x := written(df, name)).count()}) or x)
    found = group_rules.correlation_break(rules.Run(obs, near, prof, 0, profiles.basis(prof)), groups)
    bins = near.where(F.col("value").isNotNull()).count()
    assert sizes["aligned"] == bins and sizes["pair-segments"] == 4  # before: 2 * bins
    got = found.metrics.orderBy("name", "ts_ns").collect()
    assert len(got) == 8 and {r.name for r in got} == {"rho:b", "lag_steps:b"} and {r.ts_ns for r in got} == {T, T + DAY}
