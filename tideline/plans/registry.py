"""Checks by name with their parameters, and runs of several checks over all series and groups at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from inspect import signature
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import checks, group_rules, normalize, rules, scores
from tideline.operators import profiles as own
from tideline.operators.checks import PREFIX
from tideline.operators.tables import written

FINDING = "check_id string, series_id string, dimension string, severity string, start_ns long, end_ns long, affected double, evidence string"
METRIC = "check_id string, series_id string, name string, ts_ns long, value double"
SKIPPED = "check_id string, series_id string, reason string"


@dataclass(frozen=True)
class Config:
    """A check to run, with parameters of its rule; those that are None are left at their defaults."""

    id: str
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True


@dataclass(frozen=True)
class Check:
    """A rule, and the dimension and usual severity of its findings. Rules of groups take the groups too."""

    id: str
    dimension: str
    severity: str
    rule: Any
    groups: bool

    def params(self) -> dict[str, Any]:
        return {k: p.default for k, p in list(signature(self.rule).parameters.items())[2 if self.groups else 1 :]}


class Result(NamedTuple):
    findings: DataFrame
    metrics: DataFrame
    skipped: DataFrame
    scores: DataFrame


REGISTRY = {PREFIX + name: Check(PREFIX + name, dimension, severity, rule, kind is group_rules.RULES) for kind in (rules.RULES, group_rules.RULES) for name, (dimension, severity, rule) in kind.items()}


def validate(configs: list[Config]) -> None:
    """Unknown checks and parameters are errors."""
    for c in configs:
        if c.id not in REGISTRY:
            raise ValueError(f"no such check: {c.id}")
        if extra := set(c.params) - set(REGISTRY[c.id].params()):
            raise ValueError(f"{c.id} has no parameter {', '.join(sorted(extra))}")


def catalogue() -> list[dict[str, Any]]:
    return [{"id": c.id, "dimension": c.dimension, "severity": c.severity, "groups": c.groups, "params": c.params()} for c in REGISTRY.values()]


def run_checks(obs: DataFrame, configs: list[Config] | None = None, meta: DataFrame | None = None, groups: DataFrame | None = None, now: int | None = None, profiles: DataFrame | None = None, write: tuple[str, ...] = ("findings", "metrics")) -> Result:
    """``(findings, metrics, skipped, scores)`` of all series of ``obs``. Those named in ``write`` are worked out here, as one table
    each; the others when they are read (scores read findings three times, so these are best written for them). ``meta`` (as of
    ``profiles.META``) tells what is known of series, ``groups`` (as of ``group_rules.GROUPS``) which belong together,
    ``now`` the time that series are stale by (staleness is not judged without). ``profiles`` (as of
    ``baselines.profiles_of``) gives baselines; a series that has one is held against it, others against themselves, and
    evidence says which.

    The source is read for the deliveries' own checks and to normalise it; rows with the row before and profiles are
    written once, and all other checks read these. Empty input gives empty results."""
    configs = [Config(i) for i in REGISTRY] if configs is None else configs
    validate(configs)
    spark = obs.sparkSession
    near = written(own.beside(normalize.normalized(obs)), "rows")
    prof = written(own.profile(near, meta), "profiles")
    base = own.basis(prof) if profiles is None else written(own.basis(prof, profiles), "bases")
    run = rules.Run(obs, near, prof, 0 if now is None else now, base)
    members = spark.createDataFrame([], group_rules.GROUPS) if groups is None else groups
    found, metrics, skipped = (spark.createDataFrame([], schema) for schema in (FINDING, METRIC, SKIPPED))
    for c in configs:
        check = REGISTRY[c.id]
        if not c.enabled or check.groups and groups is None:
            continue
        if c.id == PREFIX + "staleness" and now is None:
            skipped = skipped.unionByName(prof.select(F.lit(c.id).alias("check_id"), "series_id", F.lit("no time is given").alias("reason")))
            continue
        params = {k: v for k, v in c.params.items() if v is not None}
        out = check.rule(run, members, **params) if check.groups else check.rule(run, **params)
        tag = lambda df: df.withColumn("check_id", F.lit(c.id))  # noqa: B023, E731
        if out.findings is not None:
            found = found.unionByName(tag(out.findings).withColumn("dimension", F.lit(check.dimension)).select(*found.columns))
        if out.metrics is not None:
            metrics = metrics.unionByName(tag(out.metrics).select(*metrics.columns))
        if out.skipped is not None:
            skipped = skipped.unionByName(tag(out.skipped).select(*skipped.columns))
    found = written(found, "findings") if "findings" in write else found
    metrics = written(metrics, "metrics") if "metrics" in write else metrics
    window = prof.select("series_id", "w_start", "w_end")
    return Result(found, metrics, skipped, scores.score(found, window))


def last_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics by check, series, name and time: the newer run's value where both have one."""
    key = ["check_id", "series_id", "name", "ts_ns"]
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))
