"""Findings across runs, baselines, alerts and the queries over them. Each takes the old rows and what
is new and returns rows; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.meaning import SEVERITY
from tideline.functions.times import DAY

ALLOWED = {"open": ("acked", "muted", "resolved"), "acked": ("resolved", "open"), "muted": ("open",), "resolved": ("open",)}


def shape(evidence: Column) -> Column:
    """The sorted top-level keys of JSON evidence, which tell kinds of findings apart."""
    return F.array_sort(F.json_object_keys(evidence))


def candidates(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """For each incoming finding the open or acked known one of the same series, check, evidence shape, group and
    partner (null equals null) that overlaps it most (by intersection over union; the earliest on a tie)."""
    same = ["series_id", "check_id", "shape"]
    extra = ["group_id", "partner"]
    text = lambda df: df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in extra})
    x = text(incoming).select(F.col("id").alias("new_id"), *same, *extra, F.col("start_ns").alias("ns"), F.col("end_ns").alias("ne"), F.col("run_id").alias("run"))
    y = text(known).where(F.col("status").isin("open", "acked"))
    met = x.join(y, [*same, *extra]).where("start_ns < ne and end_ns > ns and first_run <> run")
    iou = (F.least("ne", "end_ns") - F.greatest("ns", "start_ns")) / (F.greatest("ne", "end_ns") - F.least("ns", "start_ns"))
    best = F.max_by(F.col("id"), F.struct(iou.alias("iou"), (-F.col("start_ns")).alias("s"), (-F.col("id")).alias("i")))
    return met.groupBy("new_id").agg(best.alias("known_id"), F.max(iou).alias("iou"))


#: Known findings across runs.
STATE = "id long, series_id string, check_id string, shape array<string>, group_id string, partner string, start_ns long, end_ns long, status string, first_run string, last_run string, occurrences long"


def merge_run(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known findings (as of ``STATE``) after a run: matched ones take the union of the windows and one more occurrence,
    others are new. Findings match within a series, check, evidence shape, group and partner, in order of their
    start, as a window that grew may match the next one.

    Windows that nothing connects can't match. So findings are first cut into stretches of windows that overlap
    (as of any earlier end), and only a stretch is folded in order, in one task."""
    columns = [f.split()[0] for f in STATE.split(", ")]
    extra = {c: F.lit(None).cast("string") for c in ("group_id", "partner")}
    old = known.withColumns({c: v for c, v in extra.items() if c not in known.columns}).select(*columns, F.lit(False).alias("incoming"))
    new = incoming.withColumns({c: v for c, v in extra.items() if c not in incoming.columns})
    new = new.select("id", "series_id", "check_id", "shape", "group_id", "partner", "start_ns", "end_ns", F.lit("open").alias("status"), F.col("run_id").alias("first_run"), F.col("run_id").alias("last_run"), F.lit(1).cast("long").alias("occurrences"), F.lit(True).alias("incoming"))
    key = ["series_id", "check_id", "_shape", "_group", "_partner"]
    both = old.unionByName(new).withColumns({"_shape": F.to_json("shape"), "_group": F.coalesce("group_id", F.lit("")), "_partner": F.coalesce("partner", F.lit(""))})
    w = Window.partitionBy(*key).orderBy("start_ns", "end_ns", "id")
    reach = F.max("end_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = both.withColumn("_new", F.when(F.coalesce(reach > F.col("start_ns"), F.lit(False)), 0).otherwise(1)).withColumn("_stretch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = rows[~rows["incoming"]].sort_values(["start_ns", "id"]).to_dict("records")
        for new in rows[rows["incoming"]].sort_values(["start_ns", "end_ns", "id"]).to_dict("records"):
            best, best_iou = None, 0.0
            for old in state:
                inter = min(old["end_ns"], new["end_ns"]) - max(old["start_ns"], new["start_ns"])
                if inter > 0 and old["status"] in ("open", "acked") and old["first_run"] != new["first_run"]:
                    iou = inter / (max(old["end_ns"], new["end_ns"]) - min(old["start_ns"], new["start_ns"]))
                    if iou > best_iou or iou == best_iou and best and (old["start_ns"], old["id"]) < (best["start_ns"], best["id"]):
                        best, best_iou = old, iou
            if best is None:
                state.append(new)
            else:
                best["start_ns"], best["end_ns"] = min(best["start_ns"], new["start_ns"]), max(best["end_ns"], new["end_ns"])
                best["occurrences"] += best["last_run"] != new["last_run"]
                best["last_run"] = new["last_run"]
        return pd.DataFrame(state, columns=columns)

    return cut.groupBy(*key, "_stretch").applyInPandas(fold, STATE)


def transition(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """``findings`` with ``changes (id, to, reason)`` applied where the step is allowed; ``changed`` says so.
    Muting needs a reason."""
    allowed = F.lit(False)
    for was, to in ALLOWED.items():
        allowed |= (F.col("status") == was) & F.col("to").isin(*to)
    ok = F.coalesce(allowed & ((F.col("to") != "muted") | (F.length(F.trim("reason")) > 0)), F.lit(False))
    return findings.join(changes, "id", "left").withColumn("changed", ok).withColumn("status", F.when(F.col("changed"), F.col("to")).otherwise(F.col("status"))).drop("to", "reason")


def expire_mutes(findings: DataFrame, now: int) -> DataFrame:
    over = (F.col("status") == "muted") & (F.col("muted_until") <= now)
    return findings.withColumn("status", F.when(over, "open").otherwise(F.col("status"))).withColumn("muted_until", F.when(~over, F.col("muted_until")))


def roll_up(findings: DataFrame, by: str, most: int = 500) -> DataFrame:
    """Counts, by severity too, and the latest start for each ``by``, most first; one row more than
    ``most`` tells that there are more."""
    severities = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY]
    return findings.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n"), *severities, F.max("start_ns").alias("latest")).orderBy(F.col("n").desc(), "key").limit(most + 1)


def page(findings: DataFrame, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """Newest start first, then id; ``after`` is the last (start_ns, id) seen."""
    if after:
        start, last = after
        findings = findings.where((F.col("start_ns") < start) | ((F.col("start_ns") == start) & (F.col("id") < last)))
    return findings.orderBy(F.col("start_ns").desc(), F.col("id").desc()).limit(size + 1)


def latest(scores: DataFrame) -> DataFrame:
    return scores.groupBy("series_id").agg(F.max_by(F.struct("overall", "computed_at"), F.struct("computed_at", "run_id")).alias("x")).select("series_id", "x.*")


def crossings(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores below the threshold whose series' score before was not, or that have none before."""
    w = Window.partitionBy("series_id").orderBy("computed_at", "run_id")
    return scores.withColumn("before", F.lag("overall").over(w)).where((F.col("overall") < threshold) & (F.col("before").isNull() | (F.col("before") >= threshold)))


def alert_matches(findings: DataFrame, least: str, checks: list[str] | None = None, dimensions: list[str] | None = None) -> DataFrame:
    order = list(SEVERITY)
    out = findings.where(F.col("severity").isin(order[order.index(least) :]))
    out = out.where(F.col("check_id").isin(checks)) if checks else out
    return out.where(F.col("dimension").isin(dimensions)) if dimensions else out


def throttle(matches: DataFrame, quiet: int) -> DataFrame:
    """``(rule_id, due_at, items, first_at, last_at)``: matches ``(rule_id, at)`` gathered into notices at least ``quiet``
    apart. A rule's matches stream through one task in order, with one notice held."""
    columns = ["rule_id", "due_at", "items", "first_at", "last_at"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None
        for rows in batches:
            out = []
            for rule, at in rows[["rule_id", "at"]].itertuples(index=False):
                if held and held[0] == rule and at <= held[1]:
                    held[2], held[4] = held[2] + 1, at
                    continue
                due = max(at, held[1] + quiet) if held and held[0] == rule else at
                if held:
                    out.append(held)
                held = [rule, due, 1, at, at]
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([held], columns=columns)

    return matches.select("rule_id", "at").repartition("rule_id").sortWithinPartitions("rule_id", "at").mapInPandas(fold, "rule_id string, due_at long, items long, first_at long, last_at long")


def select_findings(findings: DataFrame, status: list[str] | None = None, severities: list[str] | None = None, checks: list[str] | None = None, dimensions: list[str] | None = None, series: list[str] | None = None, series_prefix: str | None = None, check_like: str | None = None, assets: list[str] | None = None, asset_prefix: str | None = None, group_id: str | None = None, partner: str | None = None, since_ns: int | None = None, until_ns: int | None = None, run_id: str | None = None) -> DataFrame:
    """Findings that meet all the conditions given. ``check_like`` is a part of the check's id in any case, taken as it is
    (no wildcards); the times select windows that reach into ``[since_ns, until_ns)``."""
    for column, values in (("status", status), ("severity", severities), ("check_id", checks), ("dimension", dimensions), ("series_id", series), ("asset", assets)):
        if values is not None:
            findings = findings.where(F.col(column).isin(values))
    for column, start in (("series_id", series_prefix), ("asset", asset_prefix)):
        if start is not None:
            findings = findings.where(F.col(column).startswith(start))
    for column, value in (("group_id", group_id), ("partner", partner), ("last_run", run_id)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
    if check_like is not None:
        findings = findings.where(F.lower("check_id").contains(check_like.lower()))
    if since_ns is not None:
        findings = findings.where(F.col("end_ns") > since_ns)
    return findings if until_ns is None else findings.where(F.col("start_ns") < until_ns)


def select_series(series: DataFrame, text: str | None = None, units: list[str] | None = None, sources: list[str] | None = None, kinds: list[str] | None = None, asset_prefix: str | None = None, has_findings: DataFrame | None = None, max_score: float | None = None) -> DataFrame:
    """Series that meet all the conditions given. ``text`` is a part of the id or name in any case; units compare in any
    case; ``has_findings`` keeps those with an unresolved finding."""
    if text is not None:
        series = series.where(F.lower("series_id").contains(text.lower()) | F.lower(F.coalesce("name", F.lit(""))).contains(text.lower()))
    if units is not None:
        series = series.where(F.lower("unit").isin([u.lower() for u in units]))
    for column, values in (("source_id", sources), ("kind", kinds)):
        if values is not None:
            series = series.where(F.col(column).isin(values))
    if asset_prefix is not None:
        series = series.where(F.col("asset").startswith(asset_prefix))
    if max_score is not None:
        series = series.where(F.col("overall") <= max_score)
    if has_findings is not None:
        series = series.join(has_findings.where("status <> 'resolved'").select("series_id"), "series_id", "left_semi")
    return series


def bulk_change(findings: DataFrame, chosen: DataFrame, to: str, reason: str | None = None, now: int = 0, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(findings, outcome)`` after one change of all ``chosen (id)``; ``outcome (id, result)`` is ``changed``,
    ``not_allowed`` or ``not_found``. Muting needs a reason and ends within 366 days."""
    if to not in ALLOWED:
        raise ValueError(f"no such status: {to}")
    if to == "muted" and until is not None and not now < until <= now + 366 * DAY:
        raise ValueError("a mute must end within 366 days")
    changes = chosen.select("id").distinct().withColumn("to", F.lit(to)).withColumn("reason", F.lit(reason or ""))
    after = transition(findings, changes)
    if "muted_until" in findings.columns:
        after = after.withColumn("muted_until", F.when(F.col("changed"), F.lit(until if to == "muted" else None).cast("long")).otherwise(F.col("muted_until")))
    found = changes.select("id").join(after.select("id", "changed"), "id", "left")
    return after.drop("changed"), found.select("id", F.when(F.col("changed").isNull(), "not_found").when(F.col("changed"), "changed").otherwise("not_allowed").alias("result"))


def series_stats(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """``(series_id, overall, computed_at, runs, unresolved)``: the latest score, the runs scored and the findings open."""
    runs = scores.groupBy("series_id").agg(F.count_distinct("run_id").alias("runs"))
    left = findings.where("status <> 'resolved'").groupBy("series_id").agg(F.count("*").alias("unresolved"))
    return latest(scores).join(runs, "series_id").join(left, "series_id", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))


def merge_metadata(known: DataFrame, incoming: DataFrame, key: str = "series_id", overwrite: bool = False, limits: tuple[tuple[str, str], ...] = (("low", "high"),)) -> DataFrame:
    """``known`` with what ``incoming`` (one row a key) tells: it fills empty columns, and replaces others only with ``overwrite``; its empty cells
    leave what is known. New rows are added. Of each pair of ``limits`` neither is taken if the lower would not be below the
    upper. ``changed`` lists the columns that are other than before, in their order; other columns of ``incoming`` are ignored."""
    columns = [c for c in known.columns if c not in (key, "changed")]
    told = [c for c in columns if c in incoming.columns]
    both = known.select(key, *columns).join(incoming.select(key, *[F.col(c).alias(f"_{c}") for c in told]), key, "full")
    value = {c: (F.coalesce(f"_{c}", c) if overwrite else F.coalesce(c, f"_{c}")) if c in told else F.col(c) for c in columns}
    for low, high in limits:
        if low in columns and high in columns:
            clash = F.coalesce(value[low] >= value[high], F.lit(False))
            value |= {c: F.when(clash, F.col(c)).otherwise(value[c]) for c in (low, high)}
    changed = F.filter(F.array(*[F.when(~value[c].eqNullSafe(F.col(c)), c) for c in told]).cast("array<string>"), lambda c: c.isNotNull())
    return both.select(key, *[value[c].alias(c) for c in columns], changed.alias("changed"))


def due_series(watched: DataFrame, now: int, most: int, lease: int) -> DataFrame:
    """The ``most`` series that are due (``next_ns``) and that nobody holds (``leased_until``), the longest due first, with
    their new lease: what a worker claims."""
    free = watched.where((F.col("next_ns") <= now) & (F.col("leased_until").isNull() | (F.col("leased_until") <= now)))
    return free.orderBy("next_ns", "series_id").limit(most).withColumn("leased_until", F.lit(now + lease))


def without_critical(norm: DataFrame, findings: DataFrame, width: int = DAY) -> DataFrame:
    """Rows outside the windows of open critical findings. Windows are dealt to the days that they
    touch, so the range join is an equi-join."""
    bad = findings.where("severity = 'critical' and status = 'open'").select("series_id", "start_ns", "end_ns", F.explode(F.sequence(F.expr(f"start_ns div {width}"), F.expr(f"(end_ns - 1) div {width}"))).alias("day"))
    rows = norm.withColumn("day", F.expr(f"ts_ns div {width}"))
    hit = (rows["series_id"] == bad["series_id"]) & (rows["day"] == bad["day"]) & (rows["ts_ns"] >= bad["start_ns"]) & (rows["ts_ns"] < bad["end_ns"])
    return rows.join(bad, hit, "left_anti").drop("day")


def keep_versions(baselines: DataFrame, most: int = 30) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy(F.col("version").desc())
    return baselines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def export_rows(findings: DataFrame, columns: list[str], most: int = 50_000) -> DataFrame:
    """Text columns for CSV, newest first; texts that a spreadsheet would run get a quote before."""
    guard = lambda c: F.when(F.col(c).cast("string").rlike("^[=+@\\-\\t\\r]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c)
    return findings.orderBy(F.col("start_ns").desc(), "id").limit(most).select(*[guard(c) for c in columns])
