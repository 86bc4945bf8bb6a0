"""Keyed state over streams: findings that last over runs, and alert matches that are gathered into notices.

State lives in Spark's state store, one part for each key, with its own time to live; a query needs the RocksDB provider
(`with_state` sets it for the session's queries).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: items that a notice keeps; all are counted.
MOST_ITEMS = 50
#: A finding in state, its shape as JSON; the state's key has the series and the check.
_KEPT = "shape string, group_id string, partner string, start_ns long, end_ns long, status string, first_run string, last_run string, occurrences long"
_NAMES = [f.split()[0] for f in _KEPT.split(", ")]
FOUND = "series_id string, check_id string, id long, " + _KEPT
NOTICE = "rule_id string, due_ms long, n_matches long, items array<string>, first_ms long, last_ms long"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class FoldFindings(StatefulProcessor):
    """Known findings of one series and check, by id. An incoming one joins the open or acked finding of the same shape, group and
    partner, of another first run, that it overlaps most; else it is new. One that is known already, as of a batch
    that comes again, changes nothing. What no run touches for ``keep_ms`` is forgotten (0: never)."""

    def __init__(self, keep_ms: int = 0):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "id long", _KEPT, self.keep_ms or None)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802
        for row in initialState[["id", *_NAMES]].itertuples(index=False, name=None):
            self.known.updateValue((int(row[0]),), _clean(row[1:]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = {k[0]: dict(zip(_NAMES, v, strict=True)) for k, v in self.known.iterator()}
        changed: set[int] = set()
        incoming = [r for batch in rows for r in batch.to_dict("records")]
        for new in sorted(incoming, key=lambda r: (r["run_id"], r["start_ns"], r["end_ns"], r["id"])):
            own = {"shape": new["shape"], "group_id": _text(new["group_id"]), "partner": _text(new["partner"])}
            best = best_iou = None
            for i, old in state.items():
                inter = min(old["end_ns"], new["end_ns"]) - max(old["start_ns"], new["start_ns"])
                if inter <= 0 or old["status"] not in ("open", "acked") or old["first_run"] == new["run_id"] or any((old[c] or "") != (own[c] or "") for c in own):
                    continue
                iou = inter / (max(old["end_ns"], new["end_ns"]) - min(old["start_ns"], new["start_ns"]))
                if best is None or (iou, -old["start_ns"], -i) > (best_iou, -state[best]["start_ns"], -best):
                    best, best_iou = i, iou
            if best is None:
                if int(new["id"]) in state:
                    continue
                best = int(new["id"])
                state[best] = own | {"start_ns": int(new["start_ns"]), "end_ns": int(new["end_ns"]), "status": "open", "first_run": new["run_id"], "last_run": new["run_id"], "occurrences": 1}
            else:
                old = state[best]
                old["start_ns"], old["end_ns"] = min(old["start_ns"], int(new["start_ns"])), max(old["end_ns"], int(new["end_ns"]))
                old["occurrences"] += old["last_run"] < new["run_id"]
                old["last_run"] = max(old["last_run"], new["run_id"])
            changed.add(best)
        for i in changed:
            self.known.updateValue((i,), tuple(state[i][c] for c in _NAMES))
        out = [(*key, i, *[state[i][c] for c in _NAMES]) for i in sorted(changed)]
        yield pd.DataFrame(out, columns=["series_id", "check_id", "id", *_NAMES])

    def close(self) -> None:
        pass


def _text(x: Any) -> str | None:
    return None if x is None or pd.isna(x) else x


def _clean(row: tuple) -> tuple:
    return tuple(int(v) if c in ("start_ns", "end_ns", "occurrences") else _text(v) for c, v in zip(_NAMES, row, strict=True))


def _shaped(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("group_id", "partner") if c not in df.columns}
    return df.withColumns({**missing, "shape": F.to_json("shape")})


def fold_findings(incoming: DataFrame, path: str, checkpoint: str, keep_ms: int = 0) -> StreamingQuery:
    """Folds a stream of findings ``(id, series_id, check_id, shape, start_ns, end_ns, run_id)`` and, if they have them, ``group_id`` and
    ``partner`` into the ones known, one state for each series and check, and appends what each batch changed to the table at
    ``path`` (`known_findings` reads it). Run ids must rise in order of the runs.

    A batch that runs again overwrites its own rows. With a new checkpoint the state starts from the table, whose rows stay: each
    checkpoint writes under a number of its own."""
    spark = with_state(incoming.sparkSession)
    number = _generation(spark, path, checkpoint)
    before = known_findings(spark, path, number)
    own = _shaped(incoming).select("id", "series_id", "check_id", "shape", "group_id", "partner", "start_ns", "end_ns", "run_id")
    first = before.select("series_id", "check_id", "id", *_NAMES).groupBy("series_id", "check_id")
    changed = own.groupBy("series_id", "check_id").transformWithStateInPandas(FoldFindings(keep_ms), FOUND, "update", "processingTime" if keep_ms else "none", initialState=first)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/generation={number}/batch={n}")

    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generation(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number under which a checkpoint writes, kept beside it; a new one has one more than the table's last."""
    at = f"{checkpoint.rstrip('/')}/generation"
    try:
        kept = spark.read.text(at).head(1)
    except AnalysisException:
        kept = []
    if kept:
        return int(kept[0][0])
    last = _versions(spark, path).agg(F.max("generation")).first()[0]
    number = 0 if last is None else int(last) + 1
    spark.createDataFrame([(str(number),)], "value string").coalesce(1).write.mode("overwrite").text(at)
    return number


def _versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(FOUND + ", generation int, batch long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], FOUND + ", generation int, batch long")


def known_findings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest state of each finding (those written under numbers less than ``before``, if given)."""
    rows = _versions(spark, path)
    rows = rows if before is None else rows.where(F.col("generation") < before)
    newest = F.max_by(F.struct(*_NAMES), F.struct("generation", "batch"))
    return rows.groupBy("series_id", "check_id", "id").agg(newest.alias("x")).select("series_id", "check_id", "id", "x.*")


def compact_findings(spark: SparkSession, path: str, to: str) -> None:
    """Writes the newest states as the first version of the table ``to``, which a new checkpoint goes on from."""
    known_findings(spark, path).write.mode("overwrite").parquet(f"{to.rstrip('/')}/generation=0/batch=0")


class Gather(StatefulProcessor):
    """Matches of one rule into notices: the first is due at once, or ``quiet`` milliseconds after the one before; those that come
    until then join it. A timer sends what is due when the watermark passes."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due_ms long, n_matches long, items string, first_ms long, last_ms long")
        self.told = handle.getValueState("told", "due_ms long")

    def _send(self, key: Any, held: tuple) -> tuple:
        self.told.update((held[0],))
        return (key[0], held[0], held[1], json.loads(held[2]), held[3], held[4])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        out, held = [], tuple(self.held.get()) if self.held.exists() else None
        planned = held[0] if held else None
        matches = sorted((int(at), item) for batch in rows for at, item in batch[["at_ms", "item"]].itertuples(index=False, name=None))
        for at, item in matches:
            if held and at > held[0]:
                out.append(self._send(key, held))
                held = None
            if held is None:
                last = self.told.get()[0] if self.told.exists() else None
                held = (at if last is None else max(at, last + self.quiet), 0, "[]", at, at)
            items = json.loads(held[2])
            held = (held[0], held[1] + 1, json.dumps([*items, item][:MOST_ITEMS]), min(held[3], at), max(held[4], at))
        if held:
            self.held.update(held)
            if planned != held[0]:
                if planned is not None:
                    self.handle.deleteTimer(planned)
                self.handle.registerTimer(held[0])
        yield pd.DataFrame(out, columns=[f.split()[0] for f in NOTICE.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        if self.held.exists():
            held = tuple(self.held.get())
            if held[0] <= expiredTimerInfo.getExpiryTimeInMs():
                out.append(self._send(key, held))
                self.held.clear()
        yield pd.DataFrame(out, columns=[f.split()[0] for f in NOTICE.split(", ")])

    def close(self) -> None:
        pass


def gather(matches: DataFrame, quiet: int, late: str = "1 minute") -> DataFrame:
    """A stream of notices (as of ``NOTICE``) from one of matches ``(rule_id, at timestamp, item)``. A rule tells at most once in
    ``quiet`` milliseconds; of a notice's matches the first 50 are kept and all are counted. Matches later than ``late`` behind the
    newest are not counted."""
    with_state(matches.sparkSession)
    own = matches.withWatermark("at", late).select("rule_id", "at", F.unix_millis("at").alias("at_ms"), "item")
    return own.groupBy("rule_id").transformWithStateInPandas(Gather(quiet), NOTICE, "append", "eventTime")
