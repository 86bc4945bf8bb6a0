"""Findings and notices in keyed state: restarts, new checkpoints, repeated batches and plain folds."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.operators import lifecycle
from tideline.streaming import ingest, stateful

SCHEMA = "id long, series_id string, check_id string, shape array<string>, start_ns long, end_ns long, run_id string"
RUNS = [
    ("r1", [(1, "s", 0, 10), (2, "s", 50, 60), (9, "t", 0, 5)]),
    ("r2", [(3, "s", 8, 20), (4, "s", 200, 210)]),
    ("r3", [(5, "s", 15, 51), (6, "t", 4, 9), (7, "t", 4, 8)]),
]


def drop_run(spark, drop, run, rows):
    spark.createDataFrame([(i, s, "c", ["a"], a, b, run) for i, s, a, b in rows], SCHEMA).coalesce(1).write.mode("append").parquet(drop)


def fold(spark, drop, path, mark, **more):
    stateful.fold_findings(ingest.read_drop(spark, drop, SCHEMA, files_at_once=1), path, mark, **more).awaitTermination()


def state(spark, path):
    return {x.id: (x.series_id, x.start_ns, x.end_ns, x.status, x.first_run, x.last_run, x.occurrences) for x in stateful.known_findings(spark, path).collect()}


def plain(spark, runs):
    known = spark.createDataFrame([], lifecycle.STATE)
    for run, rows in runs:
        new = spark.createDataFrame([(i, s, "c", ["a"], a, b, run) for i, s, a, b in rows], SCHEMA)
        known = spark.createDataFrame(lifecycle.merge_run(known, new).collect(), lifecycle.STATE)
    return {x.id: (x.series_id, x.start_ns, x.end_ns, x.status, x.first_run, x.last_run, x.occurrences) for x in known.collect()}


def test_restart_new_checkpoint_and_repeated_batch(spark, tmp_path):
    """All give the state of a plain fold over the runs."""
    drop, path, mark, other = (str(tmp_path / x) for x in ("drop", "known", "mark", "other"))
    want = plain(spark, RUNS)
    assert want[1][1:3] == (0, 51) and want[1][6] == 3
    drop_run(spark, drop, *RUNS[0])
    fold(spark, drop, path, mark)
    drop_run(spark, drop, *RUNS[1])
    fold(spark, drop, path, mark)  # restart with the same checkpoint
    assert state(spark, path) == plain(spark, RUNS[:2])
    again = str(tmp_path / "again")
    drop_run(spark, again, *RUNS[1])
    drop_run(spark, again, *RUNS[2])
    fold(spark, again, path, other)  # a new checkpoint goes on from the table; the second run comes again
    assert state(spark, path) == want
    fold(spark, again, path, other)  # nothing new
    assert state(spark, path) == want
    drop_run(spark, again, *RUNS[2])
    fold(spark, again, path, other)  # the same batch again
    assert state(spark, path) == want
    to = str(tmp_path / "compact")
    stateful.compact_findings(spark, path, to)
    assert state(spark, to) == want


def test_resolved_findings_take_nothing(spark, tmp_path):
    drop, path, mark = (str(tmp_path / x) for x in ("drop", "known", "mark"))
    kept = ('["a"]', None, None, 0, 10)
    rows = [("s", "c", 1, *kept, "resolved", "r0", "r0", 1), ("s", "c", 2, *kept, "acked", "r0", "r0", 4), ("u", "c", 3, *kept, "muted", "r0", "r0", 1)]
    spark.createDataFrame(rows, stateful.FOUND).write.parquet(f"{path}/generation=0/batch=0")
    drop_run(spark, drop, "r1", [(10, "s", 5, 12), (11, "u", 5, 12)])
    fold(spark, drop, path, mark)
    got = state(spark, path)
    assert got[1][1:4] == (0, 10, "resolved") and got[2][1:] == (0, 12, "acked", "r0", "r1", 5) and got[11][3] == "open" and got[3][3] == "muted"


def plain_notices(matches, quiet):
    out, held, told = [], {}, {}
    for rule, at, item in sorted(matches, key=lambda m: (m[1], m[2])):
        if rule in held and at > held[rule][0]:
            out.append((rule, *held[rule]))
            told[rule] = held.pop(rule)[0]
        if rule not in held:
            held[rule] = [max(at, told[rule] + quiet) if rule in told else at, 0, [], at, at]
        h = held[rule]
        h[1] += 1
        h[2] = [*h[2], item][: stateful.MOST_ITEMS]
        h[4] = at
    return out, {(rule, *h) for rule, h in ((r, (x[0], x[1], tuple(x[2]), x[3], x[4])) for r, x in held.items())}


@pytest.mark.parametrize("batches", [1, 3])
def test_notices_by_a_plain_fold(spark, tmp_path, batches):
    r = random.Random(batches)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    zero = int(start.timestamp() * 1000)
    matches = [(r.choice(["a", "b"]), zero + 1000 * s, f"m{k:03d}") for k, s in enumerate(sorted(r.sample(range(3000), 300)))]
    drop = str(tmp_path / "drop")
    size = len(matches) // batches
    end = [("z", zero + 86_400_000, "end")]  # another rule's match moves the watermark over all that is due
    for k in range(batches):
        part = matches[k * size : (k + 1) * size] + (end if k == batches - 1 else [])
        rows = [(rule, start + timedelta(milliseconds=at - zero), item) for rule, at, item in part]
        spark.createDataFrame(rows, "rule_id string, at timestamp, item string").coalesce(1).write.mode("append").parquet(drop)
    stream = ingest.read_drop(spark, drop, "rule_id string, at timestamp, item string", files_at_once=1)
    out = str(tmp_path / "out")
    stateful.gather(stream, 200_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.rule_id, x.due_ms, x.n_matches, list(x.items), x.first_ms, x.last_ms) for x in spark.read.parquet(out).collect() if x.rule_id != "z")
    sent, held = plain_notices(matches, 200_000)
    want = sorted([*sent, *[(a, b, c, list(d), e, f) for a, b, c, d, e, f in held]])
    assert got == want and max(x[2] for x in got) > 8 and sum(x[2] for x in got) == 300


def test_items_are_bounded_and_all_counted(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", start, "first")] + [("a", start + timedelta(seconds=1 + k), f"m{k:03d}") for k in range(120)] + [("z", start + timedelta(days=1), "end")]
    drop, out = str(tmp_path / "drop"), str(tmp_path / "out")
    spark.createDataFrame(rows, "rule_id string, at timestamp, item string").coalesce(1).write.parquet(drop)
    stateful.gather(ingest.read_drop(spark, drop, "rule_id string, at timestamp, item string"), 600_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    first, second = sorted((x for x in spark.read.parquet(out).where(F.col("rule_id") == "a").collect()), key=lambda x: x.due_ms)
    assert first.n_matches == 1 and second.n_matches == 120 and len(second["items"]) == 50 and second["items"][0] == "m000" and second.due_ms - first.due_ms == 600_000
