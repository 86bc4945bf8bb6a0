"""Scores of series from their findings."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.meaning import DIMENSIONS, weight
from tideline.functions.times import DAY, floor_div, plus, since

METHOD = "v2"


def _swept(key: list[str]):
    """Spans of one key and day in order of their start to the integral of the largest ``w`` that is open: one pass with a heap
    of the open spans, from which those that have ended go when they come to its top."""
    columns = [*key, "_day"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, total, heap = None, 0, 0.0, []

        def until(t: float) -> None:
            nonlocal now, total
            while heap and now < t:
                w, end = heap[0]
                if end <= now:
                    heapq.heappop(heap)
                    continue
                total += -w * (min(end, t) - now)
                now = min(end, t)

        for rows in batches:
            out = []
            for *own, s, e, w in rows[[*columns, "s", "e", "w"]].itertuples(index=False, name=None):
                if own != at:
                    until(math.inf)
                    if at is not None:
                        out.append((*at, total))
                    at, total, heap = own, 0.0, []
                until(s)
                now = s
                heapq.heappush(heap, (-w, e))
            yield pd.DataFrame(out, columns=[*columns, "part"])
        until(math.inf)
        if at is not None:
            yield pd.DataFrame([(*at, total)], columns=[*columns, "part"])

    return run


def merged_coverage(spans: DataFrame, key: list[str], width: int = DAY) -> DataFrame:
    """``(*key, integral)``: the integral over time of the largest ``w`` of the spans ``[s, e)`` that are open. Spans are cut
    at days and dealt to them; those of a day are swept in order of their start, in time that grows with their number
    and its logarithm."""
    own = spans.where("e > s").select(*key, "s", "e", (F.round(F.col("w") * 1e6) / 1e6).alias("w"))
    days = own.withColumn("_day", F.explode(F.sequence(floor_div(F.col("s"), width), floor_div(F.col("e") - 1, width))))
    cut = days.select(*key, "_day", F.greatest("s", F.try_multiply(F.col("_day"), F.lit(width))).alias("s"), F.least("e", F.try_multiply(F.col("_day") + 1, F.lit(width))).alias("e"), "w").groupBy(*key, "_day", "s", "e").agg(F.max("w").alias("w"))
    ordered = cut.repartition(*key, "_day").sortWithinPartitions(*key, "_day", "s")
    kinds = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in key)
    return ordered.mapInPandas(_swept(key), f"{kinds}, _day long, part double").groupBy(*key).agg(F.sum("part").alias("integral"))


def score(findings: DataFrame, window: DataFrame) -> DataFrame:
    """``(series_id, <each dimension>, overall)`` of ``findings (series_id, dimension, severity, start_ns,
    end_ns, affected)`` in ``window (series_id, w_start, w_end)``.

    A finding's impact is its severity's weight times the share affected. Spread over its own span it
    has a density; one denser than its weight is a point, and points of one span count once, by the
    largest, and add up. The others are merged by the largest density. Dimensions without findings have
    100; validity weighs 1.5 in the mean."""
    own = findings.join(window, "series_id").where("end_ns > w_start and start_ns < w_end")
    own = own.withColumn("weight", weight(F.col("severity"))).withColumn("impact", F.col("weight") * F.col("affected")).withColumn("span", F.greatest(F.lit(1), since(F.col("w_start"), F.col("w_end"))))
    own = own.withColumn("s", F.greatest("start_ns", "w_start")).withColumn("e", F.greatest(F.least("end_ns", "w_end"), plus(F.col("s"), 1))).withColumn("w", F.col("impact") * F.col("span") / F.greatest(F.lit(1), since(F.col("s"), F.col("e"))))
    key = ["series_id", "dimension"]
    points = own.where("w > weight").groupBy(*key, "s", "e").agg(F.max("impact").alias("impact")).groupBy(*key).agg(F.sum("impact").alias("points"))
    spans = merged_coverage(own.where("w <= weight and w > 0").select(*key, "s", "e", "w"), key)
    lost = own.groupBy(*key).agg(F.first("span").alias("span")).join(points, key, "left").join(spans, key, "left")
    impact = F.least(F.lit(1.0), F.coalesce("points", F.lit(0.0)) + F.least(F.lit(1.0), F.coalesce(F.col("integral") / F.col("span"), F.lit(0.0))))
    wide = lost.select(*key, F.round(100 * (1 - impact), 1).alias("v")).groupBy("series_id").pivot("dimension", list(DIMENSIONS)).agg(F.first("v"))
    out = window.select("series_id").join(wide, "series_id", "left").fillna(100.0, list(DIMENSIONS))
    total = sum((F.col(d) * (1.5 if d == "validity" else 1.0) for d in DIMENSIONS), F.lit(0.0))
    return out.withColumn("overall", F.round(total / (len(DIMENSIONS) + 0.5), 1))


def union_window(findings: DataFrame) -> DataFrame:
    """``(series_id, w_start, w_end)`` from the first start to the last end of each series' findings."""
    return findings.groupBy("series_id").agg(F.min("start_ns").alias("w_start"), F.max("end_ns").alias("w_end"))
