"""Durations, intervals and epoch units. All times are nanoseconds since 1970 in a ``bigint``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

US, MS, SEC = 1_000, 1_000_000, 1_000_000_000
MIN, HOUR, DAY = 60 * SEC, 3600 * SEC, 86400 * SEC
END_OF_TIME = 2**63 - 1

#: The intervals that a measured interval is rounded to.
NICE = (100 * MS, 500 * MS, 1 * SEC, 2 * SEC, 5 * SEC, 10 * SEC, 15 * SEC, 30 * SEC, 1 * MIN, 2 * MIN, 5 * MIN, 10 * MIN, 15 * MIN, 30 * MIN, 1 * HOUR, 2 * HOUR, 6 * HOUR, 12 * HOUR, 1 * DAY)
#: Names of units, and what one is in nanoseconds.
UNITS = {"ns": 1, "us": US, "µs": US, "ms": MS, "s": SEC, "sec": SEC, "m": MIN, "min": MIN, "h": HOUR, "d": DAY}
_DURATION = re.compile(r"\s*([0-9]*\.?[0-9]+)\s*([a-zµ]+)\s*", re.I)


def parse_duration(text: str) -> int:
    """``250ms``, ``90s``, ``5m``, ``1.5h``, ``2d`` to nanoseconds."""
    m = _DURATION.fullmatch(text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return round(float(m[1]) * UNITS[m[2].lower()])


def format_duration(ns: int) -> str:
    """The two largest whole units that a duration has, such as ``1d 2h``."""
    out, left = [], abs(ns)
    for name in ("d", "h", "m", "s", "ms", "us", "ns"):
        n, left = divmod(left, UNITS[name])
        if n:
            out.append(f"{n}{name}")
        if len(out) == 2:
            break
    return ("-" if ns < 0 else "") + (" ".join(out) or "0s")


def floor_div(x: Column, by: Column | int) -> Column:
    """Whole quotient rounded down, also below zero and at the ends of a bigint."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("div", x, by) - F.when((x < 0) & (F.pmod(x, by) != 0), 1).otherwise(0)


def plus(ts_ns: Column, by: Column | int) -> Column:
    """A time some nanoseconds later, at most the end of time."""
    return F.when(ts_ns.isNotNull(), F.coalesce(F.try_add(ts_ns, F.lit(by) if isinstance(by, int) else by), F.lit(END_OF_TIME)))


def since(start: Column, end: Column) -> Column:
    """Nanoseconds from ``start`` to a later ``end``, at most what a bigint holds."""
    return F.when(start.isNotNull() & end.isNotNull(), F.coalesce(F.try_subtract(end, start), F.lit(END_OF_TIME)))


def snap_to_nice(interval: Column) -> Column:
    """The nearest nice interval (the smaller on a tie) if it is within 5 % of ``interval``, else that."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(n) - interval).alias("off"), F.lit(n).alias("nice")) for n in NICE]))
    return F.when((interval > 0) & (near["off"] <= interval * 0.05), near["nice"]).otherwise(interval)


def epoch_unit(median_abs: Column) -> Column:
    """Nanoseconds in one step of a column of epoch integers, from their median magnitude."""
    return F.when(median_abs < 1e11, SEC).when(median_abs < 1e14, MS).when(median_abs < 1e17, US).otherwise(1).cast("long")


def months_start(ts_ns: Column) -> Column:
    """Year and month (UTC) as ``yyyymm``."""
    t = F.timestamp_micros(floor_div(ts_ns, US))
    return F.year(t) * 100 + F.month(t)


def before_end(ts_ns: Column, end_ns: Column | int) -> Column:
    """Whether a time is before the end of a window; the end of time is part of its window."""
    end = F.lit(end_ns) if isinstance(end_ns, int) else end_ns
    return (ts_ns < end) | (end == END_OF_TIME)


def resolve_window(now: int, last: str | None = None, start: int | None = None, end: int | None = None) -> tuple[int, int]:
    """``[start, end)`` of a window given as ``last`` (such as ``7d``, one hour to 400 days) or by its bounds."""
    if last is None:
        if start is None or end is None or start >= end:
            raise ValueError("a window needs a start before its end")
        return start, end
    width = parse_duration(last)
    if not HOUR <= width <= 400 * DAY:
        raise ValueError(f"a window is from an hour to 400 days long, not {last}")
    return now - width, now
