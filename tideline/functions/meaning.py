"""Quality codes and what units imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD, UNCERTAIN, BAD, ESTIMATED = 0, 1, 2, 3
#: Texts of each quality.
QUALITY_TEXTS = {
    GOOD: ("good", "g", "a", "actual", "ok", "0", ""),
    UNCERTAIN: ("uncertain", "u", "questionable", "1"),
    BAD: ("bad", "b", "invalid", "2"),
    ESTIMATED: ("estimated", "e", "substituted", "s", "3"),
}
#: Limits that a unit implies, and units of quantities that cannot be negative.
UNIT_LIMITS = {
    ("%", "percent", "pct", "%rh", "rh"): (0.0, 100.0),
    ("k", "kelvin"): (0.0, None),
    ("ph",): (0.0, 14.0),
    ("w/m2", "w/m²", "wm-2"): (-4.0, 2000.0),
}
NON_NEGATIVE_UNITS = (
    "m3/h", "m³/h", "m3/s", "l/s", "l/min", "kg/h", "t/h", "kg/s", "nm3/h", "sm3/h", "ppm", "ppb", "mg/l", "g/l", "mol/l", "%rh", "rh",
    "k", "kelvin", "kwh", "mwh", "wh", "m", "mm", "cm", "bar", "bara", "kpa", "pa", "psia", "rpm", "hz", "lux",
)
#: Weights of severities, and the dimensions of a score.
SEVERITY = {"low": 0.1, "medium": 0.3, "high": 0.6, "critical": 1.0}
DIMENSIONS = ("completeness", "timeliness", "validity", "accuracy", "consistency", "plausibility", "integrity")


def usable(quality: Column) -> Column:
    return quality.isin(GOOD, ESTIMATED)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def quality_of_text(text: Column, unknown: int = BAD) -> Column:
    """Null is good; other texts are trimmed and lower-cased; unknown ones are ``unknown``."""
    low, out = F.lower(F.trim(text)), F.when(text.isNull(), GOOD)
    for code, texts in QUALITY_TEXTS.items():
        out = out.when(low.isin(*texts), code)
    return out.otherwise(unknown)


def quality_of_code(code: Column) -> Column:
    """Codes 0 to 3; null and all others are good."""
    return F.when(code.isin(1, 2, 3), code.cast("int")).otherwise(GOOD)


def quality_of_ua(status: Column) -> Column:
    """The top two bits of a 32-bit status: good, uncertain, else bad."""
    top = F.shiftrightunsigned(status.cast("long"), 30).bitwiseAND(F.lit(3))
    return F.when(top == 0, GOOD).when(top == 1, UNCERTAIN).otherwise(BAD)


def quality_of_da(code: Column) -> Column:
    """Bits 7 and 6: 11 is good, 01 uncertain, else bad."""
    top = F.shiftrightunsigned(code.cast("int"), 6).bitwiseAND(F.lit(3))
    return F.when(top == 3, GOOD).when(top == 1, UNCERTAIN).otherwise(BAD)


def physical_limits(unit: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Explicit limits; the unit's only if neither is given."""
    name, none = F.lower(F.trim(unit)), F.lit(None).cast("double")
    out = []
    for i, own in enumerate((low, high)):
        implied = F.when(F.lit(False), none)
        for units, limits in UNIT_LIMITS.items():
            implied = implied.when(name.isin(*units), F.lit(limits[i]).cast("double"))
        out.append(F.when(low.isNotNull() | high.isNotNull(), own).otherwise(implied))
    return out[0], out[1]


def non_negative(unit: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lower(F.trim(unit)).isin(*NON_NEGATIVE_UNITS), F.lit(False))


def weight(severity: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, w in SEVERITY.items():
        out = out.when(severity == name, F.lit(w))
    return out
