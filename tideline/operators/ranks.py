"""Order statistics: the value at rank round((n - 1) q), halves up, with no interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.tables import discard, written

#: Distinct values of one range that are sorted in a task; ranges of more are cut further.
SORTED = 50_000
#: Bits by which ranges are cut in each pass.
BITS = 16


def pick(values: Column, q: float) -> Column:
    """The nearest rank of an array, for groups of bounded size; null if it is empty."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) * q + 0.5).cast("int"))


def order_key(value: Column, kind: str) -> Column:
    """A whole number for each value, in the same order: of whole numbers themselves, of others the bits of a double (sign,
    exponent, fraction) as a number; a NaN comes last."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return value.cast("long")
    x = value.cast("double")
    size, least = F.abs(x), 2.0**-1022
    guess = F.floor(F.log2(size))
    scaled = size * F.pow(F.lit(2.0), -guess)  # a logarithm may be rounded over a power of two
    exponent = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    fraction = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled) - 1
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + (fraction * 2.0**52).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < least, (size * 2.0**537 * 2.0**537).cast("long")).otherwise(normal)
    return F.when(F.isnan(x), F.lit(2**63 - 1)).when(x < 0, -bits).otherwise(bits)


def counted(df: DataFrame, value: str = "value", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """``(*by, v, c)``: each value (not null) and how often it comes."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))


def rank_counted(counts: DataFrame, qs: Sequence[float], by: Sequence[str] = ("series_id",), half: float = 0.5) -> DataFrame:
    """``(*by, q, v)`` at rank floor((n - 1) q + ``half``) of ``counts (*by, v, c)``, exact for groups of any size.

    A pass counts values by the first bits of their order and keeps, for each rank, the range that holds it. While one of
    these has more than ``SORTED`` values, another pass cuts them by the next bits, four passes at most; a range of
    all bits is one value. Then each range is sorted, in a task of its own. What a pass keeps is one row for each
    group and rank. ``counts`` is read once a pass and once more, best from a table; a value may have several rows."""
    by = list(by)
    keyed = counts.select(*by, "v", "c", order_key(F.col("v"), counts.schema["v"].dataType.simpleString()).alias("_key"))
    asked = None
    for shift in range(64 - BITS, -1, -BITS):
        here = keyed.withColumn("_range", F.shiftright("_key", shift))
        if asked is not None:
            here = here.withColumn("_above", F.shiftright("_key", shift + BITS)).join(asked.select(*by, F.col("_range").alias("_above")).distinct(), [*by, "_above"], "left_semi")
        sizes = here.groupBy(*by, "_range").agg(F.sum("c").alias("_in"), F.count("*").alias("_rows"))
        above = [] if asked is None else [F.shiftright("_range", BITS).alias("_above")]
        group = [*by, *(["_above"] if above else [])]
        w = Window.partitionBy(*group).orderBy("_range")
        sizes = sizes.select("*", *above).withColumn("_to", F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if asked is None:
            spread = sizes.withColumn("_n", F.sum("_in").over(Window.partitionBy(*by))).select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
            spread = spread.withColumn("_k", F.floor((F.col("_n") - 1) * F.col("q") + half))
        else:
            spread = sizes.join(asked.select(*by, F.col("_range").alias("_above"), "q", "_k"), group)
        found = spread.where("_k >= _to - _in and _k < _to").select(*by, "_range", "_rows", "q", (F.col("_k") - F.col("_to") + F.col("_in")).alias("_k"))
        old, asked = asked, written(found, "ranges")
        discard(old)
        if not asked.where(F.col("_rows") > SORTED).head(1):
            break
    needed = keyed.withColumn("_range", F.shiftright("_key", shift)).join(asked.drop("_rows"), [*by, "_range"])
    upto = F.sum("c").over(Window.partitionBy(*by, "_range", "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return needed.withColumn("_upto", upto).where("_k < _upto and _k >= _upto - c").select(*by, "q", "v")


def nearest_rank(df: DataFrame, qs: Sequence[float], value: str = "value", by: Sequence[str] = ("series_id",), half: float = 0.5) -> DataFrame:
    """``(*by, q, v)`` at rank floor((n - 1) q + ``half``) of a column, exact for groups of any size."""
    return rank_counted(counted(df, value, by), qs, by, half)


def mad_counted(counts: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """``(*by, median, mad)`` of ``counts (*by, v, c)``, which is read four times: distances from the median are
    ranked with the counts of their values."""
    by = list(by)
    mid = rank_counted(counts, [0.5], by).select(*by, F.col("v").alias("median"))
    off = counts.join(mid, by).select(*by, F.abs(F.col("v") - F.col("median")).alias("v"), "c", "median")
    return mid.join(rank_counted(off, [0.5], by).select(*by, F.col("v").alias("mad")), by, "left")


def median_mad(df: DataFrame, value: str = "value", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """``(*by, median, mad)``: the nearest-rank median and that of the distances from it. Counts of values are
    written first, so that ``df`` is worked out once."""
    return mad_counted(written(counted(df, value, by), "counted"), by)


def within(df: DataFrame, by: Sequence[str], qs: Sequence[float], value: str = "value", half: float = 0.5) -> DataFrame:
    """Rows of ``df`` with ``_n``, the number of values (not null) of their group, and ``_ranked``, the values at ranks
    floor((n - 1) q + ``half``), for groups of which a task can sort each, such as a series' stretches. Groups are sorted
    by Spark, which spills; none is gathered in a row."""
    w = Window.partitionBy(*by)
    known = df.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(value)) - 1)
    at = [F.max(F.when(F.col("_at") == F.floor((F.col("_n") - 1) * q + half), F.col(value))).over(w) for q in qs]
    return known.withColumn("_ranked", F.array(*at)).drop("_at")


def group_medians(df: DataFrame, by: Sequence[str], *carry: Column, value: str = "value", deviation: bool = True) -> DataFrame:
    """``(*by, n, med, mad)`` and any aggregates of ``df``: nearest-rank medians of `within` groups and of the distances from
    them; one shuffle."""
    x = within(df, by, [0.5], value)
    if deviation:
        x = x.withColumn("_off", F.abs(F.col(value) - F.get("_ranked", F.lit(0)))).withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_off")) - 1)
        mads = [F.max(F.when(F.col("_at") == F.floor((F.col("_n") - 1) * 0.5 + 0.5), F.col("_off"))).alias("mad")]
    return x.groupBy(*by).agg(F.first("_n").alias("n"), F.first(F.get("_ranked", F.lit(0))).alias("med"), *(mads if deviation else []), *carry)
