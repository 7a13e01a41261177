"""Joins of periods that overlap, without comparing all with all.

A period goes to a level by its length: at level k buckets are ``base * FACTOR^k`` wide, and the level is the first whose
buckets are at least as wide as the period, so a period lies in two buckets at most, however long it is. Two periods
that overlap share a bucket at the higher of their levels: a period stands in its own level's buckets and visits those
of those higher levels at which a period of the other side is at home, and one of the two that meet is always at home.
So rows grow with the levels in use (at most the logarithm of the longest over the shortest period), not with lengths,
and every pair is met once: in the later of the two first buckets. The sides are dealt out by key and bucket: their rows
are made here, so the size that Spark knows of a side is too small to tell whether it can be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = 8
#: Microseconds of the narrowest bucket: an hour. Shorter periods stand there too.
BASE = 3_600_000_000

#: Microseconds that the widest buckets may span: thousands of years on either side of 1970.
SPAN = 4 * 10**18


def levels_of(base: int) -> int:
    """How many levels of buckets there are: the widest hold all instants."""
    n = 1
    while base * FACTOR**n <= SPAN:
        n += 1
    return n


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], start: str = "since", end: str = "until", base: int = BASE) -> DataFrame:
    """(keys, a_<columns>, b_<columns>): pairs of rows with equal keys whose periods overlap: a.start < b.end and b.start < a.end.

    Periods are half-open timestamps. Defined cases: a null start or end is open, before or after all others; an empty
    period (start not before its end) overlaps as the two comparisons say; null keys meet nothing; repeated rows pair
    each; columns of the two sides keep their names behind the prefix, keys apart. Empty sides give an empty result.
    """
    levelled = [_levelled(df, side, keys, start, end, base) for df, side in ((a, "a"), (b, "b"))]
    homes = [df.select(F.bit_or(F.expr("shiftleft(1, _own)")).alias("_homes")).scalar() for df in levelled]
    sides = [_placed(df, side, keys, start, end, base, there) for df, side, there in ((a, "a", homes[1]), (b, "b", homes[0]))]
    met = sides[0].hint("merge").join(sides[1], [*keys, "_level", "_bucket"])
    once = (F.col("_home_a") | F.col("_home_b")) & (F.col("_bucket") == F.greatest("_first_a", "_first_b"))
    within = (F.col("_s_a") < F.col("_e_b")) & (F.col("_s_b") < F.col("_e_a"))
    shown = [f"{side}_{c}" for df, side in ((a, "a"), (b, "b")) for c in df.columns if c not in keys]
    return met.where(once & within).select(*keys, *shown)


def _levelled(df: DataFrame, side: str, keys: list[str], start: str, end: str, base: int) -> DataFrame:
    """The rows with their ends in microseconds (``_s``, ``_e``) and the level of their length (``_own``)."""
    levels = levels_of(base)
    most = base * FACTOR ** (levels - 1) // 2
    instant = lambda c, default: F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(default))))
    out = df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys), instant(start, -most).alias("_s"), instant(end, most).alias("_e"))
    length = F.greatest("_s", "_e") - F.least("_s", "_e")
    level = reduce(lambda rest, k: F.when(length <= base * FACTOR**k, F.lit(k)).otherwise(rest), reversed(range(levels - 1)), F.lit(levels - 1))
    return out.withColumn("_own", level)


def _placed(df: DataFrame, side: str, keys: list[str], start: str, end: str, base: int, homes: Column | None = None) -> DataFrame:
    """A row for each bucket that a period stands in, at its level and all higher ones, or those whose bits ``homes`` (of the other side) has."""
    out = _levelled(df, side, keys, start, end, base)
    low, high = F.least("_s", "_e"), F.greatest("_s", "_e")
    out = out.withColumn("_homes", F.lit(-1) if homes is None else F.coalesce(homes, F.lit(0)))

    def bucket(at: Column, k: int) -> Column:
        return F.floor(at / F.lit(base * FACTOR**k)).cast("long")

    def place(k: int) -> Column:
        used = (F.col("_own") == k) | ((F.col("_own") < k) & (F.col("_homes").bitwiseAND(1 << k) != 0))
        return F.when(used, F.struct(F.lit(k).alias("_level"), bucket(low, k).alias("_first"), bucket(high, k).alias("_last")))

    out = out.withColumn("_p", F.explode(F.array_compact(F.array(*map(place, range(levels_of(base)))))))
    out = out.select("*", "_p._level", F.col("_p._first").alias("_first"), F.explode(F.sequence("_p._first", "_p._last")).alias("_bucket"))
    return out.select(*keys, "_level", "_bucket", *(c for c in out.columns if c.startswith(f"{side}_")), F.col("_s").alias(f"_s_{side}"), F.col("_e").alias(f"_e_{side}"), F.col("_first").alias(f"_first_{side}"), (F.col("_level") == F.col("_own")).alias(f"_home_{side}"))
