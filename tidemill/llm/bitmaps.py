"""Distinct counts over huge identifier sets: hashed bits in fixed bitmaps, merged by union (linear counting)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import parallelism

WORD = 64
#: Bits of the hash; a bitmap can't be larger.
HASH_BITS = 48


def standard_error(bits: float, n: float) -> float:
    """Relative standard error of linear counting n identifiers with a bitmap of ``bits``."""
    t = n / bits
    return math.sqrt(bits * (math.expm1(t) - t)) / n if t < 700 else math.inf


def bits_for(capacity: int, error: float) -> int:
    """The least power of two whose bitmap counts up to ``capacity`` identifiers with the relative standard error ``error``.

    It also leaves at least 25 bits empty on average at capacity (five standard deviations from none), so that
    a full bitmap, which has no estimate, isn't met.
    """
    bits = 1024
    n = max(1, capacity)
    # the error grows with n beyond its flat start at 1 / sqrt(2 * bits), so capacity is the worst case
    while bits < 1 << HASH_BITS and not (standard_error(bits, n) <= error and bits * math.exp(-n / bits) >= 25 and 1 / math.sqrt(2 * bits) <= error):
        bits *= 2
    return bits


def hashed(identifier: Column) -> Column:
    """48 bits of an identifier's MD5, so that bitmaps made by other engines merge with these; null stays null."""
    return F.conv(F.substring(F.md5(identifier.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bitmaps(df: DataFrame, keys: list[str], identifiers: dict[str, int], is_hashed: bool = False) -> DataFrame:
    """Partial results: (keys, identifier, bits, word, mask), a bitmap per key and identifier column as its non-zero words.

    ``identifiers`` maps each identifier column to the size of its bitmaps (a power of two); with ``is_hashed`` the
    columns hold what ``hashed`` gives. A row for ``keys`` may be one of several levels (see ``leveled``). Null
    identifiers set no bit. Sparse bitmaps take a word per identifier at most, full ones ``bits / 64``, however
    many rows there are; a large bitmap is spread over tasks by word. Bits are united before the shuffle.
    """
    return leveled(df, [(keys, identifiers)], is_hashed)


def leveled(df: DataFrame, levels: list[tuple[list[str], dict[str, int]]], is_hashed: bool = False) -> DataFrame:
    """Bitmaps of several groupings at once, each with sizes of its own: (keys of all levels, level, identifier, bits, word, mask).

    A level is (keys, sizes); keys of other levels are null in its rows. With one level the column ``level`` is left
    out. Groups that are united only among themselves need bits for their union alone, so many small groups take
    small bitmaps while few large ones take large bitmaps, all from one pass and one exchange.
    """
    if bad := [c for _, sizes in levels for c, bits in sizes.items() if bits < WORD or bits & (bits - 1)]:
        raise ValueError(f"bitmap sizes must be powers of two: {bad}")
    columns = [*dict.fromkeys(c for _, sizes in levels for c in sizes)]
    rows = df if is_hashed else df.withColumns({c: hashed(F.col(c)) for c in columns})
    kinds, every = dict(df.dtypes), [*dict.fromkeys(k for keys, _ in levels for k in keys)]
    each = [
        F.struct(*[(F.col(k) if k in keys else F.lit(None).cast(kinds[k])).alias(k) for k in every], F.lit(n).alias("level"), F.lit(c).alias("identifier"), F.lit(bits).cast("bigint").alias("bits"), F.col(c).bitwiseAND(F.lit(bits - 1)).alias("at"))
        for n, (keys, sizes) in enumerate(levels)
        for c, bits in sizes.items()
    ]
    long = rows.select(F.inline(F.array(*each))).where("at is not null")
    word, mask = F.shiftright("at", 6).cast("int"), F.expr("shiftleft(1L, cast(at & 63 as int))")
    own = [*every, "level"] if len(levels) > 1 else every
    return long.groupBy(*own, "identifier", "bits", word.alias("word")).agg(F.bit_or(mask).alias("mask"))


def fold(parts: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bring bitmaps of ``bits`` or more to that size, so that results of differently sized runs can be merged."""
    rows = parts.where(F.col("bits") >= bits).withColumn("word", F.pmod("word", F.lit(bits // WORD))).withColumn("bits", F.lit(bits).cast("bigint"))
    return rows.groupBy(*keys, "identifier", "bits", "word").agg(F.bit_or("mask").alias("mask"))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Unite bitmaps over all that ``keys`` doesn't name: partial results of coarser groups, or of more days."""
    return parts.groupBy(*keys, "identifier", "bits", "word").agg(F.bit_or("mask").alias("mask"))


def estimates(parts: DataFrame, keys: list[str], cube: list[str] | None = None, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys, identifier, bits, estimate, relative_error) per group; with ``cube`` also for every combination of those.

    The estimate is -bits * ln(share of empty bits); relative_error is its standard error at that load, and
    both are null for a bitmap without an empty bit. With ``cube``, ``combination`` is the number whose bits
    (the first column highest) are 1 for the columns left out; a null under a column that is not left out is a
    group of its own. The words are brought together by word once, for all combinations; ``named`` may add
    ``keys`` and ``cube`` to the rows after that, from short codes that travelled in their stead.
    """
    own = list(keys)
    if cube:
        # all groups of a word meet where the word is: the exchange by word serves every combination
        placed = parts.repartition(parallelism(parts.sparkSession), "identifier", "word")
        placed = named(placed) if named else placed
        kinds = dict(placed.dtypes)
        sets = [F.struct(*[(F.lit(None) if n >> (len(cube) - 1 - i) & 1 else F.col(c)).cast(kinds[c]).alias(c) for i, c in enumerate(cube)], F.lit(n).alias("combination")) for n in range(1 << len(cube))]
        merged = placed.select(*own, "identifier", "bits", "word", "mask", F.inline(F.array(*sets))).groupBy(*own, "identifier", "bits", "word", *cube, "combination").agg(F.bit_or("mask").alias("mask"))
        own += [*cube, "combination"]
    else:
        merged = merge(parts, own)
    full = merged.groupBy(*own, "identifier", "bits").agg(F.sum(F.bit_count("mask")).alias("set"))
    empty = (F.col("bits") - F.col("set")) / F.col("bits")
    load = F.when(empty > 0, -F.ln(empty))
    n = F.col("bits") * load
    error = F.sqrt(F.col("bits") * (F.exp(load) - load - 1)) / n
    return full.select(*own, "identifier", "bits", F.round(n).cast("bigint").alias("estimate"), F.round(error, 4).alias("relative_error"))
