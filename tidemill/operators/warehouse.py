"""Dimensions with surrogate keys and validity, facts that refer to them, and declared constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.ordered import RANGE_ROWS, ranged, with_rank
from tidemill.operators.sized import skew_join
from tidemill.session import cut


def surrogate_keys(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Number the rows from 1 in ``order``, in which no two tie; ``df`` is read several times, so it should be kept.

    Rows are counted first: beyond ``RANGE_ROWS`` ranges are numbered at once, each from the count of those before
    it; up to that they are one range.
    """
    rows = df.count()
    if rows <= RANGE_ROWS:
        # one bounded range
        return df.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias(name), *df.columns)
    placed = with_rank(ranged(df, order, rows=rows, unique=True), [], "_rank")
    return placed.select((F.col("_rank") + 1).alias(name), *df.columns)


def initial_load(df: DataFrame, key: str, surrogate: str, as_of: Column) -> DataFrame:
    """A dimension's first load: one current version per row of ``df``, with open validity from ``as_of`` on."""
    numbered = surrogate_keys(cut(df), surrogate, [key])  # ranges look at their input several times
    return numbered.withColumns({"valid_from_ts": as_of, "valid_to_ts": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True)})


def merge_versions(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], as_of: Column) -> DataFrame:
    """A dimension after a snapshot: changed keys get their open version closed at ``as_of`` and a new one opened.

    Both have ``key`` and ``tracked``; ``current`` also valid_from_ts, valid_to_ts, is_current. Keys that the
    snapshot lacks stay open; equal ones stay as they are; nulls equal nulls. ``incoming`` has one row a key; rows
    with a null key are left out. One shuffle per side by key; the closed past is passed through.
    """
    past, open_ = current.where("not is_current"), current.where("is_current")
    new = incoming.where(F.col(key).isNotNull()).select(key, F.struct(*tracked).alias("_new"))
    both = open_.join(new, key, "full")
    differs = F.col("_new").isNotNull() & ~F.struct(*tracked).eqNullSafe(F.col("_new"))
    known = F.col("is_current").isNotNull()
    shape = lambda src, start, end, live: F.struct(*[(F.col(f"_new.{c}") if src == "new" else F.col(c)).alias(c) for c in tracked], start.alias("valid_from_ts"), end.alias("valid_to_ts"), live.alias("is_current"))
    none = F.lit(None).cast("timestamp_ntz")
    old = shape("old", F.col("valid_from_ts"), F.when(differs, as_of).otherwise(F.col("valid_to_ts")), ~differs)
    fresh = shape("new", as_of, none, F.lit(True))
    versions = F.array_compact(F.array(F.when(known, old), F.when(differs | ~known, fresh)))
    cols = [key, *tracked, "valid_from_ts", "valid_to_ts", "is_current"]
    return both.select(key, F.inline(versions)).select(*cols).unionByName(past.select(*cols))


def latest_snapshot(df: DataFrame, day: str = "ingested_date") -> DataFrame:
    """Rows of the latest snapshot day only; snapshots of earlier days would repeat every key.

    The day is looked up first (from the partition names, where ``day`` is a partition), then pruned to.
    """
    last = df.agg(F.max(day)).first()[0]
    return df.where(F.col(day) == F.lit(last)) if last is not None else df.limit(0)


def look_up(fact: DataFrame, dim: DataFrame, key: str, surrogate: str, unique: str) -> DataFrame:
    """``fact`` with the surrogate key of the dimension's current version, null if there is none."""
    return skew_join(fact, dim.where("is_current").select(key, surrogate), [key], "left", salt_from=F.xxhash64(unique))


def primary_key_violations(df: DataFrame, key: str, name: str) -> DataFrame:
    """(name, repeated_keys, null_keys): both 0 if the key holds."""
    each = df.groupBy(key).agg(F.count("*").alias("n"))
    return each.agg(
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys")
    ).select(F.lit(name).alias("name"), "repeated_keys", "null_keys")


def foreign_key_violations(fact: DataFrame, key: str, dim: DataFrame, to: str, name: str) -> DataFrame:
    """(name, orphan_keys, orphan_rows): keys of ``fact`` that ``dim`` lacks; null refers to nothing and is allowed."""
    used = fact.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(to)).agg(F.count("*").alias("n"))
    return used.join(dim.select(to).distinct(), to, "left_anti").agg(F.count("*").alias("orphan_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")).select(
        F.lit(name).alias("name"), "orphan_keys", "orphan_rows"
    )


def version_invariants(dim: DataFrame, key: str, surrogate: str, name: str) -> DataFrame:
    """(name, versions, surrogates, current_versions, keys_with_two_current): the first three are equal after a first load."""
    each = dim.groupBy(key, surrogate).agg(F.count("*").alias("n"), F.count_if(F.col("is_current")).alias("live"))
    keys = each.groupBy(key).agg(F.sum("n").alias("n"), F.sum("live").alias("live"), F.count(surrogate).alias("s"))
    # a surrogate belongs to one key, so those of each key add up
    return keys.agg(F.sum("n").alias("versions"), F.sum("s").alias("surrogates"), F.sum("live").alias("current_versions"), F.count_if(F.col("live") > 1).alias("keys_with_two_current")).select(
        F.lit(name).alias("name"), "versions", "surrogates", "current_versions", "keys_with_two_current"
    )
