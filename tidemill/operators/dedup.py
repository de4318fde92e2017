"""One row per key, and how many there were too many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import tidy


def keep_best(df: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """The row of each key with the greatest ``best`` (nulls lowest), ties by the greatest other columns.

    An aggregate, not a window: rows of a key are reduced before the shuffle, so a hot key costs a row a task.
    A null key is a key like any other.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*best, *rest)).alias("_best"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the least ``order`` (nulls lowest), ties by the least other columns."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("_best"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def keep_first_keyed(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``keep_first`` of the rows with a key, beside all rows whose key is null or blank: these are nobody's copies."""
    keyed = tidy(key).isNotNull()
    return keep_first(df.where(keyed), [key], order).unionByName(df.where(~keyed))


def duplicate_rate(df: DataFrame, key: str) -> DataFrame:
    """(total, unique_keys, duplicates, duplicate_pct): pct of extra rows over distinct keys, nulls left out.

    Counted per key first, so that keys are combined before the shuffle; an empty input has 0 and a null pct.
    """
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_keys"))
    extra = F.col("total") - F.col("unique_keys")
    return total.select("total", "unique_keys", extra.alias("duplicates"), F.round(F.when(F.col("unique_keys") > 0, extra * 100.0 / F.col("unique_keys")), 3).alias("duplicate_pct"))


def copies_per_batch(df: DataFrame, key: str, batch: str) -> DataFrame:
    """(batch, extra_copies): rows of a batch beyond the first of each key in it."""
    each = df.where(F.col(key).isNotNull()).groupBy(batch, key).agg(F.count("*").alias("n"))
    return each.groupBy(batch).agg(F.sum(F.col("n") - 1).alias("extra_copies"))
