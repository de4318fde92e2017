"""Joins under skew, in their plain and their salted form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join, by hint and not by settings of the session: the baseline of a comparison."""
    return left.join(right.hint("merge"), on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, salt_from: Column, how: str = "inner") -> DataFrame:
    """The same rows as ``merge_join``, with each key of ``left`` spread over ``salts`` tasks.

    The salt is a hash of ``salt_from``, so that a lost task comes out alike; ``right`` is repeated ``salts`` times.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def task_sizes(df: DataFrame) -> DataFrame:
    """(least, median, p95, most, ratio): rows per partition of ``df`` as it stands, and most over median."""
    each = df.groupBy(F.spark_partition_id().alias("_task")).agg(F.count("*").alias("n"))
    return each.agg(
        F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"), F.max("n").alias("most")
    ).withColumn("ratio", F.round(F.col("most") / F.col("median"), 2))
