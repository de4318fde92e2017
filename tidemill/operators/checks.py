"""Checks with severities, as frames: (table, check, passed, severity, value, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.frames import missing_columns
from tidemill.sources.specs import TableSpec

#: Extra rows over distinct keys, in percent, above which a warning is due.
DUPLICATE_PCT = 5.0


def _check(name: str, passed: Column, severity: Column | str, value: Column, detail: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(name).alias("check"), passed.alias("passed"), lit(severity).alias("severity"), value.cast("double").alias("value"), lit(detail).alias("detail"))


def check_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Four checks of a raw table: its columns, rows, nulls and duplicates.

    schema: a missing required column is critical. rows: none is critical, fewer than ``min_rows`` a warning. nulls:
    in the key critical, in another required column a warning. duplicates: over ``DUPLICATE_PCT`` a warning (exactly
    that passes); a missing key column critical. Counts are taken in one pass, plus one by key.
    """
    gone = missing_columns(df, [*spec.required])
    here = [c for c in spec.required if c not in gone]
    has_key = spec.key in df.columns
    others = [c for c in here if c != spec.key]
    null = lambda c: F.count_if(F.col(c).isNull())
    sums = df.agg(F.count("*").alias("rows"), (null(spec.key) if has_key else F.lit(None).cast("bigint")).alias("key_nulls"), *[null(c).alias(f"null_{c}") for c in others])
    if has_key:
        each = df.where(F.col(spec.key).isNotNull()).groupBy(spec.key).agg(F.count("*").alias("n"))
        counted = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keyed"), F.count("*").alias("keys"))
    else:
        counted = df.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("keyed"), F.lit(None).cast("bigint").alias("keys"))
    one = sums.withColumn("_one", F.lit(1)).join(F.broadcast(counted.withColumn("_one", F.lit(1))), "_one")
    null_sum = reduce(lambda a, b: a + b, [F.col(f"null_{c}") for c in others], F.lit(0).cast("bigint"))
    pct = F.when(F.col("keys") > 0, (F.col("keyed") - F.col("keys")) * 100.0 / F.col("keys")).otherwise(0.0)
    rows = [
        _check("schema", F.lit(not gone), "critical", F.lit(len(gone)), ",".join(gone)),
        _check("rows", F.col("rows") >= spec.min_rows, F.when(F.col("rows") == 0, "critical").otherwise("warning"), F.col("rows"), f"at least {spec.min_rows}"),
        _check("nulls", (F.coalesce("key_nulls", F.lit(0)) == 0) & (null_sum == 0), F.when(F.coalesce("key_nulls", F.lit(0)) > 0, "critical").otherwise("warning"), F.coalesce("key_nulls", F.lit(0)) + null_sum, spec.key),
        _check("duplicates", F.lit(has_key) & (pct <= DUPLICATE_PCT), "warning" if has_key else "critical", F.round(pct, 3), f"at most {DUPLICATE_PCT} %"),
    ]
    return one.select(F.lit(spec.name).alias("table"), F.inline(F.array(*rows)))


def null_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(table, column, rows, nulls) of each required column that the table has, in one pass."""
    here = [c for c in spec.required if c in df.columns]
    sums = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in here])
    return sums.select(F.lit(spec.name).alias("table"), "rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls")) for c in here]))).select("table", "column", "rows", "nulls")


def failed_critically(checks: DataFrame) -> DataFrame:
    """The checks that must stop a pipeline."""
    return checks.where("not passed and severity = 'critical'")


def require(checks: DataFrame) -> DataFrame:
    """``checks``, or an error that names the critical ones which failed (as many rows as checks, which are few)."""
    bad = [f"{r['table']}.{r['check']} ({r['detail']})" for r in failed_critically(checks).collect()]
    if bad:
        raise ValueError("critical checks failed: " + "; ".join(bad))
    return checks


def summarise(checks: DataFrame) -> DataFrame:
    """(tables, total_rows, passed, warnings, criticals) over all tables."""
    return checks.agg(
        F.count_distinct("table").alias("tables"),
        F.sum(F.when(F.col("check") == "rows", F.col("value"))).cast("bigint").alias("total_rows"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warnings"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("criticals"),
    )


def check_features(df: DataFrame, entity: str, name: str) -> DataFrame:
    """(name, rows, null_entities, has_times, passed): a feature table needs rows, entities and both time columns."""
    times = all(c in df.columns for c in ("event_timestamp", "created"))
    out = df.agg(F.count("*").alias("rows"), F.count_if(F.col(entity).isNull()).alias("null_entities"))
    return out.select(F.lit(name).alias("name"), "rows", "null_entities", F.lit(times).alias("has_times"), ((F.col("rows") > 0) & (F.col("null_entities") == 0) & F.lit(times)).alias("passed"))
