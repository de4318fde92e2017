"""Shaping of whole frames: missing columns, fixed column lists, provenance."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns (name: type) that ``df`` lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def reindex(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns in this order: missing ones null, others dropped."""
    return add_missing(df, columns).select(*columns)


def drop_prefixed(df: DataFrame, prefix: str = "_") -> DataFrame:
    """Without the columns whose name starts with ``prefix``."""
    return df.select(*[c for c in df.columns if not c.startswith(prefix)])


def add_provenance(df: DataFrame, source: str, name: str, at: Column | None = None) -> DataFrame:
    """When (``at``, by default now), from where and into which table rows were ingested."""
    return df.withColumns({"_bronze_ingested_at": F.current_timestamp() if at is None else at, "_bronze_source": F.lit(source), "_bronze_table": F.lit(name)})


def union_by_name(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name, missing ones null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that ``df`` lacks."""
    return [c for c in required if c not in df.columns]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def nanos_to_timestamp(c: Column) -> Column:
    """A timestamp of nanoseconds since 1970 in a bigint, exact to the microsecond."""
    return F.timestamp_micros(F.floor(c / F.lit(1000).cast("decimal(5,0)")).cast("bigint"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` in an order drawn by hash of ``key`` and ``seed``: another seed is another order, the same one the same."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def preview(df: DataFrame, rows: int = 8) -> list[str]:
    """Print the first ``rows`` rows in full, and give them as JSON texts; no more are computed."""
    some = [r.asDict(True) for r in df.limit(rows).collect()]
    out = [json.dumps(r, default=str, ensure_ascii=False) for r in some]
    print("\n".join(out))
    return out
