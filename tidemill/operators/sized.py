"""Joins whose broadcast is taken only behind a check of the size, with hot keys salted beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut

#: A side is broadcast up to this many rows, and only if its rows are narrow (see ``row_bytes``).
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
#: Rows of one key that one task of a join is given, about.
TASK_ROWS = 1_000_000


def row_bytes(df: DataFrame) -> int:
    """A rough size of a row: 8 bytes a fixed-width field, 40 a text or nested one."""
    return sum(8 if t in ("bigint", "int", "double", "date", "timestamp", "timestamp_ntz", "boolean", "float", "smallint", "tinyint") else 40 for _, t in df.dtypes)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` holds at most ``rows`` rows and about ``size`` bytes; counts no further than that."""
    most = min(rows, size // max(1, row_bytes(df)))
    return df.limit(most + 1).count() <= most


def hot_keys(df: DataFrame, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """(on, _salts): keys of more than ``task_rows`` rows, and into how many parts of about that many they are to go.

    At most ``BROADCAST_ROWS`` keys, the hottest: a key beyond these has less than one in so many of all rows.
    """
    counts = df.where(_known(on)).groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > task_rows)
    top = counts.orderBy(F.desc("_rows"), *on).limit(BROADCAST_ROWS)
    return cut(top.select(*on, F.ceil(F.col("_rows") / task_rows).cast("int").alias("_salts")))


def _known(on: list[str]) -> str:
    return " and ".join(f"`{c}` is not null" for c in on)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salt_from: Column | None = None, rows: int = BROADCAST_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Join a large, skewed ``left`` with a smaller ``right`` (``inner``, ``left``, ``left_semi`` or ``left_anti``).

    ``right`` is broadcast if it is counted to be small. Otherwise the keys of ``left`` are counted: those of more
    than ``task_rows`` rows are spread over as many tasks as they need (salted from ``salt_from``, by default a hash of
    all columns), and only their rows of ``right`` are repeated for it. Null keys match nothing; their
    rows are spread by their salt. Columns that both sides have, apart from ``on``, are taken from ``left``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a join of this operator: {how}")
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in on])
    if fits_broadcast(right, rows):
        return left.join(F.broadcast(right), on, how)
    hot = hot_keys(left, on, task_rows)
    salt_from = F.xxhash64(*[F.col(c) for c in left.columns]) if salt_from is None else salt_from
    # at most BROADCAST_ROWS keys
    parts = F.when(F.expr(_known(on)), F.coalesce("_salts", F.lit(1))).otherwise(1 << 20)
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(salt_from, parts).cast("int")).drop("_salts")
    repeated = right.where(_known(on)).join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
