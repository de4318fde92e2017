"""Per-period aggregates by event time, corrected as late records arrive, closed at a cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD_S = 300
CUTOFF_S = 1800


def partials(events: DataFrame, keys: list[str], batch: str, event_us: str = "event_us", sent_us: str = "sent_us", period_s: int = PERIOD_S, cutoff_s: int = CUTOFF_S, sums: dict[str, Column] | None = None) -> DataFrame:
    """Mergeable partial aggregates per ``keys``, period (``window_us``, its start) and arrival batch.

    Rows are (keys, window_us, batch, on_time, late, refused, first_us, last_us, and each of ``sums``). An event
    is late if sent at or after its period's end, refused if sent ``cutoff_s`` or more after it: the period was
    closed by then, so it is counted as refused and enters nothing else. Without a sending time an event counts
    as on time. Events without an event time or with a null key are left out. Counts, sums, minima and maxima
    are combined before the shuffle, so a key with a third of all rows is no burden.
    """
    period = period_s * 1_000_000
    start = F.col(event_us) - F.pmod(F.col(event_us), F.lit(period))
    lag = F.coalesce(F.col(sent_us) - (F.col("window_us") + F.lit(period)), F.lit(-1).cast("bigint"))
    taken = F.col("_lag") < F.lit(cutoff_s * 1_000_000)
    rows = events.where(" and ".join(f"`{c}` is not null" for c in [*keys, event_us])).withColumn("window_us", start).withColumn("_lag", lag)
    return rows.groupBy(*keys, "window_us", F.col(batch).alias("batch")).agg(
        F.count_if(F.col("_lag") < 0).alias("on_time"),
        F.count_if((F.col("_lag") >= 0) & taken).alias("late"),
        F.count_if(~taken).alias("refused"),
        F.min(F.when(taken, F.col(event_us))).alias("first_us"),
        F.max(F.when(taken, F.col(event_us))).alias("last_us"),
        *[F.sum(F.when(taken, c)).alias(name) for name, c in (sums or {}).items()],
    )


def combine(parts: DataFrame, keys: list[str], sums: list[str] | None = None, by_batch: bool = False) -> DataFrame:
    """Combine partials on read: one row per keys and period, however many batches hold a part of it.

    With ``by_batch`` the parts of one batch are combined only, which is the incremental merge of the same store.
    """
    more = ["batch"] if by_batch else []
    return parts.groupBy(*keys, "window_us", *more).agg(
        *[F.sum(c).alias(c) for c in ("on_time", "late", "refused")],
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        *[F.sum(c).alias(c) for c in sums or []],
        F.count("*").alias("parts"),
    )


def merge_batches(parts: DataFrame, upto_batch: int, keys: list[str] | None = None) -> DataFrame:
    """Incremental merge: partials of batches (numbered) up to ``upto_batch`` as one of that number, later ones as they are."""
    own = keys or ["driver_id"]
    sums = [c for c in parts.columns if c not in (*own, "window_us", "batch", "on_time", "late", "refused", "first_us", "last_us")]
    old = combine(parts.where(F.col("batch") <= upto_batch), own, sums).drop("parts").withColumn("batch", F.lit(upto_batch).cast("bigint"))
    return old.unionByName(parts.where(F.col("batch") > upto_batch).select(*old.columns))
