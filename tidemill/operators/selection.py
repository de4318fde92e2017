"""Distributed exact selection: order statistics per key from histograms refined until the ranks resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.sized import skew_join
from tidemill.session import cut

BINS = 4096


def _bin(v: Column, lo: Column, hi: Column, whole: bool, bins: int) -> Column:
    """The bin of ``v`` in [lo, hi], never falling as ``v`` grows; lo and hi fall into different bins."""
    width = hi.cast("double") - lo.cast("double")
    far = (v.cast("double") - lo.cast("double")) / width
    if whole:
        # where doubles can't tell the ends apart, differences of integers can
        near = F.when(width < F.lit(2.0**62), (v - lo).cast("double") / (hi - lo).cast("double"))
        far = F.when(width < F.lit(2.0**62), near).otherwise(far)
    return F.least(F.floor(far * F.lit(float(bins))).cast("int"), F.lit(bins - 1))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Column, bins: int = BINS) -> DataFrame:
    """The exact values at given ranks of every key: rows of (keys, n, rank, value, at_value).

    ``ranks`` is an array of bigint computed from ``n``, the key's number of non-null values (ranks count from 1,
    ties in any order; ranks outside 1..n are left out); ``at_value`` is how many of the key's values equal the one
    found. Rows with a null key or a null or NaN value are left out; an empty input gives no rows.

    Values stay where they are. Each round scans the input once, counts values in ``bins`` bins of every interval
    that is still open (combined before the shuffle, at most ``bins`` rows an interval and task), and keeps of
    every interval the bin with the rank, narrowed to the least and greatest value that occurred in it; an
    interval of one value is resolved. A hot key thus gives every task the same few counts to send as any
    other. The open intervals are broadcast if counted to be few, else joined with salts.
    """
    whole = dict(df.dtypes)[value] in ("bigint", "int", "smallint", "tinyint")
    rows = df.select(*keys, F.col(value).cast("bigint" if whole else "double").alias("_v"))
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, "_v"]))
    if not whole:
        rows = rows.where(~F.isnan("_v"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = ends.withColumn("rank", F.explode(F.array_distinct(ranks))).where("rank between 1 and n")
    # _left: rank within the interval; _at: rows in the interval, which is the count of the value once resolved
    state = cut(state.select(*keys, "n", "rank", "_lo", "_hi", F.col("rank").alias("_left"), F.col("n").alias("_at")))
    done = None
    while True:
        over = state.where("_lo = _hi")
        done = over if done is None else done.unionByName(over)
        state = state.where("_lo < _hi")
        if state.isEmpty():
            break
        spans = state.select(*keys, "_lo", "_hi").distinct()
        inside = skew_join(rows, spans, keys, salt_from=F.xxhash64("_v")).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        span = [*keys, "_lo", "_hi"]
        counts = (
            inside.withColumn("_bin", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), whole, bins))
            .groupBy(*span, "_bin")
            .agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        )
        upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*span).orderBy("_bin")))
        hit = state.join(upto, span).where((F.col("_left") <= F.col("_upto")) & (F.col("_left") > F.col("_upto") - F.col("_c")))
        state = cut(
            hit.select(
                *keys, "n", "rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"), F.col("_c").alias("_at")
            )
        )
    return done.select(*keys, "n", "rank", F.col("_lo").alias("value"), F.col("_at").alias("at_value"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """Exact quantiles per key, wide: (keys, n, q<percent>...); the value at rank ceil(share * n), at least 1."""
    rank = {s: F.greatest(F.ceil(F.lit(s) * F.col("n")), F.lit(1)).cast("bigint") for s in shares}
    found = order_statistics(df, keys, value, F.array(*rank.values()), bins)
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("rank") == rank[s], F.col("value"))).alias(f"q{s * 100:g}".replace(".", "_")) for s in shares])


def dominant(df: DataFrame, groups: list[str], key: str, least: Column) -> DataFrame:
    """Keys that hold at least ``least`` (a bigint column of ``n``) of their group's rows: (groups, key, n, rows).

    A key with L or more rows fills, in the order of hashes, a run of L ranks and so one of the ranks L, 2L, 3L
    and so on: exact selection at those ranks names every such key. The few keys found are then counted exactly.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*groups, key])).withColumn("_h", F.shiftright(F.xxhash64(key), 1))
    ranks = F.when(least <= F.col("n"), F.sequence(least, F.col("n"), least)).otherwise(F.array().cast("array<bigint>"))
    hits = order_statistics(rows, groups, "_h", ranks).where(F.col("at_value") >= least)
    named = skew_join(rows, cut(hits.select(*groups, "n", F.col("value").alias("_h")).distinct()), [*groups, "_h"])
    return named.groupBy(*groups, key, "n").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
