"""Reports on raw tables: shares, cardinalities, nulls, defects, outliers, lateness, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import ranged, with_neighbour
from tidemill.operators.sized import fits_broadcast

#: Distinct values above which a column counts as high in cardinality.
HIGH = 1000


def _over(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def share_report(df: DataFrame, column: str, expected: DataFrame | None = None) -> DataFrame:
    """(value, rows, pct[, expected_pct, diff_pp]): how rows are spread over a column's values.

    ``expected`` has (value, weight); weights are normalised. Values are counted before their sum is taken.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*").alias("_total")).withColumn("_one", F.lit(1))
    out = counted.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("value", "rows", _over(F.col("rows"), F.col("_total")).alias("pct"))
    if expected is None:
        return out
    sums = expected.agg(F.sum("weight")).first()[0] or 1.0
    weights = expected.select("value", F.round(F.col("weight") * 100.0 / F.lit(sums), 2).alias("expected_pct"))
    joined = out.join(F.broadcast(weights) if fits_broadcast(weights) else weights, "value", "left")
    return joined.withColumn("diff_pp", F.round(F.col("pct") - F.col("expected_pct"), 2))


def cardinality_report(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(table, column, n_distinct, total, ratio, level): exact distinct counts of several columns, in one pass each."""
    longest = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    each = df.select(F.inline(longest)).groupBy("column", "value").agg(F.count("*").alias("n"))
    sums = each.groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("total"))
    return sums.select(F.lit(name).alias("table"), "column", "n_distinct", "total", F.round(F.col("n_distinct") / F.col("total"), 4).alias("ratio"), F.when(F.col("n_distinct") > HIGH, "HIGH").otherwise("LOW").alias("level"))


def approximate_report(df: DataFrame, columns: list[str], rsd: float = 0.05, lg_registers: int = 14) -> DataFrame:
    """(column, exact, approx, sketch, error_pct, use): approximate distinct counts beside the exact one.

    approx is the built-in estimate with relative deviation ``rsd``; sketch is a mergeable HyperLogLog sketch of
    2**lg_registers registers.
    """
    longest = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    each = df.select(F.inline(longest)).where("value is not null")
    near = each.groupBy("column").agg(F.approx_count_distinct("value", rsd).alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("value", lg_registers)).alias("sketch"))
    exact = each.distinct().groupBy("column").agg(F.count("*").alias("exact"))
    return exact.join(near, "column").select(
        "column", "exact", "approx", "sketch", F.round(F.abs(F.col("approx") - F.col("exact")) * 100.0 / F.col("exact"), 3).alias("error_pct"), F.when(F.col("exact") <= HIGH, "exact").otherwise("approximate").alias("use")
    )


def null_report(df: DataFrame, version: Column, columns: list[str]) -> DataFrame:
    """(version, column, rows, nulls, null_pct) by schema version."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("_null")) for c in columns])
    each = df.select(version.alias("version"), F.inline(parts))
    return each.groupBy("version", "column").agg(F.count("*").alias("rows"), F.count_if("_null").alias("nulls")).withColumn("null_pct", _over(F.col("nulls"), F.col("rows")))


def defect_report(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(check, violations, of_rows, pct): totals that don't equal the sum of their items, cancelled orders without reason.

    ``orders`` has one row a key. An order without items violates the first check, as a missing sum equals nothing.
    """
    sums = items.groupBy("order_id").agg(F.sum("subtotal").alias("_sum"))
    joined = orders.select("order_id", "status", "total_amount", "cancelled_reason_code").join(sums, "order_id", "left")
    wrong = F.col("total_amount").isNull() | F.col("_sum").isNull() | (F.col("total_amount") != F.col("_sum"))
    cancelled = F.col("status") == "cancelled"
    one = joined.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(cancelled).alias("cancelled"), F.count_if(cancelled & F.col("cancelled_reason_code").isNull()).alias("silent"))
    row = lambda check, bad, of: F.struct(F.lit(check).alias("check"), F.col(bad).alias("violations"), F.col(of).alias("of_rows"))
    return one.select(F.inline(F.array(row("total_amount is the sum of its items", "wrong", "n"), row("cancelled orders have a reason", "silent", "cancelled")))).withColumn("pct", _over(F.col("violations"), F.col("of_rows"), 3))


def review_report(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """(check, violations, of_rows, pct): reviews that name another restaurant than their order, among those whose order is there.

    ``orders`` has one row a key; a null restaurant on one side is another one.
    """
    told = reviews.select("order_id", F.col("restaurant_id").alias("_named")).join(orders.select("order_id", F.col("restaurant_id").alias("_expected")), "order_id")
    out = told.agg(F.lit("reviews name their order's restaurant").alias("check"), F.count_if(~F.col("_named").eqNullSafe(F.col("_expected"))).alias("violations"), F.count("*").alias("of_rows"))
    return out.withColumn("pct", _over(F.col("violations"), F.col("of_rows"), 3))


def outlier_report(items: DataFrame, orders: DataFrame, least: int = 13, hours: tuple[int, ...] = (11, 12, 13)) -> DataFrame:
    """(rows, bulk_rows, bulk_pct, lunch_pct, weekday_pct, max_quantity) of items with ``least`` or more pieces."""
    joined = items.select("order_id", "quantity").join(orders.select("order_id", "order_time"), "order_id", "left")
    bulk = F.col("quantity") >= least
    lunch, weekday = F.hour("order_time").isin(*hours), F.weekday("order_time") < 5
    out = joined.agg(
        F.count("*").alias("rows"), F.count_if(bulk).alias("bulk_rows"), F.count_if(bulk & lunch).alias("_lunch"), F.count_if(bulk & weekday).alias("_weekday"), F.max("quantity").alias("max_quantity")
    )
    return out.select(
        "rows", "bulk_rows", _over(F.col("bulk_rows"), F.col("rows"), 3).alias("bulk_pct"), _over(F.col("_lunch"), F.col("bulk_rows")).alias("lunch_pct"), _over(F.col("_weekday"), F.col("bulk_rows")).alias("weekday_pct"), "max_quantity"
    )


def hour_histogram(df: DataFrame, at: str, top: int | None = 10) -> DataFrame:
    """(hour, rows, pct), the busiest ``top`` hours; ties by hour."""
    out = share_report(df.select(F.hour(at).alias("hour")), "hour").withColumnRenamed("value", "hour")
    return out.orderBy(F.desc("rows"), "hour").limit(top) if top else out


def late_report(events: DataFrame, threshold_s: int = 5) -> DataFrame:
    """(events, late, late_pct, mean_delay_s, max_delay_s) by event_us and sent_us; late is over ``threshold_s``."""
    delay = F.col("sent_us") - F.col("event_us")
    late = delay > F.lit(threshold_s * 1_000_000)
    out = events.where("event_us is not null and sent_us is not null").agg(F.count("*").alias("events"), F.count_if(late).alias("late"), F.sum(F.when(late, delay)).alias("_sum"), F.max(F.when(late, delay)).alias("_max"))
    return out.select("events", "late", _over(F.col("late"), F.col("events")).alias("late_pct"), F.expr("_sum div late div 1000").alias("mean_delay_ms"), F.expr("_max div 1000").alias("max_delay_ms"))


def copies_report(events: DataFrame, key: str) -> DataFrame:
    """(messages, unique_keys, extra_copies, repeated_keys, dup_pct): pct of extra copies over distinct keys."""
    each = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("*").alias("unique_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return out.withColumn("dup_pct", _over(F.col("extra_copies"), F.col("unique_keys"), 3))


def burst_report(df: DataFrame, hour: Column, peaks: tuple[int, ...] = (11, 12, 13, 18, 19, 20)) -> DataFrame:
    """(hour, events, pct, is_peak)."""
    out = share_report(df.select(hour.alias("hour")).where("hour is not null"), "hour")
    return out.select(F.col("value").alias("hour"), F.col("rows").alias("events"), "pct", F.col("value").isin(*peaks).alias("is_peak"))


def burst_ratio(burst: DataFrame) -> DataFrame:
    """(peak_avg, normal_avg, ratio): events an hour in peak hours over those in others."""
    out = burst.agg(F.avg(F.when(F.col("is_peak"), F.col("events"))).alias("peak_avg"), F.avg(F.when(~F.col("is_peak"), F.col("events"))).alias("normal_avg"))
    return out.withColumn("ratio", F.round(F.col("peak_avg") / F.col("normal_avg"), 2))


def order_report(events: DataFrame, key: str, sequence: str, arrival: list[str]) -> DataFrame:
    """(keys, disordered, pct): keys of two or more messages whose sequence falls somewhere in arrival order.

    Messages are ranked over ranges, so a key with a third of all messages is spread over tasks.
    """
    rows = events.where(F.col(key).isNotNull()).select(key, sequence, *arrival)
    pairs = with_neighbour(ranged(rows, [key, *arrival]), [key], [sequence], "_before")
    each = pairs.groupBy(key).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col(f"_before.{sequence}") > F.col(sequence), F.lit(False))).alias("falls"))
    out = each.where("n >= 2").agg(F.count("*").alias("keys"), F.count_if("falls").alias("disordered"))
    return out.withColumn("pct", _over(F.col("disordered"), F.col("keys")))


def counts_by(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, rows) for each of several columns, in one pass."""
    parts = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])
    return df.select(F.inline(parts)).groupBy("dimension", "value").agg(F.count("*").alias("rows"))


def stream_statistics(events: DataFrame, threshold_s: int = 5) -> DataFrame:
    """One row on a stream: (messages, unique_keys, extra_copies, orders, drivers, timed, late, least_delay_ms, most_delay_ms).

    ``events`` has event_id, order_id, driver_id, event_us and sent_us. Delays are of messages with both times. Keys
    are counted per value first, so each shuffle moves distinct values only.
    """
    delay = F.col("sent_us") - F.col("event_us")
    sums = events.agg(
        F.count("*").alias("messages"), F.count(delay).alias("timed"), F.count_if(delay > F.lit(threshold_s * 1_000_000)).alias("late"),
        F.expr("min(sent_us - event_us) div 1000").alias("least_delay_ms"), F.expr("max(sent_us - event_us) div 1000").alias("most_delay_ms"),
    )
    each = events.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("event_id", "order_id", "driver_id")]))).where("v is not null").groupBy("what", "v").agg(F.count("*").alias("n"))
    of = lambda c, x: F.coalesce(F.sum(F.when(F.col("what") == c, x)), F.lit(0))
    keys = each.agg(of("event_id", F.lit(1)).alias("unique_keys"), of("event_id", F.col("n") - 1).alias("extra_copies"), of("order_id", F.lit(1)).alias("orders"), of("driver_id", F.lit(1)).alias("drivers"))
    one = sums.withColumn("_one", F.lit(1)).join(F.broadcast(keys.withColumn("_one", F.lit(1))), "_one")
    return one.select("messages", *[F.col(c).cast("bigint").alias(c) for c in ("unique_keys", "extra_copies", "orders", "drivers")], "timed", "late", "least_delay_ms", "most_delay_ms")
