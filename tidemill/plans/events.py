"""Problems 3 and 5: messages delivered more than once, late and out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import clock_micros, micros_to_ntz, second_text, tidy_upper
from tidemill.operators.late import combine, merge_batches, partials
from tidemill.operators.quotient import quotient_dedup
from tidemill.plans.registry import Registry
from tidemill.session import shared_folder
from tidemill.sources.tables import spread, table

REGISTRY = Registry()

BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_tidy(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANKS})), '')"


def sql_clock(c: str) -> str:
    t = f"trim({c}, {BLANKS})"
    iso = r"'\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?[Zz]?'"
    return rf"(case when regexp_full_match({t}, '\d{{1,15}}') then 1000 * try_cast({t} as bigint) when regexp_full_match({t}, {iso}) then epoch_us(try_cast(regexp_replace({t}, '[Zz]$', '') as timestamp)) end)"


SQL_RANKED = f"""
with r as (
  select *, {sql_tidy("event_id")} id, {sql_clock("event_time")} event_us, {sql_clock("sent_at")} sent_us from raw_delivery_events
), k as (
  select *, case when id is null then 1 else row_number() over (
    partition by id order by sent_us nulls last, _kafka_partition nulls last, _kafka_offset nulls last) end rn from r
)"""


def deduplicated(events: DataFrame, carry: list[str]) -> DataFrame:
    """Every message with ``is_kept``: of the copies the earliest sent, then the lowest partition, then offset."""
    order = {"sent": clock_micros("sent_at"), "part": F.col("_kafka_partition"), "offset": F.col("_kafka_offset")}
    return quotient_dedup(events, "event_id", order, carry)


@REGISTRY.add("p3_found", SQL_RANKED + " select _kafka_partition, _kafka_offset from k where rn > 1")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    events = spread(table(spark, folder, "raw_delivery_events").select("event_id", "sent_at", "_kafka_partition", "_kafka_offset"))
    return deduplicated(events, ["_kafka_partition", "_kafka_offset"]).where("not is_kept").drop("is_kept")


KEPT = ["event_id", "order_id", "driver_id", "event_type", "event_time", "sent_at", "sequence_number", "city", "_kafka_partition", "_kafka_offset"]


@REGISTRY.add("p3_kept_messages", SQL_RANKED + f" select {', '.join(KEPT)} from k where rn = 1")
def p3_kept_messages(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated(spread(table(spark, folder, "raw_delivery_events").select(*KEPT)), KEPT).where("is_kept").drop("is_kept")


def period_partials(spark: SparkSession, folder: str) -> DataFrame:
    """The store of partials: figures per driver, five-minute period and hourly arrival batch, of messages kept once."""
    events = table(spark, folder, "raw_delivery_events").select("event_id", "sent_at", "_kafka_partition", "_kafka_offset", "driver_id", "event_time", "_bronze_ingested_at", "lat", "lon")
    shaped = spread(events).select(
        "event_id",
        "sent_at",
        "_kafka_partition",
        "_kafka_offset",
        tidy_upper("driver_id").alias("driver_id"),
        clock_micros("event_time").alias("event_us"),
        clock_micros("sent_at").alias("sent_us"),
        F.col("_bronze_ingested_at").alias("arrived"),
        F.round(F.col("lat") * 1_000_000).cast("bigint").alias("lat_e6"),
        F.round(F.col("lon") * 1_000_000).cast("bigint").alias("lon_e6"),
    )
    kept = deduplicated(shaped, ["driver_id", "event_us", "sent_us", "arrived", "lat_e6", "lon_e6", "_kafka_partition", "_kafka_offset"]).where("is_kept")
    return partials(kept, ["driver_id"], "arrived", sums={"lat_e6": F.col("lat_e6"), "lon_e6": F.col("lon_e6")})


SQL_PERIODS = (
    SQL_RANKED
    + f""", e as (
  select upper({sql_tidy("driver_id")}) driver_id, event_us, event_us - ((event_us % 300000000) + 300000000) % 300000000 w,
    coalesce(sent_us - (event_us - ((event_us % 300000000) + 300000000) % 300000000 + 300000000), -1) lag_us, lat, lon
  from k where rn = 1 and event_us is not null and {sql_tidy("driver_id")} is not null
)"""
)


@REGISTRY.add(
    "p5_found",
    SQL_PERIODS
    + """ select driver_id, strftime(make_timestamp(w), '%Y-%m-%d %H:%M:%S') window_start, outcome
  from (select distinct driver_id, w, case when lag_us >= 1800000000 then 'lossy' else 'corrected' end outcome from e where lag_us >= 0)""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    periods = combine(period_partials(spark, folder), ["driver_id"])
    outcomes = F.array_compact(F.array(F.when(F.col("late") > 0, "corrected"), F.when(F.col("refused") > 0, "lossy")))
    return periods.where("late > 0 or refused > 0").select(
        "driver_id", second_text(micros_to_ntz(F.col("window_us"))).alias("window_start"), F.explode(outcomes).alias("outcome")
    )


SQL_DRIVER_PERIODS = (
    SQL_PERIODS
    + """ select driver_id, strftime(make_timestamp(w), '%Y-%m-%d %H:%M:%S') window_start,
    count(*) filter (lag_us < 0) on_time, count(*) filter (lag_us >= 0 and lag_us < 1800000000) late, count(*) filter (lag_us >= 1800000000) refused,
    count(*) filter (lag_us < 1800000000) events,
    coalesce((max(event_us) filter (lag_us < 1800000000) - min(event_us) filter (lag_us < 1800000000)) // 1000, 0) span_ms
  from e group by driver_id, w"""
)


def shown_periods(periods: DataFrame) -> DataFrame:
    return periods.select(
        "driver_id",
        second_text(micros_to_ntz(F.col("window_us"))).alias("window_start"),
        "on_time",
        "late",
        "refused",
        (F.col("on_time") + F.col("late")).alias("events"),
        F.coalesce(F.expr("(last_us - first_us) div 1000"), F.lit(0).cast("bigint")).alias("span_ms"),
    )


@REGISTRY.add("p5_driver_periods", SQL_DRIVER_PERIODS)
def p5_driver_periods(spark: SparkSession, folder: str) -> DataFrame:
    return shown_periods(combine(period_partials(spark, folder), ["driver_id"]))


@REGISTRY.add("p5_merged_periods", SQL_DRIVER_PERIODS)
def p5_merged_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a store of partials by week of arrival, whose first half of weeks is merged into one batch before it is read."""
    week = F.coalesce(F.floor(F.unix_micros(F.col("batch").cast("timestamp")) / (7 * 86_400 * 1_000_000)).cast("bigint"), F.lit(-1).cast("bigint"))
    store, merged = shared_folder(spark, "periods"), shared_folder(spark, "merged")
    rows = period_partials(spark, folder).withColumn("batch", week)
    rows.hint("rebalance", "batch").write.mode("append").partitionBy("batch").parquet(store)
    parts = spark.read.schema(rows.schema).parquet(store)
    first, last = parts.agg(F.min("batch"), F.max("batch")).first()
    merge_batches(parts, (first + last) // 2 if last is not None else -1).write.mode("append").partitionBy("batch").parquet(merged)
    return shown_periods(combine(spark.read.schema(rows.schema).parquet(merged), ["driver_id"]))
