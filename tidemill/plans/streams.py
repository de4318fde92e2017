"""Windows of driver pings, as batch plans and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import clock_micros, tidy
from tidemill.operators.ordered import ranged
from tidemill.operators.quotient import quotient_dedup
from tidemill.plans.events import deduplicated
from tidemill.plans.registry import Registry
from tidemill.plans.reports import SQL_TIMED, timed_events
from tidemill.session import shared_folder
from tidemill.sources.scan import literal
from tidemill.sources.sinks import routed
from tidemill.sources.tables import table
from tidemill.streaming.jobs import FLUSH_DRIVER, message_stream, read_periods, run_flushed, store_partials
from tidemill.streaming.pings import MESSAGE, in_time, stream_windows, window_speed, with_top

REGISTRY = Registry()
MINUTE_US = 60_000_000
TOLERANCES = (0, 5, 30)


def sql_speed(source: str) -> str:
    h = "pow(sin((radians(lat) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lo)) / 2), 2)"
    return f"""with p as (select *, event_us - ((event_us % 300000000) + 300000000) % 300000000 w from ({source}) where driver_id is not null and event_us is not null),
l as (select *, lag(lat) over o la, lag(lon) over o lo from p window o as (partition by driver_id, w order by event_us, sequence_number nulls first, event_id nulls first, lat nulls first, lon nulls first)),
k as (select driver_id, w, count(*) pings, sum(coalesce(2 * 6371.0::double * asin(sqrt(case when {h} > 1 then 1.0 else {h} end)), 0)) km, max(event_us) - min(event_us) span from l group by 1, 2)
select w + 300000000 window_end_us, driver_id, pings, round(case when span > 0 then km / (span / 3600000000.0::double) else 0 end, 1) avg_speed_kmh from k where pings >= 2"""


def _shown(windows: DataFrame) -> DataFrame:
    return windows.select("window_end_us", "driver_id", "pings", F.round("avg_speed_kmh", 1).alias("avg_speed_kmh"))


@REGISTRY.add("window_speed", sql_speed(SQL_TIMED))
def all_window_speed(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(window_speed(timed_events(spark, folder)))


SQL_ONCE = f"select * from (select *, case when event_id is null then 1 else row_number() over (partition by event_id order by sent_us nulls last, _kafka_partition, _kafka_offset) end rn from ({SQL_TIMED})) where rn = 1"


@REGISTRY.add("window_speed_dedup", sql_speed(SQL_ONCE))
def window_speed_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_delivery_events")
    carry = ["event_id", "order_id", "driver_id", "event_type", "event_time", "sent_at", "sequence_number", "lat", "lon", "city", "_kafka_partition", "_kafka_offset"]
    kept = deduplicated(rows, carry).where("is_kept")
    pings = kept.select(tidy("event_id").alias("event_id"), tidy("driver_id").alias("driver_id"), "lat", "lon", "sequence_number", clock_micros("event_time").alias("event_us"))
    return _shown(window_speed(pings))


def sql_late(tolerance: int) -> str:
    kept = f"select * from (select *, max(event_us) over (order by sent_us nulls first, _kafka_partition, _kafka_offset rows unbounded preceding) top from ({SQL_TIMED}) where event_us is not null) where event_us - ((event_us % 300000000) + 300000000) % 300000000 + 300000000 > top - {tolerance * MINUTE_US}"
    return f"select {tolerance} tolerance_min, count(*) windows, coalesce(sum(pings), 0)::bigint pings from ({sql_speed(kept)})"


@REGISTRY.add("late_dropped_windows", " union all ".join(sql_late(t) for t in TOLERANCES))
def late_dropped_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows and pings left at several tolerances, with the watermark moved record by record in the order of sending."""
    pings = timed_events(spark, folder).where("event_us is not null")
    seen = with_top(pings, ["sent_us", "_kafka_partition", "_kafka_offset"])
    each = seen.withColumn("tolerance_min", F.explode(F.array(*[F.lit(t) for t in TOLERANCES]))).where(in_time(F.col("tolerance_min") * MINUTE_US))
    found = window_speed(each, ["tolerance_min"]).groupBy("tolerance_min").agg(F.count("*").alias("windows"), F.sum("pings").alias("pings"))
    return literal(spark, [(t,) for t in TOLERANCES], "tolerance_min int").join(found, "tolerance_min", "left").na.fill(0, ["windows", "pings"])


def staged_topic(spark: SparkSession, folder: str) -> str:
    """raw_delivery_events as JSON lines in the shared folder, for streams to read."""
    out = shared_folder(spark, "topic")
    table(spark, folder, "raw_delivery_events").select(*MESSAGE.fieldNames()).write.mode("append").json(out)
    return out


#: Micro-batches, about, that a topic in the order of sending is read in.
BATCHES = 4


def sent_topic(spark: SparkSession, folder: str) -> tuple[str, int]:
    """The topic in the order of sending, and how many of its files make a micro-batch, for streams of ``BATCHES``."""
    out = shared_folder(spark, "sent")
    us = clock_micros("sent_at")
    rows = table(spark, folder, "raw_delivery_events").withColumns({"_us": us, "_p": F.col("_kafka_partition"), "_o": F.col("_kafka_offset")})
    placed = ranged(rows, ["_us", "_p", "_o"], unique=True)
    ranges = (placed.agg(F.max("_range")).first()[0] or 0) + 1
    part = (F.col("_range") * BATCHES / F.lit(ranges)).cast("int")
    for k in range(BATCHES):
        # a stream takes files by their time of change: those of one part after those of the other; a range is a file
        placed.where(part == k).select(*MESSAGE.fieldNames()).write.mode("append").json(out)
    return out, -(-ranges // BATCHES)


@REGISTRY.add("stream_window_speed", sql_speed(SQL_TIMED))
def stream_window_speed(spark: SparkSession, folder: str) -> DataFrame:
    """The windows from a stream in append mode, flushed: with one micro-batch none is late, so they are the batch's."""
    topic = staged_topic(spark, folder)
    windows = run_flushed(spark, topic, lambda m: stream_windows(m, "5 minutes", None), shared_folder(spark, "windows"), shared_folder(spark, "state"))
    return _shown(windows.withColumn("driver_id", F.lower("driver_id")))


#: Events of a clock that can be right: a wrong one far ahead would close every window.
SQL_SANE = f"(select * from ({SQL_TIMED}) where event_us between epoch_us(timestamp '2026-01-01') and epoch_us(timestamp '2026-12-31'))"
SQL_SANE_ONCE = f"select * from (select *, case when event_id is null then 1 else row_number() over (partition by event_id order by sent_us nulls last, _kafka_partition, _kafka_offset) end rn from {SQL_SANE}) where rn = 1"


def sane(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("event_us").between(*[F.unix_micros(F.lit(t).cast("timestamp")) for t in ("2026-01-01 00:00:00Z", "2026-12-31 00:00:00Z")]) | (F.col("driver_id") == FLUSH_DRIVER))


@REGISTRY.add("stream_window_speed_dedup", sql_speed(SQL_SANE_ONCE))
def stream_window_speed_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of messages counted once, from a stream of several micro-batches that keeps every identifier it saw.

    The tolerance is longer than the latest message, so nothing is late and the windows are those of the batch.
    """
    topic, files = sent_topic(spark, folder)
    windows = run_flushed(spark, topic, lambda m: stream_windows(sane(m), "400 days", "exact"), shared_folder(spark, "windows"), shared_folder(spark, "state"), files)
    return _shown(windows.withColumn("driver_id", F.lower("driver_id")))


@REGISTRY.add("stream_late_dropped")
def stream_late_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """(tolerance_min, windows, pings) of streams of several micro-batches at tolerances of 0 and 5 minutes: what came too late is gone.

    The watermark moves between micro-batches only, so fewer messages are late than record by record
    (``late_dropped_windows``), and the more are kept the longer the tolerance.
    """
    (topic, files), out = sent_topic(spark, folder), None
    for tolerance in (0, 5):
        windows = run_flushed(spark, topic, lambda m, t=tolerance: stream_windows(sane(m), f"{t} minutes", None), shared_folder(spark, "windows"), shared_folder(spark, "state"), files)
        one = windows.agg(F.lit(tolerance).alias("tolerance_min"), F.count("*").alias("windows"), F.coalesce(F.sum("pings"), F.lit(0)).alias("pings"))
        out = one if out is None else out.unionByName(one)
    return out


def sql_late_periods(source: str) -> str:
    return f"""with e as (select upper(driver_id) driver_id, event_us - ((event_us % 300000000) + 300000000) % 300000000 w, sent_us, event_us from ({source}) where driver_id is not null and event_us is not null)
select driver_id, w window_us, count(*) filter (coalesce(sent_us - w - 300000000, -1) < 0) on_time, count(*) filter (sent_us - w - 300000000 >= 0 and sent_us - w - 300000000 < 1800000000) late,
  count(*) filter (sent_us - w - 300000000 >= 1800000000) refused from e group by 1, 2"""


@REGISTRY.add("stream_late_periods", sql_late_periods(SQL_TIMED))
def stream_late_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Partials of all messages, copies too, stored per micro-batch of a stream, combined on read."""
    store = shared_folder(spark, "partials")
    store_partials(message_stream(spark, staged_topic(spark, folder)), store, shared_folder(spark, "progress"))
    return read_periods(spark, store).select("driver_id", "window_us", "on_time", "late", "refused")


def earliest_sent(batch: DataFrame) -> DataFrame:
    """One of the copies of each message in a batch: the earliest sent."""
    return quotient_dedup(batch, "event_id", {"sent": F.col("sent_us")}, ["event_id", "driver_id", "event_us", "sent_us", "_batch"]).where("is_kept").drop("is_kept")


@REGISTRY.add("stream_late_periods_once", sql_late_periods(SQL_ONCE))
def stream_late_periods_once(spark: SparkSession, folder: str) -> DataFrame:
    """The same of messages counted once, over several micro-batches in the order of sending, so the copy kept is the earliest sent."""
    store = shared_folder(spark, "partials")
    store_partials(message_stream(spark, *sent_topic(spark, folder)), store, shared_folder(spark, "progress"), once=earliest_sent)
    return read_periods(spark, store).select("driver_id", "window_us", "on_time", "late", "refused")


SQL_PUBLIC = "order_id, driver_id, event_type, sequence_number"


@REGISTRY.add(
    "routed_messages",
    f"""with m as (select 'gps-topic' topic, * from raw_delivery_events union all select 'order-topic', * from raw_delivery_events where event_type in ('PICKED_UP', 'DELIVERED'))
select topic, order_id "key", event_id, {SQL_PUBLIC}, event_time, sent_at, round(lat, 6) lat, round(lon, 6) lon, city, 10::int - (event_id is null)::int - (order_id is null)::int - (driver_id is null)::int - (event_type is null)::int - (lat is null)::int
  - (lon is null)::int - (event_time is null)::int - (sent_at is null)::int - (sequence_number is null)::int - (city is null)::int fields from m""",
)
def routed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each message as its consumer reads it back from the JSON value, with the number of fields that the value has."""
    sent = routed(table(spark, folder, "raw_delivery_events"))
    read = sent.select("topic", "key", F.from_json("value", MESSAGE).alias("_v"), F.size(F.json_object_keys("value")).alias("fields"))
    return read.select("topic", "key", *[F.round(f"_v.{c}", 6).alias(c) if c in ("lat", "lon") else F.col(f"_v.{c}") for c in MESSAGE.fieldNames()], "fields")
