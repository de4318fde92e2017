"""Running streams over what there is: sources, the flush of last windows, and correction by late events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import clock_micros, tidy, tidy_upper
from tidemill.operators.late import CUTOFF_S, PERIOD_S, combine, merge_batches, partials
from tidemill.session import cut
from tidemill.streaming.pings import MESSAGE

#: Event time of the flush message: later than any real one, so that every window closes.
FLUSH_DRIVER, FLUSH_TIME = "__flush__", "2999-01-01 00:00:00"


def message_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages from files of JSON lines, decoded, with ``event_time`` a timestamp and the sending time kept."""
    reader = spark.readStream.schema(MESSAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return decoded(reader.json(folder))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a topic, from its earliest message on."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return decoded(raw.select(F.from_json(F.col("value").cast("string"), MESSAGE, {"mode": "FAILFAST"}).alias("_v")).select("_v.*"))


def decoded(messages: DataFrame) -> DataFrame:
    us = clock_micros("event_time")
    return messages.withColumns({"event_id": tidy("event_id"), "event_us": us, "sent_us": clock_micros("sent_at"), "event_time": F.timestamp_micros(us), "driver_id": F.when(F.col("driver_id") == FLUSH_DRIVER, F.col("driver_id")).otherwise(tidy_upper("driver_id"))})


def flush_message(spark: SparkSession, folder: str) -> None:
    """Add the message that closes all windows, as one more file."""
    row = spark.createDataFrame([(str(uuid.uuid4()), None, FLUSH_DRIVER, "FLUSH", None, None, FLUSH_TIME, FLUSH_TIME, 0, None)], MESSAGE)
    row.coalesce(1).write.mode("append").json(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what the source has, into parquet at ``out``, and stop; a later run goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_flushed(spark: SparkSession, folder: str, make, out: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream ``make(messages)`` over a folder, then once more after the flush message; the rows it gave.

    In append mode windows that the watermark hasn't passed stay in the state; the flush message passes them
    all. Its own window is left out.
    """
    run_available(make(message_stream(spark, folder, files_per_batch)), out, checkpoint)
    flush_message(spark, folder)
    run_available(make(message_stream(spark, folder, files_per_batch)), out, checkpoint)
    return spark.read.parquet(out).where(F.col("driver_id") != FLUSH_DRIVER)


def store_partials(stream: DataFrame, store: str, checkpoint: str, period_s: int = PERIOD_S, cutoff_s: int = CUTOFF_S, once: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append each micro-batch's partial aggregates per driver and period to ``store``, under the batch's number.

    The batch writes partitions of its own and replaces them if it is run again, so a restart counts nothing
    twice. Periods are corrected by later batches until the cut-off, beyond which events are counted as refused.
    With ``once``, which keeps one of the copies within a batch, repeated messages count once: the identifiers of
    each batch are stored beside it, in ``<store>-seen``, and later copies of these are left out. Messages without
    event_id are all counted.
    """
    seen = f"{store.rstrip('/')}-seen"

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_batch", F.lit(number).cast("bigint"))
        if once is not None:
            batch = cut(once(batch))
            known = batch.where("event_id is not null").select("event_id", F.col("_batch").alias("batch"))
            if number:
                before = batch.sparkSession.read.schema("event_id string, batch bigint").parquet(seen).where(F.col("batch") < number)
                batch = batch.where("event_id is null").unionByName(batch.where("event_id is not null").join(before.select("event_id"), "event_id", "left_anti").select(*batch.columns))
            known.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(seen)
        parts = partials(batch, ["driver_id"], "_batch", period_s=period_s, cutoff_s=cutoff_s)
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_periods(spark: SparkSession, store: str) -> DataFrame:
    """The periods as corrected so far: partials of all batches combined on read."""
    return combine(spark.read.parquet(store), ["driver_id"])


def compact_partials(spark: SparkSession, store: str, target: str, upto_batch: int) -> None:
    """Incremental merge: the partials of batches up to ``upto_batch`` as one, later ones as they are, in ``target``."""
    merge_batches(spark.read.parquet(store), upto_batch).write.mode("overwrite").partitionBy("batch").parquet(target)
