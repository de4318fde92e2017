from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.text import clock_micros, tidy, tidy_upper
from tidemill.operators.late import combine, partials
from tidemill.streaming.jobs import compact_partials, message_stream, read_periods, run_available, run_flushed, store_partials
from tidemill.streaming.pings import MESSAGE, kept_by_watermark, stream_windows, window_speed


def event(i, driver, minute, second=0, sent=None, lat=10.0, seq=0):
    at = f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}"
    return (i, "o", driver, "EN_ROUTE", lat, 106.0, at, sent or at, seq, "c")


EVENTS = [event("a", "d1", 1, 0), event("b", "d1", 2, 0, lat=10.01), event("b", "d1", 2, 0, lat=10.01), event("c", "d1", 4, 0, lat=10.02), event("x", "d2", 1), event("x", "d2", 1), event("y", "d2", 61), event("z", "d2", 62, lat=10.5), event("n", None, 62)]


def shaped(df):
    return df.withColumns({"event_us": clock_micros("event_time"), "sent_us": clock_micros("sent_at"), "driver_id": tidy_upper("driver_id"), "event_id": tidy("event_id")})


def keyed(df):
    return sorted((r["window_end_us"], r["driver_id"], r["pings"], round(r["avg_speed_kmh"], 6)) for r in df.collect())


def test_stream_equals_batch_after_flush_and_dedup_changes_only_pings(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, MESSAGE)
    batch, once = window_speed(shaped(df)), window_speed(shaped(df.dropDuplicates(["event_id"])))
    assert len(keyed(batch)) == 3 and len(keyed(once)) == 2  # two copies of one ping are a window of speed 0, one is none
    speeds = {(r[0], r[1]): r[3] for r in keyed(batch)}
    assert all(speeds[r[0], r[1]] == r[3] for r in keyed(once))
    for name, dedup, want in (("plain", None, batch), ("within", "within_watermark", once), ("exact", "exact", once)):
        topic = str(tmp_path / name / "topic")
        df.coalesce(1).write.json(topic)
        got = run_flushed(spark, topic, lambda m, d=dedup: stream_windows(m, "5 minutes", d), str(tmp_path / name / "out"), str(tmp_path / name / "state"))
        assert keyed(got) == keyed(want), name


def test_stream_keeps_messages_without_identifier(spark, tmp_path):
    none = [event(i, "d1", m, lat=10.0 + m / 100) for m, i in enumerate((None, None, "", " "), 1)]
    first, later = [*none, event("a", "d1", 0), event(" A ", "d1", 0)], [event(None, "d1", 3, 30, lat=10.1), event("a", "d1", 0)]
    rows = spark.createDataFrame([*first, *later], MESSAGE)
    kept = shaped(rows)
    batch = window_speed(kept.where("event_id is null").unionByName(kept.where("event_id is not null").dropDuplicates(["event_id"])))
    assert [r[2] for r in keyed(batch)] == [6]
    for dedup in ("within_watermark", "exact"):
        topic, out, state = (str(tmp_path / dedup / n) for n in ("topic", "out", "state"))
        windows = lambda m, d=dedup: stream_windows(m, "5 minutes", d)
        spark.createDataFrame(first, MESSAGE).coalesce(1).write.json(topic)
        run_available(windows(message_stream(spark, topic)), out, state)
        spark.createDataFrame(later, MESSAGE).coalesce(1).write.mode("append").json(topic)
        assert keyed(run_flushed(spark, topic, windows, out, state)) == keyed(batch), dedup


def test_watermark_by_record(spark):
    # the second event moves the watermark past the end of the third's window
    rows = [("a", "D", 60_000_000, 1), ("b", "D", 301_000_000, 2), ("c", "D", 120_000_000, 3), ("d", "D", 302_000_000, 4)]
    df = spark.createDataFrame(rows, "event_id string, driver_id string, event_us long, arrived long")
    ids = lambda tolerance: sorted(r["event_id"] for r in kept_by_watermark(df, tolerance, ["arrived"]).collect())
    assert ids(0) == ["a", "b", "d"] and ids(1_000_000) == ["a", "b", "d"] and ids(1_000_001) == ["a", "b", "c", "d"]
    assert kept_by_watermark(df.limit(0), 0, ["arrived"]).collect() == []


def test_stored_partials_are_corrected_by_later_batches_and_compacted(spark, tmp_path):
    topic, store, state, merged = (str(tmp_path / n) for n in ("topic", "store", "state", "merged"))
    first = spark.createDataFrame([event("a", "d1", 1), event("b", "d1", 2, sent="2026-01-01T00:05:00")], MESSAGE)
    later = spark.createDataFrame([event("c", "d1", 3, sent="2026-01-01T00:34:59"), event("d", "d1", 4, sent="2026-01-01T00:35:00")], MESSAGE)
    first.coalesce(1).write.json(topic)
    store_partials(message_stream(spark, topic), store, state)
    shown = lambda df: {r["driver_id"]: tuple(r[c] for c in ("on_time", "late", "refused")) for r in df.collect()}
    assert shown(read_periods(spark, store)) == {"D1": (1, 1, 0)}
    later.coalesce(1).write.mode("append").json(topic)
    store_partials(message_stream(spark, topic), store, state)
    assert shown(read_periods(spark, store)) == {"D1": (1, 2, 1)}
    compact_partials(spark, store, merged, 0)
    assert shown(read_periods(spark, merged)) == {"D1": (1, 2, 1)}
    every = shaped(first.unionByName(later)).withColumn("batch", F.lit(0))
    assert shown(combine(partials(every, ["driver_id"], "batch"), ["driver_id"])) == {"D1": (1, 2, 1)}
