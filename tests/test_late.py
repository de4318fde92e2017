from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.text import clock_micros, micros_to_ntz, second_text
from tidemill.operators.late import combine, partials

MIN = 60_000_000


def test_clock_readings(spark):
    rows = [("2026-01-02T03:04:05",), ("2026-01-02 03:04:05.123456Z",), ("1767323045000",), ("0",), ("n/a",), (None,), ("",), ("2026-13-02T03:04:05",), ("2026-01-02",), (" 2026-01-02T03:04:05.5z ",), ("9" * 40,)]
    df = spark.createDataFrame(rows, "t string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = [r[0] for r in df.select(clock_micros("t")).collect()]
        shown = [r[0] for r in df.select(second_text(micros_to_ntz(clock_micros("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = 1767323045 * 1_000_000
    assert got == [base, base + 123456, base, 0, None, None, None, None, None, base + 500000, None]
    assert shown[0] == "2026-01-02 03:04:05" and shown[3] == "1970-01-01 00:00:00"


def test_partials_boundaries_and_merging(spark):
    rows = [
        ("d", 0, 5 * MIN - 1, 1),  # on time
        ("d", 1 * MIN, 5 * MIN, 1),  # late at the very end of the period
        ("d", 2 * MIN, 35 * MIN - 1, 2),  # the last moment before the cut-off
        ("d", 3 * MIN, 35 * MIN, 2),  # refused
        ("d", 5 * MIN, 5 * MIN, 2),  # the next period
        ("d", -1, -1, 2),  # the period before 1970
        ("d", 4 * MIN, None, 3),
        (None, 0, 0, 1),
        ("d", None, 0, 1),
    ]
    df = spark.createDataFrame(rows, "k string, event_us long, sent_us long, b int").withColumn("batch2", F.lit(1))
    parts = partials(df, ["k"], "b", sums={"n": F.lit(1)})
    once = {r["window_us"]: tuple(r[c] for c in ("on_time", "late", "refused", "n")) for r in combine(parts, ["k"], ["n"]).collect()}
    assert once == {0: (2, 2, 1, 4), 5 * MIN: (1, 0, 0, 1), -5 * MIN: (1, 0, 0, 1)}
    merged = combine(combine(parts, ["k"], ["n"], by_batch=True).drop("parts"), ["k"], ["n"])
    assert {r["window_us"]: tuple(r[c] for c in ("on_time", "late", "refused", "n")) for r in merged.collect()} == once
    assert combine(partials(df.limit(0), ["k"], "b"), ["k"]).collect() == []
