from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.functions.frames import add_missing, drop_prefixed, missing_columns, nanos_to_timestamp, preview, reindex, require_rows, shuffle_rows
from tidemill.functions.geo import haversine_km, interpolate
from tidemill.functions.hashing import integrity_hash
from tidemill.operators.layout import compact, explain_timed, probe, rank_bounds, refresh, skipping, timed, vacuum, zorder
from tidemill.operators.skew import merge_join, salted_join, task_sizes
from tidemill.sources.scan import TOPIC_LIMIT, drain_topic, footer_schemas, has_column, ingest, read_bronze, read_jdbc, read_recursive, read_topic_files, with_source_file
from tidemill.sources.sinks import bulk_load, mirror_jdbc, overwrite, replace_table, reset_database, routed, write_by_day, write_csv, write_partitions, write_routed, write_small_files, write_versions
from tidemill.sources.specs import TableSpec
from tidemill.streaming.pings import MESSAGE


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def days(spark, rows):
    return spark.createDataFrame(rows, "id int, day string").withColumn("ingested_date", F.to_date("day")).drop("day")


def test_partitions_are_pruned_and_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    write_partitions(days(spark, [(1, "2026-01-01"), (2, "2026-01-02")]), path)
    write_partitions(days(spark, [(3, "2026-01-02")]), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3]
    some = spark.read.parquet(path).where("ingested_date < '2026-01-02'")
    assert some.count() == 1
    assert "PartitionFilters: [isnotnull(ingested_date" in plan(some).replace("\n", " ")
    folder = with_source_file(read_bronze(spark, str(tmp_path), "t")).select("_source_folder").distinct()
    assert {r[0] for r in folder.collect()} == {"ingested_date=2026-01-01", "ingested_date=2026-01-02"}
    assert read_recursive(spark, str(tmp_path)).count() == 2


def test_two_schemas(spark, tmp_path):
    path = str(tmp_path / "t")
    write_versions(days(spark, [(1, "2026-01-01")]), days(spark, [(2, "2026-01-02")]).withColumn("extra", F.lit(1.5)), path)
    merged = spark.read.option("mergeSchema", True).parquet(path)
    assert {(r["id"], r["extra"]) for r in merged.collect()} == {(1, None), (2, 1.5)}
    assert {(r["columns"], r["has_column"], r["partitions"]) for r in footer_schemas(spark, path, "extra").collect()} == {(1, False, 1), (2, True, 1)}
    assert isinstance(has_column(spark, path, "extra"), bool)
    assert missing_columns(merged, ["id", "nope"]) == ["nope"]
    assert add_missing(merged, {"extra": "string", "more": "double"}).dtypes[-1] == ("more", "double")
    assert reindex(merged, {"z": "int", "id": "int"}).columns == ["z", "id"]
    assert drop_prefixed(merged.withColumn("_x", F.lit(1))).columns == merged.columns
    with pytest.raises(ValueError):
        require_rows(merged.limit(0), "t")


def test_nanosecond_files(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"t": pa.array([1767323045123456789, None], pa.timestamp("ns"))}), path, version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        got = [r[0] for r in spark.read.parquet(path).select(nanos_to_timestamp(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert got == ["2026-01-02 03:04:05.123456", None]


def test_layouts_give_the_same_answers_from_fewer_files(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id"), (F.xxhash64("id") % 50).alias("a"), F.concat(F.lit("s"), F.pmod(F.xxhash64(F.col("id") + 1), F.lit(40))).alias("b"), F.when(F.col("id") % 9 != 0, F.rand(1)).alias("c"))
    df.write.parquet(str(tmp_path / "src"))
    df = spark.read.parquet(str(tmp_path / "src"))
    small, large, z = (str(tmp_path / n) for n in ("small", "large", "z"))
    write_small_files(df, small, 30)
    assert len(spark.read.parquet(small).inputFiles()) == 30 and compact(spark, small, large) == 1
    zorder(df, ["a", "b", "c"], 16).write.parquet(z)
    condition = (F.col("a") == 7) & (F.col("b") == "s3")
    want = probe(df, condition, "id").first()
    assert probe(spark.read.parquet(large), condition, "id").first() == want == probe(spark.read.parquet(z), condition, "id").first()
    spans = spark.read.parquet(z).groupBy(F.input_file_name()).agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("hi - lo < 70").count()
    assert spans >= 8  # along a plain order no file would be narrow in a
    strings = df.select(F.col("a").cast("string").alias("a"), "b").withColumn("id", F.monotonically_increasing_id())
    strings.repartitionByRange(8, "a").write.parquet(str(tmp_path / "by_a"))
    seen = skipping(spark, str(tmp_path / "by_a"), {"a": "7"}).first()
    assert seen["files"] == seen["groups"] == 8 and 1 <= seen["files_read"] == seen["groups_read"] <= 2 and seen["rows_read"] < 10_000
    hot = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "m").otherwise(F.col("id").cast("string")).alias("t"), "id")
    assert 28 <= len(rank_bounds(hot, "t")) <= 36 and "m" in rank_bounds(hot, "t")  # half of the rows are one value, so it is half of the bounds
    assert vacuum(spark, small) and not vacuum(spark, small)
    text, seconds, rows = explain_timed(df.where(condition))
    assert "PushedFilters" in text and rows == want["rows"] and seconds > 0
    with timed("x") as t:
        pass
    assert t.seconds >= 0


def test_buckets_join_without_exchange_and_databases(spark):
    reset_database(spark, "t_layout")
    a = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    assert replace_table(spark, a, "t_layout", "a", (4, "k")) == 1000
    assert replace_table(spark, a.select("k").distinct(), "t_layout", "b", (4, "k")) == 100
    joined = spark.table("t_layout.a").join(spark.table("t_layout.b").hint("merge"), "k")
    assert "Exchange" not in plan(joined) and joined.count() == 1000
    refresh(spark, "t_layout.a")


def test_salted_equals_merge_and_spreads_a_hot_key(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int")
    plain, salted = merge_join(left, right, ["k"]), salted_join(left, right, ["k"], 8, F.col("v"))
    assert "SortMergeJoin" in plan(plain)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert task_sizes(salted).first()["most"] < task_sizes(plain).first()["most"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_topics_routes_and_csv(spark, tmp_path):
    events = [("e1", "o1", "d", "PICKED_UP", 1.0, 2.0, "2026-01-01T00:00:00", "2026-01-01T00:00:01", 0, "c"), ("e2", "o1", "d", "EN_ROUTE", 1.0, 2.0, "2026-01-02T00:00:00", None, 1, None)]
    df = spark.createDataFrame(events, MESSAGE)
    out = routed(df.withColumn("_secret", F.lit(1)))
    assert sorted((r["topic"], r["key"]) for r in out.collect()) == [("gps-topic", "o1"), ("gps-topic", "o1"), ("order-topic", "o1")]
    assert all("_secret" not in json.loads(r["value"]) for r in out.collect())
    write_routed(out, str(tmp_path / "routes"))
    drained = out.where("topic = 'gps-topic'").select(F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), "value")
    drained.write.json(str(tmp_path / "topic"))
    back = read_topic_files(spark, str(tmp_path / "topic"), MESSAGE)
    assert back.count() == 2 and read_topic_files(spark, str(tmp_path / "topic"), MESSAGE, 1).count() == 1
    spec = TableSpec("raw_delivery_events", "event_id", ("event_id",), "topic")
    staged = ingest(spark, spec, back, "2026-01-05", F.lit(datetime(2026, 1, 5)))
    assert {str(r[0]) for r in staged.select("ingested_date").collect()} == {"2026-01-01", "2026-01-02"}
    with pytest.raises(ValueError):
        ingest(spark, TableSpec("x", "k", (), "nowhere"), back, "2026-01-05")
    write_by_day(back, str(tmp_path / "days"), "event_time")
    write_csv(back, str(tmp_path / "csv"), {"event_id": "string", "extra": "int"})
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["event_id", "extra"]
    overwrite(back, str(tmp_path / "o"))
    bad = str(tmp_path / "bad")
    spark.createDataFrame([(0, 0, "{no json")], "partition int, offset long, value string").write.json(bad)
    with pytest.raises(Exception):
        read_topic_files(spark, bad, MESSAGE).collect()
    for outside in (lambda: drain_topic(spark, "localhost:1", "t", MESSAGE), lambda: mirror_jdbc(back, "jdbc:none:x", "t")):
        with pytest.raises(Exception):
            outside()


def test_a_topic_is_drained_to_its_end(spark):
    value = F.to_json(F.struct(F.concat(F.lit("e"), F.col("id")).alias("event_id")))
    messages = spark.range(TOPIC_LIMIT + 3).select(value.alias("value"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"))

    class Topic:
        read = property(lambda self: self)
        format = option = lambda self, *_: self
        load = lambda self: messages

    assert drain_topic(Topic(), "s", "t", MESSAGE).select("event_id").distinct().count() == TOPIC_LIMIT + 3
    assert drain_topic(Topic(), "s", "t", MESSAGE, TOPIC_LIMIT).count() == TOPIC_LIMIT


def test_functions(spark):
    import hashlib

    row = spark.createDataFrame([(10.0, 106.0, 11.0, 107.0)], "a double, b double, c double, d double")
    km = row.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")), haversine_km(F.col("a"), F.col("b"), F.col("a"), F.col("b")), haversine_km(F.lit(None).cast("double"), F.col("b"), F.col("a"), F.col("b")), interpolate(F.col("a"), F.col("c"), F.lit(0.25))).first()
    assert abs(km[0] - 156.0) < 1 and km[1] == 0 and km[2] is None and km[3] == 10.25
    want = b"x|1"
    for _ in range(100):
        want = hashlib.sha256(want).hexdigest().encode()
    assert row.select(integrity_hash([F.lit("x"), F.lit(None), F.lit(1)])).first()[0] == want.decode()


def test_databases_are_loaded_mirrored_and_read_in_ranges(spark, capsys):
    url = "jdbc:derby:memory:tidemill;create=true"
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("v"))
    bulk_load(df, url, "loaded", "id", parts=2)
    back = read_jdbc(spark, url, "loaded", "id", (0, 999), 4)
    assert back.rdd.getNumPartitions() == 4 and back.exceptAll(df).count() == df.exceptAll(back).count() == 0
    mirror_jdbc(df.limit(10), url, "loaded")
    assert read_jdbc(spark, url, "loaded").count() == 10
    rows = [r["id"] for r in shuffle_rows(df, "id").collect()]
    assert sorted(rows) == list(range(1000)) and rows != sorted(rows) and rows == [r["id"] for r in shuffle_rows(df.repartition(3), "id").collect()]
    assert len(preview(df, 3)) == 3 and '"id"' in capsys.readouterr().out


def test_more_messages_than_any_default_limit_are_read(spark, tmp_path):
    value = F.to_json(F.struct(F.col("id").cast("string").alias("event_id")))
    spark.range(TOPIC_LIMIT + 1).select((F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"), value.alias("value")).write.json(str(tmp_path / "t"))
    read = read_topic_files(spark, str(tmp_path / "t"), MESSAGE)
    assert read.count() == TOPIC_LIMIT + 1 and read_topic_files(spark, str(tmp_path / "t"), MESSAGE, TOPIC_LIMIT).count() == TOPIC_LIMIT
