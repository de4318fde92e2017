from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.operators.checks import check_table, failed_critically, require, summarise
from tidemill.operators.dedup import copies_per_batch, duplicate_rate, keep_best, keep_first, keep_first_keyed
from tidemill.operators.warehouse import foreign_key_violations, initial_load, latest_snapshot, look_up, merge_versions, primary_key_violations, surrogate_keys
from tidemill.plans.catalogue import REGISTRIES
from tidemill.plans.gold import REGISTRY
from tidemill.sources.specs import TableSpec

T = [datetime(2026, 1, d) for d in range(1, 5)]
CATALOGUE = {n: q for r in REGISTRIES for n, q in r.queries.items()}
VERSIONS = "k string, a string, valid_from_ts timestamp_ntz, valid_to_ts timestamp_ntz, is_current boolean"


def test_merge_closes_opens_and_keeps(spark):
    current = spark.createDataFrame([("same", "x", T[0], None, True), ("changed", "x", T[1], None, True), ("changed", "w", T[0], T[1], False), ("absent", None, T[0], None, True), ("null", None, T[0], None, True)], VERSIONS)
    snapshot = spark.createDataFrame([("same", "x"), ("changed", None), ("new", "n"), ("null", None), (None, "z")], "k string, a string")
    at = F.lit(T[2]).cast("timestamp_ntz")
    once = merge_versions(current, snapshot, "k", ["a"], at)
    got = {tuple(r) for r in once.collect()}
    assert got == {("same", "x", T[0], None, True), ("changed", "x", T[1], T[2], False), ("changed", "w", T[0], T[1], False), ("changed", None, T[2], None, True), ("absent", None, T[0], None, True), ("null", None, T[0], None, True), ("new", "n", T[2], None, True)}
    assert {tuple(r) for r in merge_versions(once, snapshot, "k", ["a"], F.lit(T[3]).cast("timestamp_ntz")).collect()} == got
    assert merge_versions(current.limit(0), snapshot.limit(0), "k", ["a"], at).collect() == []


def test_keys_and_references(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "k string, v int")
    assert {r["k"]: r["sk"] for r in surrogate_keys(df, "sk", ["k"]).collect()} == {"a": 1, "b": 2, "c": 3}
    dim = initial_load(df.select("k"), "k", "sk", F.lit(T[0]).cast("timestamp_ntz"))
    fact = spark.createDataFrame([("f1", "a"), ("f2", None), ("f3", "zz"), ("f4", "zz")], "id string, k string")
    assert {r["id"]: r["sk"] for r in look_up(fact, dim, "k", "sk", "id").collect()} == {"f1": 1, "f2": None, "f3": None, "f4": None}
    assert tuple(foreign_key_violations(fact, "k", dim, "k", "f")[["orphan_keys", "orphan_rows"]].first()) == (1, 2)
    twice = df.unionByName(df.limit(1)).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k string, v int"))
    assert tuple(primary_key_violations(twice, "k", "t").first()) == ("t", 1, 2)
    assert tuple(primary_key_violations(df.limit(0), "k", "t").first()) == ("t", 0, 0)
    days = spark.createDataFrame([("a", T[0].date()), ("a", T[1].date())], "k string, ingested_date date")
    assert latest_snapshot(days).count() == 1 and latest_snapshot(days.limit(0)).count() == 0


def test_deduplication(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), (None, 1, "n"), (None, 3, "m")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    assert {tuple(r) for r in keep_best(df, ["k"], [F.col("t")]).collect()} == {("a", 2, "z"), ("b", None, "q"), (None, 3, "m")}
    assert {tuple(r) for r in keep_first(df, ["k"], [F.col("t")]).collect()} == {("a", 1, "x"), ("b", None, "q"), (None, 1, "n")}
    best = keep_best(df, ["k"], [F.col("t")])
    assert sorted(map(repr, keep_best(best, ["k"], [F.col("t")]).collect())) == sorted(map(repr, best.collect()))
    assert tuple(duplicate_rate(df, "k").first()) == (4, 2, 2, 100.0)
    assert tuple(duplicate_rate(df.limit(0), "k").first()) == (0, 0, 0, None)
    assert {tuple(r) for r in copies_per_batch(df, "k", "t").collect()} == {(1, 0), (2, 1), (None, 0)}


def test_rows_without_a_key_stay(spark, tmp_path):
    rows = [("a", 2, "x"), ("a", 1, "y"), (None, 1, "n"), (None, 1, "n"), (" ", 3, "m")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    assert sorted(map(repr, map(tuple, keep_first_keyed(df, "k", [F.col("t")]).collect()))) == sorted(map(repr, [("a", 1, "y"), *rows[2:]]))
    # staged events and those without an identifier are together one row an identifier and all rows without one
    raw = spark.read.parquet("/root/testdata/sf0.001/raw_delivery_events.parquet").limit(40)
    ids = F.when(F.col("_kafka_offset") % 3 == 0, None).when(F.col("_kafka_offset") % 3 == 1, " ").otherwise(F.col("event_id"))
    raw.withColumn("event_id", ids).write.parquet(str(tmp_path / "raw_delivery_events.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/raw_orders.parquet").write.parquet(str(tmp_path / "raw_orders.parquet"))
    held = spark.read.parquet(str(tmp_path / "raw_delivery_events.parquet")).select(tidy("event_id").alias("id"))
    keyed, rest = held.where("id is not null").distinct().count(), held.where("id is null").count()
    assert rest > 10
    for name in ("stg_delivery_events", "fact_delivery_events"):
        assert REGISTRY.queries[name](spark, str(tmp_path)).count() == keyed
        assert REGISTRY.queries[f"{name}_unkeyed"](spark, str(tmp_path)).count() == rest


def test_check_severities_and_boundaries(spark):
    spec = TableSpec("t", "id", ("id", "v"), min_rows=21)
    at = lambda df: {r["check"]: (r["passed"], r["severity"]) for r in check_table(df, spec).collect()}
    five = spark.createDataFrame([(i, "v") for i in range(20)] + [(0, "v")], "id int, v string")  # exactly 5 % over distinct keys
    assert at(five) == {"schema": (True, "critical"), "rows": (True, "warning"), "nulls": (True, "warning"), "duplicates": (True, "warning")}
    more = five.unionByName(spark.createDataFrame([(1, None)], "id int, v string"))
    assert at(more)["duplicates"] == (False, "warning") and at(more)["nulls"] == (False, "warning")
    assert at(five.limit(5))["rows"] == (False, "warning") and at(five.limit(0))["rows"] == (False, "critical")
    null_key = five.unionByName(spark.createDataFrame([(None, "v")], "id int, v string"))
    assert at(null_key)["nulls"] == (False, "critical")
    keyless = check_table(five.drop("id"), spec)
    assert {r["check"] for r in failed_critically(keyless).collect()} == {"schema", "duplicates"}
    try:
        require(keyless)
        raise AssertionError("critical checks must raise")
    except ValueError as e:
        assert "schema" in str(e)
    total = summarise(check_table(five, spec).unionByName(keyless)).first()
    assert total["total_rows"] == 42 and total["criticals"] == 2


def test_tidied_reports_join_spellings(spark, tmp_path):
    source, folder = "/root/testdata/sf0.001", str(tmp_path)
    for name in ("raw_order_items", "raw_menu_items", "raw_customers", "raw_restaurants"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{source}/{name}.parquet")
    shout = lambda c: F.concat(F.lit(" "), F.upper(c)).alias(c)
    for name, key in (("raw_delivery_events", "event_id"), ("raw_orders", "order_id")):
        rows = spark.read.parquet(f"{source}/{name}.parquet").where(tidy(key).isNotNull()).withColumn(key, tidy(key)).dropDuplicates([key]).orderBy(key).limit(20)
        rows.unionByName(rows.withColumn(key, shout(key))).unionByName(rows.limit(3).withColumn(key, F.lit(" "))).unionByName(rows.limit(2).withColumn(key, F.lit(None).cast("string"))).write.parquet(f"{folder}/{name}.parquet")
    run = lambda name: CATALOGUE[name](spark, folder)
    assert (run("dedup_first").count(), run("dedup_first_tidy").count()) == (42, 25)
    keys = {r["name"]: (r["repeated_keys"], r["null_keys"]) for r in run("primary_key_violations_tidy").collect()}
    assert keys["raw_delivery_events"] == keys["raw_orders"] == (20, 5)
    found = {(r["table"], r["check"]): r for r in run("bronze_checks_tidy").collect()}
    assert found["raw_delivery_events", "duplicates"]["value"] == 100.0 and found["raw_delivery_events", "nulls"]["severity"] == "critical"
    assert {r["column"]: r["n_distinct"] for r in run("cardinality_report_tidy").collect()}["order_id"] == 20
