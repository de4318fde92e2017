from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.operators import checks, star
from tidemill.operators.warehouse import version_invariants
from tidemill.plans.pipeline import build_bronze, build_features, build_gold
from tidemill.sources import fixtures
from tidemill.sources.scan import ingest, inventory
from tidemill.sources.sinks import write_partitions
from tidemill.sources.specs import SPECS
from tidemill.streaming.pings import window_speed
from tidemill.functions.text import clock_micros

V = fixtures.Volume(customers=200, restaurants=40, drivers=20, menu_items=150, orders=1500, days=40)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    for name, df in fixtures.everything(spark, V).items():
        df.write.parquet(f"{root}/{name}")
    return {p: spark.read.parquet(f"{root}/{p}") for p in fixtures.everything(spark, V)}


def test_fixtures_have_the_planted_defects(spark, raw):
    orders = raw["raw_orders"]
    assert orders.count() == 1500 + 30 and orders.select("order_id").distinct().count() == 1500
    sums = raw["raw_order_items"].groupBy("order_id").agg(F.sum("subtotal").alias("s"))
    wrong = orders.dropDuplicates(["order_id"]).join(sums, "order_id", "left").where("total_amount <> s").count()
    assert 0 < wrong < 20
    events = raw["raw_delivery_events"]
    extra = events.count() - events.select("event_id").distinct().count()
    assert abs(extra / events.count() - V.stream_duplicate_rate) < 0.005
    delays = events.select((clock_micros("sent_at") - clock_micros("event_time")).alias("d")).agg(F.avg((F.col("d") > 5_000_000).cast("double"))).first()[0]
    assert abs(delays - V.late_rate) < 0.02
    home = raw["raw_customers"].select("customer_id", "city", "segment")
    placed = orders.dropDuplicates(["order_id"]).join(home, "customer_id")
    away, vip = placed.agg(F.avg((F.col("city") != F.col("delivery_city")).cast("double")), F.avg((F.col("segment") == "vip").cast("double"))).first()
    assert 0 < away < V.cross_city + 0.02 and vip > 2 * home.where("segment = 'vip'").count() / V.customers
    assert orders.where("status = 'cancelled' and (cancelled_reason_code is null or cancelled_reason_text is null)").count() == 0
    assert raw["raw_restaurants"].where("not startswith(district, city)").count() == 0
    assert 0.2 < raw["raw_reviews"].count() / orders.where("status = 'completed'").count() < 0.4
    assert fixtures.everything(spark, V)["raw_customers"].exceptAll(raw["raw_customers"]).count() == 0
    assert V.scaled(0.001).orders == 10


def test_whole_pipeline(spark, raw, tmp_path):
    root, at = str(tmp_path / "bronze"), F.lit("2026-07-20").cast("timestamp_ntz")
    for database in ("t_silver", "t_gold"):
        spark.sql(f"drop database if exists {database} cascade")
    for _ in range(2):
        found = build_bronze(spark, raw, root, "2026-07-20", at)
    assert checks.failed_critically(found).count() == 0
    build_bronze(spark, {k: raw[k] for k in ("raw_customers", "raw_restaurants")}, root, "2026-07-21", at)  # a second day's snapshot
    rows = build_gold(spark, root, at, "t_silver", "t_gold")
    assert rows["t_silver.stg_orders"] == rows["t_gold.fact_orders"] == 1500
    assert rows["t_gold.dim_customer"] == 200 and rows["t_gold.dim_restaurant"] == 40
    assert rows["t_gold.fact_order_items"] == raw["raw_order_items"].count()
    tables = {t: spark.table(f"t_gold.{t}") for t in star.PRIMARY_KEYS}
    assert star.primary_keys(tables).where("repeated_keys + null_keys > 0").count() == star.foreign_keys(tables).where("orphan_rows > 0").count() == 0
    broken = tables | {"fact_order_items": tables["fact_order_items"].unionByName(tables["fact_order_items"].limit(2)), "dim_driver": tables["dim_driver"].drop("valid_to_ts").where("driver_sk > 1")}
    failed = {(r["table"], r["check"]) for r in star.validate(broken).where("not passed").collect()}
    assert failed == {("fact_order_items", "primary key"), ("dim_driver", "validity columns"), ("fact_orders", "foreign key"), ("fact_delivery_events", "foreign key")}
    with pytest.raises(ValueError, match="primary key"):
        checks.require(star.validate(broken))
    inv = version_invariants(spark.table("t_gold.dim_customer"), "customer_id", "customer_sk", "d").first()
    assert inv["versions"] == inv["surrogates"] == inv["current_versions"] == 200
    assert build_features(spark, at, "t_silver", "t_gold").where("passed").count() == 3
    listed = {r["table"]: r for r in inventory(spark, root).collect()}
    assert listed["raw_customers"]["partitions"] == 2 and set(listed) == set(SPECS)
    with pytest.raises(ValueError):
        build_bronze(spark, {}, root, "2026-07-20")
    speeds = window_speed(raw["raw_delivery_events"].withColumn("event_us", clock_micros("event_time")))
    assert 0 < speeds.count() and speeds.agg(F.max("avg_speed_kmh")).first()[0] < 1e5


def test_dimensions_hold_the_latest_row_of_a_key(spark, raw, tmp_path):
    root, at = str(tmp_path / "bronze"), F.lit("2026-07-20").cast("timestamp_ntz")
    for database in ("l_silver", "l_gold"):
        spark.sql(f"drop database if exists {database} cascade")
    moved = lambda days: (F.col("ingested_at") + F.make_dt_interval(F.lit(days))).alias("ingested_at")
    # the latest row has the least name, so it is not the greatest attributes that win
    again = {"raw_restaurants": {"prep_time_minutes": F.lit(1).cast("bigint")}, "raw_menu_items": {"price": F.lit(7).cast("bigint")}}
    mixed = dict(raw)
    for name, values in again.items():
        rows = raw[name]
        later = rows.withColumns({"name": F.lit("A later"), "ingested_at": moved(1), **values})
        earlier = rows.withColumns({"name": F.lit("Z earlier"), "ingested_at": moved(-1)})
        mixed[name] = rows.unionByName(later).unionByName(earlier)
    people = raw["raw_customers"].withColumn("snapshot_ts", F.col("ingested_at"))
    late = people.withColumns({"name": F.lit("Z state of before"), "snapshot_ts": F.col("snapshot_ts") - F.make_dt_interval(F.lit(1)), "ingested_at": moved(5)})  # came in last, but is older
    newest = people.withColumns({"name": F.lit("A now"), "snapshot_ts": F.col("snapshot_ts") + F.make_dt_interval(F.lit(1))})
    mixed["raw_customers"] = people.unionByName(late).unionByName(newest)
    for name, df in mixed.items():
        if name in SPECS:
            write_partitions(ingest(spark, SPECS[name], df, "2026-07-20", at), f"{root}/{name}")
    build_gold(spark, root, at, "l_silver", "l_gold")
    names = lambda n: {tuple(r) for r in spark.table(f"l_gold.dim_{n}").select("name").distinct().collect()}
    assert names("customer") == {("A now",)} and names("restaurant") == {("A later",)} and names("menu_item") == {("A later",)}
    assert {n: spark.table(f"l_gold.dim_{n}").count() for n in ("customer", "restaurant", "menu_item")} == {"customer": 200, "restaurant": 40, "menu_item": 150}
    build_features(spark, at, "l_silver", "l_gold")
    assert spark.table("l_gold.feat_restaurant_avg_prep_time_30d").agg(F.max("avg_prep_time")).first()[0] == 1.0
