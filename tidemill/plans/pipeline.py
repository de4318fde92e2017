"""From sources to features in one call: bronze, checks, silver and gold, checks, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidemill.operators import checks, features, star
from tidemill.sources.scan import ingest, read_bronze
from tidemill.sources.sinks import replace_table, write_partitions
from tidemill.sources.specs import SPECS


def build_bronze(spark: SparkSession, sources: dict[str, DataFrame], root: str, run_date: str, at: Column | None = None) -> DataFrame:
    """Ingest every source that has a contract; the checks of all tables, or an error if a critical one fails."""
    out = None
    for name, spec in SPECS.items():
        if name in sources:
            write_partitions(ingest(spark, spec, sources[name], run_date, at), f"{root}/{name}")
            one = checks.check_table(read_bronze(spark, root, name, spec.merge_schema), spec)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source has a contract")
    return checks.require(out)


def build_gold(spark: SparkSession, root: str, as_of: Column, silver: str = "silver", gold: str = "gold") -> dict[str, int]:
    """Staged tables, dimensions and facts as managed tables, then their constraints; rows of each, or an error.

    Each table is read back once written, so nothing is made twice. Of a key the latest row of all days counts.
    """
    rows: dict[str, int] = {}

    def save(df: DataFrame, database: str, name: str) -> DataFrame:
        rows[f"{database}.{name}"] = replace_table(spark, df, database, name)
        return spark.table(f"{database}.{name}")

    messages = read_bronze(spark, root, "raw_delivery_events")
    orders = save(star.stage_orders(read_bronze(spark, root, "raw_orders")), silver, "stg_orders")
    events = save(star.stage_events(messages), silver, "stg_delivery_events")
    loose = save(star.unkeyed_events(messages), silver, "stg_delivery_events_unkeyed")
    sources = {"customer": "raw_customers", "restaurant": "raw_restaurants", "driver": "raw_drivers", "menu_item": "raw_menu_items"}
    dims = {n: save(star.dimension(read_bronze(spark, root, t, SPECS[t].merge_schema), n, as_of), gold, f"dim_{n}") for n, t in sources.items()}
    tables = {f"dim_{n}": d for n, d in dims.items()}
    tables["fact_orders"] = save(star.fact_orders(orders, dims), gold, "fact_orders")
    tables["fact_delivery_events"] = save(star.fact_events(events, dims["driver"]), gold, "fact_delivery_events")
    save(star.fact_events(loose, dims["driver"]), gold, "fact_delivery_events_unkeyed")
    tables["fact_order_items"] = save(star.fact_items(read_bronze(spark, root, "raw_order_items"), dims["menu_item"]), gold, "fact_order_items")
    checks.require(star.validate(tables))
    return rows


def build_features(spark: SparkSession, created: Column | None = None, silver: str = "silver", gold: str = "gold") -> DataFrame:
    """The three feature tables; their checks, or an error if one fails."""
    orders, kitchens = spark.table(f"{silver}.stg_orders"), spark.table(f"{gold}.dim_restaurant").where("is_current")
    tables = {
        "feat_customer_order_freq_7d": (features.order_frequency(orders, 7, created), "customer_id"),
        "feat_restaurant_avg_prep_time_30d": (features.preparation_time(orders, kitchens, 30, created), "restaurant_id"),
        "feat_driver_acceptance_rate_7d": (features.acceptance_rate(orders, 7, created), "driver_id"),
    }
    out = None
    for name, (df, entity) in tables.items():
        replace_table(spark, df, gold, name)
        one = checks.check_features(spark.table(f"{gold}.{name}"), entity, name)
        out = one if out is None else out.unionByName(one)
    if bad := [r["name"] for r in out.where("not passed").collect()]:
        raise ValueError(f"feature tables fail their checks: {bad}")
    return out
