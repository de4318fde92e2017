"""A star schema from raw tables: staged rows, dimensions, facts, and the constraints that hold on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.frames import add_missing
from tidemill.functions.text import clock_micros, micros_to_ntz, tidy
from tidemill.operators.dedup import keep_best, keep_first
from tidemill.operators.warehouse import foreign_key_violations, initial_load, look_up, primary_key_violations

STAGED_ORDER = ["order_id", "customer_id", "restaurant_id", "driver_id", "order_time", "status", "total_amount", "payment_method", "delivery_city", "distance_km", "estimated_delivery_time", "actual_delivery_time"]
ORDER_KEYS = ["order_id", "customer_id", "restaurant_id", "driver_id"]
STAGED_EVENT = ["event_id", "order_id", "driver_id", "event_type", "event_time", "lat", "lon", "sequence_number"]
EVENT_ORDER = ["sequence_number", "sent_us", "_kafka_partition", "_kafka_offset"]
#: Dimension: its columns beside the key ``<name>_id``.
DIMENSIONS = {
    "customer": ["name", "city", "district", "segment", "signup_date"],
    "restaurant": ["name", "city", "district", "category", "rating", "prep_time_minutes"],
    "driver": ["name", "vehicle_type", "city", "rating"],
    "menu_item": ["restaurant_id", "name", "category", "price", "is_available", "spice_level"],
}
#: Columns of dimensions that are compared, and so kept, trimmed and in lower case.
TIDY = {"city", "district", "segment", "category", "restaurant_id"}
#: What the latest row of a key is by, as far as its table has it: the moment of the state, then that of its arrival.
LATEST = ("snapshot_ts", "ingested_at")
FACT_ORDER = ["order_id", "customer_sk", "restaurant_sk", "driver_sk", *STAGED_ORDER[4:10]]
FACT_EVENT = ["event_id", "order_id", "driver_sk", *STAGED_EVENT[3:]]
FACT_ITEM = ["order_item_id", "order_id", "menu_item_sk", "quantity", "unit_price", "subtotal"]
#: The key of each table, and which column of a fact refers to which dimension.
PRIMARY_KEYS = {
    "dim_customer": "customer_sk",
    "dim_restaurant": "restaurant_sk",
    "dim_driver": "driver_sk",
    "dim_menu_item": "menu_item_sk",
    "fact_orders": "order_id",
    "fact_delivery_events": "event_id",
    "fact_order_items": "order_item_id",
}
FOREIGN_KEYS = [
    ("fact_orders", "customer_sk", "dim_customer"),
    ("fact_orders", "restaurant_sk", "dim_restaurant"),
    ("fact_orders", "driver_sk", "dim_driver"),
    ("fact_delivery_events", "driver_sk", "dim_driver"),
    ("fact_order_items", "menu_item_sk", "dim_menu_item"),
]


def stage_orders(raw: DataFrame) -> DataFrame:
    """Of each order_id the row ingested last, with tidy keys; ties by the greatest other columns."""
    rows = raw.select(*[tidy(c).alias(c) if c in ORDER_KEYS else F.col(c) for c in STAGED_ORDER], "ingested_at")
    return keep_best(rows, ["order_id"], [F.col("ingested_at"), *[F.col(c) for c in STAGED_ORDER if c != "order_id"]]).drop("ingested_at")


def _events(raw: DataFrame) -> DataFrame:
    return add_missing(raw, {"_kafka_partition": "bigint", "_kafka_offset": "bigint"}).select(
        tidy("event_id").alias("event_id"), tidy("order_id").alias("order_id"), tidy("driver_id").alias("driver_id"), "event_type", micros_to_ntz(clock_micros("event_time")).alias("event_time"),
        "lat", "lon", "sequence_number", clock_micros("sent_at").alias("sent_us"), "_kafka_partition", "_kafka_offset",
    )


def stage_events(raw: DataFrame) -> DataFrame:
    """Of each event_id the row of the least sequence number, then the earliest sent.

    A table of keyed rows: messages without event_id are not in it, but all of them in ``unkeyed_events``.
    """
    return keep_first(_events(raw).where("event_id is not null"), ["event_id"], [F.col(c) for c in EVENT_ORDER]).select(*STAGED_EVENT)


def unkeyed_events(raw: DataFrame) -> DataFrame:
    """The messages that ``stage_events`` leaves out: every one without event_id, as none is known to be a copy."""
    return _events(raw).where("event_id is null").select(*STAGED_EVENT)


def latest_rows(raw: DataFrame, name: str) -> DataFrame:
    """(key, columns) of the latest row of each key of a dimension, whichever snapshot it came in; ties by the greatest columns.

    Rows without a key are left out, columns that the table lacks are null.
    """
    key, columns = f"{name}_id", DIMENSIONS[name]
    by = [c for c in LATEST if c in raw.columns]
    rows = add_missing(raw, {c: "double" if c in ("rating", "spice_level") else "string" for c in columns})
    shown = rows.select(tidy(key).alias(key), *[tidy(c).alias(c) if c in TIDY else F.col(c) for c in columns], *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    best = keep_best(shown.where(F.col(key).isNotNull()), [key], [F.col(f"_by{i}") for i in range(len(by))] + [F.col(c) for c in columns])
    return best.select(key, *columns)


def dimension(raw: DataFrame, name: str, as_of: Column) -> DataFrame:
    return initial_load(latest_rows(raw, name), f"{name}_id", f"{name}_sk", as_of)


def fact_orders(staged: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    for name in ("customer", "restaurant", "driver"):
        staged = look_up(staged, dims[name], f"{name}_id", f"{name}_sk", "order_id")
    return staged.select(*FACT_ORDER)


def fact_events(staged: DataFrame, drivers: DataFrame) -> DataFrame:
    return look_up(staged, drivers, "driver_id", "driver_sk", "order_id").select(*FACT_EVENT)


def fact_items(raw: DataFrame, menu: DataFrame) -> DataFrame:
    """One row an order_item_id, the one ingested last; rows without one are left out, as they can't be told apart."""
    rows = raw.select(*[tidy(c).alias(c) for c in ("order_item_id", "order_id", "menu_item_id")], "quantity", "unit_price", "subtotal", "ingested_at").where("order_item_id is not null")
    once = keep_best(rows, ["order_item_id"], [F.col(c) for c in ("ingested_at", "order_id", "menu_item_id", "quantity", "unit_price", "subtotal")])
    return look_up(once, menu, "menu_item_id", "menu_item_sk", "order_item_id").select(*FACT_ITEM)


def primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, repeated_keys, null_keys) of each of ``PRIMARY_KEYS``: both 0 if it holds."""
    return reduce(DataFrame.unionByName, [primary_key_violations(tables[t].select(k), k, t) for t, k in PRIMARY_KEYS.items()])


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, orphan_keys, orphan_rows) of each of ``FOREIGN_KEYS``; null refers to nothing and is allowed."""
    return reduce(DataFrame.unionByName, [foreign_key_violations(tables[f].select(k), k, tables[d], k, f"{f}.{k}") for f, k, d in FOREIGN_KEYS])


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, check, passed, severity, value, detail), all critical: what must hold before a star is served.

    Every table has rows; a business key has one current version at most; dimensions have the three columns of
    validity; the primary and the foreign keys hold.
    """

    def row(table, check: str, passed: Column, value: Column, detail) -> list[Column]:
        name = F.lit(table) if isinstance(table, str) else table
        return [name.alias("table"), F.lit(check).alias("check"), passed.alias("passed"), F.lit("critical").alias("severity"), value.cast("double").alias("value"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")]

    found = []
    for t in PRIMARY_KEYS:
        found.append(tables[t].agg(F.count("*").alias("n")).select(*row(t, "rows", F.col("n") > 0, F.col("n"), "at least 1")))
    for n in DIMENSIONS:
        d = tables[f"dim_{n}"]
        twice = d.where("is_current").groupBy(f"{n}_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
        found.append(twice.select(*row(f"dim_{n}", "one current version", F.col("n") == 0, F.col("n"), f"{n}_id")))
        held = sum(c in d.columns for c in ("valid_from_ts", "valid_to_ts", "is_current"))
        found.append(d.sparkSession.range(1).select(*row(f"dim_{n}", "validity columns", F.lit(held == 3), F.lit(held), "3")))
    wrong = F.col("repeated_keys") + F.col("null_keys")
    found.append(primary_keys(tables).select(*row(F.col("name"), "primary key", wrong == 0, wrong, "unique, not null")))
    found.append(foreign_keys(tables).select(*row(F.substring_index("name", ".", 1), "foreign key", F.col("orphan_rows") == 0, F.col("orphan_rows"), F.substring_index("name", ".", -1))))
    return reduce(DataFrame.unionByName, found)
