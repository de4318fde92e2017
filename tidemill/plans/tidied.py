"""Reports on raw tables with identifiers and names compared trimmed and regardless of case, blank as null.

Beside the queries of the same names without ``_tidy``, which compare raw spellings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.operators import checks, profile
from tidemill.operators.dedup import keep_first_keyed
from tidemill.operators.warehouse import primary_key_violations
from tidemill.plans.events import sql_tidy
from tidemill.plans.derived import MADE, SQL_MADE, bronze
from tidemill.plans.gold import RAW_KEYS
from tidemill.plans.gold import REGISTRY as GOLD
from tidemill.plans.registry import Registry
from tidemill.plans.relational import EVENT_COLUMNS
from tidemill.plans.reports import CARD, SQL_CHECKS
from tidemill.plans.reports import REGISTRY as REPORTS
from tidemill.sources.specs import SPECS
from tidemill.sources.tables import table

REGISTRY = Registry()

#: What is compared tidied, by table.
TIDIED = {
    "raw_orders": ["order_id", "customer_id", "restaurant_id", "driver_id", "delivery_city"],
    "raw_order_items": ["order_item_id", "order_id", "menu_item_id"],
    "raw_menu_items": ["menu_item_id", "restaurant_id", "category"],
    "raw_customers": ["customer_id", "city", "district", "segment"],
    "raw_restaurants": ["restaurant_id", "city", "district", "category"],
    "raw_delivery_events": ["event_id", "order_id", "driver_id", "city"],
}
#: The same tables for SQL that reads them by their names.
SQL_TIDIED = "with " + ", ".join(f"{t} as (select * replace ({', '.join(f'{sql_tidy(c)} as {c}' for c in cols)}) from main.{t})" for t, cols in TIDIED.items())


def tidied(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).withColumns({c: tidy(c) for c in TIDIED[name]})


@REGISTRY.add(
    "dedup_first_tidy",
    f"{SQL_TIDIED} select {', '.join(EVENT_COLUMNS)} from (select *, case when event_id is null then 1 else row_number() over (partition by event_id order by "
    + ", ".join(f"{c} asc nulls first" for c in ["sequence_number", *EVENT_COLUMNS[1:]])
    + ") end rn from raw_delivery_events) where rn = 1",
)
def dedup_first_tidy(spark: SparkSession, folder: str) -> DataFrame:
    """Of each event_id the row of the least sequence number, and every row without event_id."""
    rows = tidied(spark, folder, "raw_delivery_events").select(*EVENT_COLUMNS)
    return keep_first_keyed(rows, "event_id", [F.col(c) for c in ["sequence_number", *EVENT_COLUMNS[1:]]])


@REGISTRY.add("primary_key_violations_tidy", f"{SQL_TIDIED} {GOLD.sql['primary_key_violations']}")
def primary_key_violations_tidy(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [primary_key_violations(tidied(spark, folder, t).select(k), k, t) for t, k in RAW_KEYS])


@REGISTRY.add("bronze_checks_tidy", f"{SQL_TIDIED}, {SQL_MADE} {SQL_CHECKS}")
def bronze_checks_tidy(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [checks.check_table(bronze(spark, folder, n) if n in MADE else tidied(spark, folder, n), s) for n, s in SPECS.items()])


@REGISTRY.add("cardinality_report_tidy", f"{SQL_TIDIED} {REPORTS.sql['cardinality_report']}")
def cardinality_report_tidy(spark: SparkSession, folder: str) -> DataFrame:
    return profile.cardinality_report(tidied(spark, folder, "raw_orders"), "raw_orders", CARD)
