"""Problem 6: the history of changing customer attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import second_text, tidy
from tidemill.operators.history import Layout, append, change_counts, first_load, paired, split_by_rate, view
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.session import cut, shared_folder
from tidemill.sources.tables import table

REGISTRY = Registry()
ATTRIBUTES = ["city", "district", "segment"]
TYPES = {c: "string" for c in ATTRIBUTES}
#: raw_customers before dim_customer, then the latest ingested.
PRIORITY = ["raw", "ingested_at", "sk"]
#: Rows that came in before this are the first of two loads.
SECOND_LOAD = "2026-04-20"


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of customers at each moment: (customer_id, at, city, district, segment, raw, ingested_at, sk)."""
    shown = [tidy("customer_id").alias("customer_id"), *[tidy(c).alias(c) for c in ATTRIBUTES]]
    raw = table(spark, folder, "raw_customers").select(*shown, F.col("snapshot_ts").alias("at"), F.lit(1).alias("raw"), "ingested_at", F.lit(None).cast("bigint").alias("sk"))
    dim = table(spark, folder, "dim_customer").select(*shown, F.col("valid_from_ts").alias("at"), F.lit(0).alias("raw"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"), F.col("customer_sk").alias("sk"))
    return raw.unionByName(dim)


SQL_VERSIONS = f"""
with r as (
  select {sql_tidy("customer_id")} id, snapshot_ts at_, 1 raw, ingested_at, 0 sk, {sql_tidy("city")} city, {sql_tidy("district")} district, {sql_tidy("segment")} segment from raw_customers
  union all
  select {sql_tidy("customer_id")}, valid_from_ts, 0, null, customer_sk, {sql_tidy("city")}, {sql_tidy("district")}, {sql_tidy("segment")} from dim_customer
), m as (
  select * from (select *, row_number() over (partition by id, at_ order by raw desc, ingested_at desc nulls last, sk desc nulls last,
    city desc nulls last, district desc nulls last, segment desc nulls last) rn from r where id is not null and at_ is not null) where rn = 1
), d as (
  select *, row_number() over w n, lag(city) over w c0, lag(district) over w d0, lag(segment) over w s0 from m window w as (partition by id order by at_)
), v as (
  select id, at_, city, district, segment, lead(at_) over (partition by id order by at_) until from d
  where n = 1 or city is distinct from c0 or district is distinct from d0 or segment is distinct from s0
)"""


def load(rows: DataFrame) -> tuple[Layout, DataFrame, DataFrame]:
    """A first load: satellites split by the change rates found, and the rows of both tables."""
    pairs = paired(rows, "customer_id", "at", ATTRIBUTES, PRIORITY)
    layout = Layout("customer_id", "at", split_by_rate(change_counts(pairs, ATTRIBUTES)), PRIORITY)
    return layout, *first_load(pairs, layout)


@REGISTRY.add(
    "p6_found",
    SQL_VERSIONS + " select id customer_id, strftime(at_, '%Y-%m-%d %H:%M:%S') valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), '') valid_to from v",
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    layout, _, satellites = load(readings(spark, folder))
    found = view(satellites, layout, TYPES)
    return found.select("customer_id", second_text(F.col("valid_from")).alias("valid_from"), F.coalesce(second_text(F.col("valid_to")), F.lit("")).alias("valid_to"))


SQL_HISTORY = SQL_VERSIONS + " select id customer_id, city, district, segment, at_ valid_from_ts, until valid_to_ts, until is null is_current from v"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("customer_id", *ATTRIBUTES, F.col("valid_from").alias("valid_from_ts"), F.col("valid_to").alias("valid_to_ts"), "is_current")


@REGISTRY.add("p6_history", SQL_HISTORY)
def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    """The versions with what the satellites hold of them."""
    layout, _, satellites = load(readings(spark, folder))
    return _shown(view(satellites, layout, TYPES))


@REGISTRY.add("p6_history_of_two_loads", SQL_HISTORY)
def p6_history_of_two_loads(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a store written by two loads: dim_customer and what came in before ``SECOND_LOAD``, then the rest, late readings among it."""
    rows = readings(spark, folder)
    late = (F.col("raw") == 1) & (F.coalesce(F.col("ingested_at") >= F.lit(SECOND_LOAD).cast("timestamp_ntz"), F.lit(False)))
    layout, seen, satellites = load(rows.where(~late))
    store = {"seen": shared_folder(spark, "seen"), "satellites": shared_folder(spark, "satellites")}
    for name, df in (("seen", seen), ("satellites", satellites)):
        df.write.mode("append").parquet(store[name])
    stored = {name: spark.read.schema(df.schema).parquet(store[name]) for name, df in (("seen", seen), ("satellites", satellites))}
    # both are made before either is written
    more = [cut(df) for df in append(stored["seen"], stored["satellites"], rows.where(late), layout)]
    for name, df in zip(store, more, strict=True):
        df.write.mode("append").parquet(store[name])
    return _shown(view(spark.read.schema(satellites.schema).parquet(store["satellites"]), layout, TYPES))
