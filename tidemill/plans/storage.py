"""Physical layout: schema versions, idempotent partitions, small files, clustering, buckets, inventories."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.operators.layout import compact, probe, skipping, vacuum, zorder
from tidemill.plans.events import sql_tidy
from tidemill.plans.registry import Registry
from tidemill.plans.relational import items, menu_items
from tidemill.session import shared_folder
from tidemill.sources.scan import footer_schemas, has_column, inventory, read_bronze
from tidemill.sources.sinks import replace_table, write_partitions, write_small_files, write_versions
from tidemill.sources.tables import table

REGISTRY = Registry()
SPLIT = "2026-04-20"


def two_versions(spark: SparkSession, folder: str) -> str:
    """raw_menu_items in two physical schemas: spice_level only exists in partitions from ``SPLIT`` on."""
    out = shared_folder(spark, "menu")
    rows = table(spark, folder, "raw_menu_items").withColumn("ingested_date", F.to_date("ingested_at"))
    split = F.lit(SPLIT).cast("date")
    write_versions(rows.where(F.col("ingested_date") < split).drop("spice_level"), rows.where(F.col("ingested_date") >= split), out)
    return out


@REGISTRY.add(
    "schema_evolution_merge",
    f"""select ingested_at::date < date '{SPLIT}' legacy, count(*) "rows", count(*) filter (ingested_at::date >= date '{SPLIT}' and spice_level is null) still_null,
  count(*) filter (ingested_at::date < date '{SPLIT}') filled from raw_menu_items group by 1""",
)
def schema_evolution_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Both schemas read as one; rows from before the column get -1, later nulls stay null."""
    rows = read_bronze(spark, two_versions(spark, folder), "", merge_schema=True)
    legacy = F.col("ingested_date") < SPLIT
    level = F.when(legacy & F.col("spice_level").isNull(), F.lit(-1)).otherwise(F.col("spice_level"))
    return rows.select(legacy.alias("legacy"), level.alias("level")).groupBy("legacy").agg(F.count("*").alias("rows"), F.count_if(F.col("level").isNull()).alias("still_null"), F.count_if(F.col("level") == -1).alias("filled"))


@REGISTRY.add("schema_versions")
def schema_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What the footers of both schemas say."""
    return footer_schemas(spark, two_versions(spark, folder), "spice_level")


@REGISTRY.add("schema_unmerged")
def schema_unmerged(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline: whether a scan without merged schemas happens to see the column."""
    out = two_versions(spark, folder)
    return spark.createDataFrame([(False, has_column(spark, out, "spice_level")), (True, "spice_level" in read_bronze(spark, out, "", True).columns)], "merged boolean, sees_column boolean")


@REGISTRY.add("partition_overwrite", "select order_time::date ingested_date, count(*) orders from raw_orders group by 1")
def partition_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Days written twice are there once."""
    out = shared_folder(spark, "orders")
    rows = table(spark, folder, "raw_orders").select("order_id", F.to_date("order_time").alias("ingested_date"))
    write_partitions(rows, out)
    last = rows.agg(F.max("ingested_date")).first()[0]
    write_partitions(rows.where(F.col("ingested_date") == F.lit(last)), out)
    return spark.read.parquet(out).groupBy("ingested_date").agg(F.count("*").alias("orders"))


PROBE = ["order_id", "delivery_city", "restaurant_id", "total_amount", "order_time"]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_orders").select("order_id", tidy("delivery_city").alias("delivery_city"), tidy("restaurant_id").alias("restaurant_id"), "total_amount", "order_time")


def _condition():
    return (F.col("delivery_city") == "hoa kiet") & (F.col("restaurant_id") == "rst000001")


SQL_PROBE = f"select count(*) \"rows\", coalesce(sum(total_amount), 0)::bigint total from raw_orders where {sql_tidy('delivery_city')} = 'hoa kiet' and {sql_tidy('restaurant_id')} = 'rst000001'"


def small_files(spark: SparkSession, folder: str) -> str:
    out = shared_folder(spark, "small")
    write_small_files(_orders(spark, folder), out, 200)
    return out


def compacted(spark: SparkSession, small: str) -> str:
    out = shared_folder(spark, "large")
    compact(spark, small, out)
    return out


def clustered(spark: SparkSession, folder: str) -> str:
    out = shared_folder(spark, "zorder")
    zorder(_orders(spark, folder), ["delivery_city", "restaurant_id"], 16).write.mode("append").parquet(out)
    return out


@REGISTRY.add("zorder_probe", SQL_PROBE)
def zorder_probe(spark: SparkSession, folder: str) -> DataFrame:
    """The probe over files clustered by city and restaurant."""
    return probe(spark.read.parquet(clustered(spark, folder)), _condition(), "total_amount")


@REGISTRY.add("compaction_probe", SQL_PROBE)
def compaction_probe(spark: SparkSession, folder: str) -> DataFrame:
    """The probe over files that were many and small, after compaction; the small ones are deleted."""
    small = small_files(spark, folder)
    large = compacted(spark, small)
    vacuum(spark, small)
    return probe(spark.read.parquet(large), _condition(), "total_amount")


@REGISTRY.add("layout_probes", f"select layout, p.* from ({SQL_PROBE}) p, (values ('small files'), ('compacted'), ('clustered')) l(layout)")
def layout_probes(spark: SparkSession, folder: str) -> DataFrame:
    """The same answer before and after compaction and clustering."""
    small = small_files(spark, folder)
    places = {"small files": small, "compacted": compacted(spark, small), "clustered": clustered(spark, folder)}
    return reduce(DataFrame.unionByName, [probe(spark.read.parquet(at), _condition(), "total_amount").withColumn("layout", F.lit(n)) for n, at in places.items()])


@REGISTRY.add("layout_report")
def layout_report(spark: SparkSession, folder: str) -> DataFrame:
    """(layout, files, files_read, groups, groups_read, rows_read): what the probe's reader can't skip, from footers."""
    small = small_files(spark, folder)
    places = {"small files": small, "compacted": compacted(spark, small), "clustered": clustered(spark, folder)}
    wanted = {"delivery_city": "hoa kiet", "restaurant_id": "rst000001"}
    return reduce(DataFrame.unionByName, [skipping(spark, at, wanted).withColumn("layout", F.lit(n)) for n, at in places.items()])


@REGISTRY.add(
    "bucketed_join",
    f"""select m.category, count(*) items from raw_order_items i join (select {sql_tidy("menu_item_id")} id, last({sql_tidy("category")} order by ingested_at nulls first, {sql_tidy("category")} nulls first) category
  from raw_menu_items where {sql_tidy("menu_item_id")} is not null group by 1) m on m.id = {sql_tidy("i.menu_item_id")} group by 1""",
)
def bucketed_join(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides bucketed by the key: the join itself shuffles nothing."""
    tag = uuid.uuid4().hex[:12]
    replace_table(spark, items(spark, folder).select("menu_item_id", "order_item_id"), "tidemill_buckets", f"items_{tag}", (8, "menu_item_id"))
    replace_table(spark, menu_items(spark, folder), "tidemill_buckets", f"menu_{tag}", (8, "menu_item_id"))
    left, right = spark.table(f"tidemill_buckets.items_{tag}"), spark.table(f"tidemill_buckets.menu_{tag}")
    return left.join(right.hint("merge"), "menu_item_id").groupBy("category").agg(F.count("*").alias("items"))


@REGISTRY.add("storage_inventory")
def storage_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files, partitions and megabytes of each table of the folder, from listings only."""
    return inventory(spark, folder)
