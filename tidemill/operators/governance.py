"""Datasets, lineage, assertions and contracts as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ["source.customer", "source.restaurant", "source.driver", "source.order", "source.order_item", "source.menu_item", "source.review", "source.gps-topic"]
RAW = ["raw_orders", "raw_order_items", "raw_menu_items", "raw_reviews", "raw_customers", "raw_restaurants", "raw_drivers", "raw_delivery_events"]
DIMENSIONS = ["dim_customer", "dim_restaurant", "dim_driver", "dim_menu_item"]
FACTS = ["fact_orders", "fact_delivery_events", "fact_order_items"]
FEATURES = ["feat_customer_order_freq_7d", "feat_restaurant_avg_prep_time_30d", "feat_driver_acceptance_rate_7d"]
#: Pipelines by name: what they read and what they write.
PIPELINES = {
    "ingest": (SOURCES, [f"bronze.{t}" for t in RAW]),
    "transform": ([f"bronze.{t}" for t in RAW], ["silver.stg_orders", "silver.stg_delivery_events", *[f"gold.{t}" for t in [*DIMENSIONS, *FACTS]]]),
    "features": ([f"gold.{t}" for t in [*DIMENSIONS, *FACTS]], [f"gold.{t}" for t in FEATURES]),
}
#: Assertions: dataset and the column that may not be null; a contract is a dataset with all its assertions.
NOT_NULL = [("bronze.raw_orders", "order_id"), ("gold.dim_customer", "customer_sk"), ("gold.dim_customer", "is_current"), ("gold.feat_customer_order_freq_7d", "event_timestamp"), ("gold.feat_customer_order_freq_7d", "created")]


def datasets(spark: SparkSession) -> DataFrame:
    """(dataset, layer) of everything that a pipeline reads or writes."""
    names = sorted({n for reads, writes in PIPELINES.values() for n in [*reads, *writes]})
    return spark.createDataFrame([(n, n.split(".")[0]) for n in names], "dataset string, layer string")


def lineage(spark: SparkSession) -> DataFrame:
    """(pipeline, upstream, downstream): an edge from all that a pipeline reads to all that it writes."""
    rows = [(p, a, b) for p, (reads, writes) in PIPELINES.items() for a in reads for b in writes]
    return spark.createDataFrame(rows, "pipeline string, upstream string, downstream string")


def lineage_counts(spark: SparkSession) -> DataFrame:
    """(pipeline, reads, writes): how many datasets each pipeline reads and writes."""
    return lineage(spark).groupBy("pipeline").agg(F.count_distinct("upstream").alias("reads"), F.count_distinct("downstream").alias("writes"))


def plan_inputs(df: DataFrame) -> list[str]:
    """The files that the plan of ``df`` reads: lineage from the plan itself."""
    return sorted(df.inputFiles())


def assertions(frames: dict[str, DataFrame], not_null: list[tuple[str, str]] | None = None) -> DataFrame:
    """(dataset, column, rows, nulls, passed), evaluated on the frames given; a missing column fails."""
    out = None
    for name, column in not_null if not_null is not None else NOT_NULL:
        if name in frames:
            df = frames[name]
            there = column in df.columns
            nulls = F.count_if(F.col(column).isNull()) if there else F.count("*")
            one = df.agg(F.count("*").alias("rows"), nulls.alias("nulls")).select(F.lit(name).alias("dataset"), F.lit(column).alias("column"), "rows", "nulls", (F.lit(there) & (F.col("nulls") == 0)).alias("passed"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no assertion applies to these frames")
    return out


def contracts(asserted: DataFrame) -> DataFrame:
    """(dataset, assertions, failed, passed): a contract holds if all assertions of its dataset do."""
    return asserted.groupBy("dataset").agg(F.count("*").alias("assertions"), F.count_if(~F.col("passed")).alias("failed"), F.every("passed").alias("passed"))
