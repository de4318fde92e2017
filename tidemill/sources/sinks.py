"""Writers: partitioned and managed tables, few or many files, databases, routed topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.frames import drop_prefixed, reindex
from tidemill.sources.scan import read_bronze
from tidemill.sources.specs import SPECS


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the parquet table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: str = "ingested_date") -> None:
    """Replace only the partitions that ``df`` has rows of: writing the same day twice leaves one copy.

    Rows of a day are brought together first, so a day gets few files; a day of many rows is split by AQE.
    """
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_by_day(df: DataFrame, path: str, at: str) -> None:
    """Partition by the day of ``at``, so that late rows land in their own day."""
    write_partitions(df.withColumn("ingested_date", F.to_date(F.col(at).try_cast("timestamp"))), path)


def write_versions(first: DataFrame, second: DataFrame, path: str, by: str = "ingested_date") -> None:
    """Two schemas in one table: each writes its own partitions, with its own footers."""
    write_partitions(first, path, by)
    write_partitions(second, path, by)


def replace_table(spark: SparkSession, df: DataFrame, database: str, name: str, buckets: tuple[int, str] | None = None) -> int:
    """Replace the managed table and return its rows, counted from the written files and not by running ``df`` twice.

    With ``buckets`` (number, key) the table is bucketed and sorted by the key, for joins without a shuffle.
    """
    spark.sql(f"create database if not exists {database}")
    spark.sql(f"drop table if exists {database}.{name}")
    writer = df.write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(*buckets).sortBy(buckets[1])
    writer.saveAsTable(f"{database}.{name}")
    return spark.table(f"{database}.{name}").count()


def reset_database(spark: SparkSession, database: str) -> None:
    """Drop a database with all its tables and make it anew."""
    spark.sql(f"drop database if exists {database} cascade")
    spark.sql(f"create database {database}")


def register_bronze(spark: SparkSession, root: str, database: str = "bronze") -> dict[str, int]:
    """All raw tables as managed tables; rows of each."""
    return {name: replace_table(spark, read_bronze(spark, root, name, spec.merge_schema), database, name) for name, spec in SPECS.items()}


def write_small_files(df: DataFrame, path: str, files: int = 200) -> None:
    """Exactly ``files`` files, as many small commits would leave them."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def mirror_jdbc(df: DataFrame, url: str, relation: str, batch: int = 10_000, parts: int = 8) -> None:
    """Replace a relation of a database; at most ``parts`` connections write at once."""
    df.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", relation).option("batchsize", batch).option("truncate", True).mode("overwrite").save()


def bulk_load(df: DataFrame, url: str, relation: str, key: str, batch: int = 10_000, parts: int = 8) -> None:
    """Replace a relation of a database in batches, then index it by its key: the index is built once, over all rows."""
    mirror_jdbc(df, url, relation, batch, parts)
    connection = df.sparkSession._jvm.java.sql.DriverManager.getConnection(url)
    try:
        quoted = connection.getMetaData().getIdentifierQuoteString()
        connection.createStatement().execute(f"create index {relation.replace('.', '_')}_{key} on {relation} ({quoted}{key}{quoted})")
    finally:
        connection.close()


def write_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """CSV of exactly these columns, missing ones null: what a bulk load takes."""
    reindex(df, columns).write.mode("overwrite").option("header", True).csv(path)


def routed(events: DataFrame, key: str = "order_id", narrow: tuple[str, ...] = ("PICKED_UP", "DELIVERED")) -> DataFrame:
    """Messages (topic, key, value): all to gps-topic, those of ``narrow`` types to order-topic too; private columns cut.

    One pass over the events; the topic column is what a Kafka writer routes by.
    """
    public = drop_prefixed(events)
    topics = F.array_compact(F.array(F.lit("gps-topic"), F.when(F.col("event_type").isin(*narrow), "order-topic")))
    return public.select(F.explode(topics).alias("topic"), F.col(key).alias("key"), F.to_json(F.struct(*public.columns)).alias("value"))


def write_routed(messages: DataFrame, path: str) -> None:
    """Messages as JSON lines, a folder per topic; with Kafka at hand, ``format('kafka')`` takes the same frame."""
    messages.write.mode("append").partitionBy("topic").json(path)


