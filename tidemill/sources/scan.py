"""Readers: partitioned files, merged schemas, snapshots, bounded topics, and what a folder holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.frames import add_provenance, require_rows
from tidemill.sources.specs import TableSpec

#: A cap for a bounded drain, to be passed as ``limit``.
TOPIC_LIMIT = 200_000


def read_bronze(spark: SparkSession, root: str, name: str, merge_schema: bool = False) -> DataFrame:
    """All partitions of ``<root>/<name>``; with ``merge_schema`` the union of all footers' columns.

    Without it the columns are those of one footer, and a column that only others have is silently missing.
    """
    return spark.read.option("mergeSchema", merge_schema).parquet(f"{root}/{name}")


def read_recursive(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Every matching file below ``folder``, whatever the folders between."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mergeSchema", True).parquet(folder)


def with_source_file(df: DataFrame, levels: int = 1) -> DataFrame:
    """Add the file each row is from and the folder above it (the partition, for ``levels`` 1)."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("_source_file"), F.element_at(F.split(path, "/"), -1 - levels).alias("_source_folder"))


def has_column(spark: SparkSession, folder: str, column: str) -> bool:
    """Whether a scan that doesn't merge schemas sees ``column``."""
    return column in spark.read.option("mergeSchema", False).parquet(folder).columns


def read_snapshot(spark: SparkSession, reader: DataFrame, run_date: str) -> DataFrame:
    """A whole snapshot of a relation as one partition, that of the run date; an empty one is an error."""
    return require_rows(reader, "the snapshot").withColumn("ingested_date", F.lit(run_date).cast("date"))


def read_jdbc(spark: SparkSession, url: str, relation: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A relation of a database; with a numeric ``key`` and its ``bounds`` it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", relation).option("fetchsize", 10_000)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def drain_topic(spark: SparkSession, servers: str, topic: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """What a topic holds now, from its earliest message on, decoded, with partition and offset; nothing is committed.

    All of it, unless ``limit`` caps it: then any that many messages, and the next read starts at the earliest again.
    """
    raw = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest").load()
    return decode_topic(raw.limit(limit) if limit else raw, schema)


def read_topic_files(spark: SparkSession, folder: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """The same from files of JSON lines (partition, offset, value), which stand in for a topic."""
    raw = spark.read.schema("partition int, offset long, value string").json(folder)
    return decode_topic(raw.limit(limit) if limit else raw, schema)


def decode_topic(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON values as typed columns plus _kafka_partition and _kafka_offset; a value that isn't JSON fails the read."""
    value = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return raw.select(value.alias("_v"), F.col("partition").cast("long").alias("_kafka_partition"), F.col("offset").cast("long").alias("_kafka_offset")).select("_v.*", "_kafka_partition", "_kafka_offset")


def per_partition(topic: DataFrame) -> DataFrame:
    """Messages per topic partition."""
    return topic.groupBy("_kafka_partition").agg(F.count("*").alias("messages"), F.max("_kafka_offset").alias("last_offset"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from constants."""
    return spark.createDataFrame(rows, schema)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(table, files, partitions, mb) of the parquet files below ``root``, from file listings only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path", "length")
    inner = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.regexp_extract(inner, r"/(\w+=[^/]+)/", 1)
    return files.groupBy(F.split(inner, "/")[0].alias("table")).agg(
        F.count("*").alias("files"), F.count_distinct(F.nullif(parts, F.lit(""))).alias("partitions"), F.round(F.sum("length") / 1048576, 2).alias("mb")
    )


def footer_schemas(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(columns, has_column, partitions, first, last): what the footers below ``folder`` say, grouped; no rows are read."""
    from collections.abc import Iterator

    import pyarrow as pa

    from tidemill.operators.layout import open_footer

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [open_footer(p).schema.to_arrow_schema().names for p in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([len(n) for n in names], pa.int32()), pa.array([column in n for n in names])], ["path", "columns", "has_column"])

    part = F.element_at(F.split("path", "/"), -2)
    return files.mapInArrow(run, "path string, columns int, has_column boolean").groupBy("columns", "has_column").agg(F.count_distinct(part).alias("partitions"), F.min(part).alias("first"), F.max(part).alias("last"))


def ingest(spark: SparkSession, spec: TableSpec, reader: DataFrame, run_date: str, at: Column | None = None) -> DataFrame:
    """Rows of one table for the raw layer, by the kind of its source; an unknown kind is an error.

    Files keep their own partition, a snapshot goes into that of the run date, messages into that of their event.
    """
    if spec.source == "files":
        rows = reader if "ingested_date" in reader.columns else reader.withColumn("ingested_date", F.to_date("ingested_at"))
    elif spec.source == "snapshot":
        rows = read_snapshot(spark, reader, run_date)
    elif spec.source == "topic":
        rows = reader.withColumn("ingested_date", F.to_date(F.col("event_time").try_cast("timestamp")))
    else:
        raise ValueError(f"no such kind of source: {spec.source}")
    return add_provenance(rows, spec.source, spec.name, at)
