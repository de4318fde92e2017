"""Physical layout: compaction, clustering along a space-filling curve, buckets, and probes of what they save."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import delete_folder, parallelism

TARGET_MB = 128
#: Bits of each column in the curve's key: a column is cut in 2**RANK_BITS even parts.
RANK_BITS = 6
#: Rows of a text column that its bounds are drawn from, at most.
SAMPLE = 16_384


def compact(spark: SparkSession, source: str, target: str, target_mb: int = TARGET_MB) -> int:
    """Rewrite a table of small files into files of about ``target_mb``; the number of files.

    ``target`` is another folder: readers keep the old one until they are pointed at it; then ``vacuum`` it.
    """
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(source).select(F.sum("length")).first()[0] or 0
    files = max(1, -(-int(size) // (target_mb << 20)))
    spark.read.parquet(source).repartition(files).write.mode("overwrite").parquet(target)
    return len(spark.read.parquet(target).inputFiles())


def interleave(ranks: list[Column], bits: int = RANK_BITS) -> Column:
    """One key of the bits of all ranks in turn, the highest first (a Z-order curve)."""
    out, at = F.lit(0).cast("bigint"), bits * len(ranks) - 1
    for bit in range(bits - 1, -1, -1):
        for r in ranks:
            out = out.bitwiseOR(F.shiftleft(F.shiftright(r.cast("bigint"), bit).bitwiseAND(F.lit(1)), at))
            at -= 1
    return out


def rank_bounds(df: DataFrame, column: str, bits: int = RANK_BITS) -> list:
    """At most 2**bits - 1 values that cut the rows in even parts: a sample or a sketch of fixed size comes to the driver.

    A value with more rows than a part is one bound, so a city with half of all rows takes half of the parts.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("string", "date", "timestamp", "timestamp_ntz"):
        # a bounded sample of rows, drawn by hash
        drawn = df.where(F.col(column).isNotNull()).select(column, F.xxhash64(*df.columns).alias("_h")).orderBy("_h", column).limit(SAMPLE)
        vals = sorted(r[0] for r in drawn.collect())
        return sorted({vals[k * len(vals) >> bits] for k in range(1, 1 << bits)}) if vals else []
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(F.percentile_approx(column, shares, 10_000)).first()[0]
    return sorted(set(found or []))


def rank_of(value: Column, bounds: list) -> Column:
    """How many of the rising bounds are at or below the value: a tree of comparisons, six deep for 63 bounds."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def zorder(df: DataFrame, columns: list[str], files: int | None = None, bits: int = RANK_BITS) -> DataFrame:
    """``df`` clustered by several columns at once: sorted along a Z-order curve of their ranks, in even ranges.

    Each value is ranked among bounds that cut the column in even parts; nulls come first. Readers then skip
    row groups by the least and greatest values that their footers hold, whichever of the columns they filter.
    """
    ranks = []
    for c in columns:
        ranks.append(rank_of(F.col(c), rank_bounds(df, c, bits)))
    keyed = df.withColumn("_z", interleave(ranks, bits))
    return keyed.repartitionByRange(files or parallelism(df.sparkSession), "_z").sortWithinPartitions("_z").drop("_z")


def probe(df: DataFrame, condition: Column, amount: str | None = None) -> DataFrame:
    """(rows, total): how many rows meet the condition, and the sum of ``amount`` over them."""
    total = F.coalesce(F.sum(amount), F.lit(0)) if amount else F.lit(None).cast("bigint")
    return df.where(condition).agg(F.count("*").alias("rows"), total.alias("total"))


def vacuum(spark: SparkSession, folder: str) -> bool:
    """Delete the files of a table that another has replaced; whether there were any."""
    return delete_folder(spark, folder)


def footers(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """(path, row_group, rows, bounds) of the parquet files below ``folder``: the least and greatest value of each column as text.

    Only footers are read, by the tasks; ``bounds`` maps a column to its two values, where the footer has them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch["path"].to_pylist():
                meta = open_footer(path)
                at = {meta.schema.column(i).name: i for i in range(len(meta.schema))}
                for g in range(meta.num_row_groups):
                    held = {c: meta.row_group(g).column(at[c]).statistics for c in columns if c in at}
                    out.append((path, g, meta.row_group(g).num_rows, [(c, {"lo": str(s.min), "hi": str(s.max)}) for c, s in held.items() if s is not None and s.has_min_max]))
            names = ["path", "row_group", "rows", "bounds"]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.struct([("lo", pa.string()), ("hi", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return files.mapInArrow(run, "path string, row_group int, rows bigint, bounds map<string, struct<lo: string, hi: string>>")


def open_footer(path: str) -> pq.FileMetaData:
    """The footer of a parquet file, by its address on whatever file system it is."""
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    with system.open_input_file(inner) as f:
        return pq.read_metadata(f)


def skipping(spark: SparkSession, folder: str, wanted: dict[str, str]) -> DataFrame:
    """(files, files_read, groups, groups_read, rows_read): what a reader of rows with these text values can't skip."""
    hit = F.lit(True)
    for c, v in wanted.items():
        b = F.col("bounds")[c]
        hit = hit & F.coalesce((b["lo"] <= v) & (b["hi"] >= v), F.lit(True))
    found = footers(spark, folder, list(wanted)).withColumn("_hit", hit)
    return found.agg(
        F.count_distinct("path").alias("files"), F.count_distinct(F.when(F.col("_hit"), F.col("path"))).alias("files_read"), F.count("*").alias("groups"), F.count_if("_hit").alias("groups_read"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("rows"))), F.lit(0)).alias("rows_read"),
    )


def explain_timed(df: DataFrame) -> tuple[str, float, int]:
    """(formatted plan, seconds, rows) of running ``df`` once."""
    began = time.perf_counter()
    rows = df.count()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), time.perf_counter() - began, rows


def analyze(spark: SparkSession, table: str, columns: list[str]) -> None:
    """Statistics of a managed table and some columns, for the optimiser."""
    spark.sql(f"analyze table {table} compute statistics for columns {', '.join(columns)}")


def refresh(spark: SparkSession, table: str) -> None:
    """Forget what is cached of a table's files."""
    spark.catalog.refreshTable(table)


class timed:
    """Context manager that keeps the wall-clock seconds of its block in ``seconds``."""

    def __init__(self, label: str = "") -> None:
        self.label, self.seconds = label, 0.0

    def __enter__(self) -> timed:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.perf_counter() - self._began
