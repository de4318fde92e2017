"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a checkpoint is deleted once nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tidemill", master: str | None = None, conf: dict[str, str] | None = None, event_log: str | None = None) -> SparkSession:
    """A session with UTC times, AQE, Arrow and per-partition overwrite; ``conf`` wins over the defaults.

    ``event_log`` names a shared folder for the log that a history server reads.
    """
    if event_log:
        conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log, "spark.eventLog.rolling.enabled": "true"} | (conf or {})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine is taken only where that is unset and the master is local, as in tests;
    on a cluster without the setting this raises rather than write where other machines cannot read.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tidemill-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; the rows survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the one that the cluster shares, deleted when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and columns are stored compressed and read one by one."""
    folder = shared_folder(df.sparkSession, name)
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder with all it holds, on whatever file system it is; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Partitions to use at least, so that all cores of the cluster have work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
