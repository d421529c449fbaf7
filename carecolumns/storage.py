"""Tables in the folder that driver and executors share: lineage ends there, and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset and gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='carecolumns-')}")
    return context._jsc.sc().getCheckpointDir().get()


#: Shuffle files of a step are of no use once its rows are written: Spark deletes them then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> DataFrame:
    """df written as a table and read again."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and lost executors cost no recomputation.

    The table stays until release() or until the shared folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    out = write(df, path)
    out._cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, df._cut_path)
