"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and driver and executors are one process, as in tests."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="loomstead-"))
        system, at = file_system(spark, _own[0])
        system.deleteOnExit(at)
    return _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing.

    The table goes with unstage, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/loomstead-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path:
            system, at = file_system(table.sparkSession, path)
            system.delete(at, True)
            system.cancelDeleteOnExit(at)
