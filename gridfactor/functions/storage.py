"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode (tests), and an error on a cluster, whose machines share none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A new folder's name, in scratch() if that is open."""
    return f"{_scratch[-1] if _scratch else shared_root(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Computed once, written, and read again: its lineage ends there."""
    return stored_at(df, new_folder(df.sparkSession))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erased(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Collect the driver's garbage: shuffle files and arrays that were sent to tasks go with what refers to them, and a loop may make many before that happens by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """While open, what is stored and checkpointed goes below one new folder, which is deleted at the end: write results before."""
    sc = spark.sparkContext
    root = shared_root(spark)
    before, folder = sc.getCheckpointDir() or root, new_folder(spark)
    _scratch.append(folder)
    sc.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        _scratch.pop()
        sc.setCheckpointDir(before)
        erased(spark, folder)
