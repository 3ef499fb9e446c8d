"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Removes an action's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written by this process that are still there, in order.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a new one if all runs on this machine; else an error."""
    path = spark.conf.get(KEY, None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share: intermediate tables are written there")
        path = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(KEY, path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(configuration).delete(at, True)
        if path in _written:
            _written.remove(path)


def drop_staged(spark: SparkSession) -> None:
    """Removes all intermediate tables of this process: for when the results that read them are written or no longer needed."""
    remove(spark, list(_written))


@contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Of the tables staged inside, only the last one stays."""
    before = set(_written)
    yield
    remove(spark, [p for p in _written if p not in before][:-1])
