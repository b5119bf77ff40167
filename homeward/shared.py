"""The folder that all executors share, for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured (tests)."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="homeward-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def deleted(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


_folders: list[tuple] = []


def ended(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    if not _folders:
        atexit.register(_delete_folders)
    _folders.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))


def _delete_folders() -> None:
    while _folders:
        with contextlib.suppress(Exception):  # the JVM may have ended before; its folder is then left to whoever cleans the store
            deleted(*_folders.pop())


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is written now and goes when the driver ends.

    For what is read more than once and need not come out the same twice (ranges follow a sample)."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/homeward/{name}-{uuid.uuid4().hex}"
    ended(spark, path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
