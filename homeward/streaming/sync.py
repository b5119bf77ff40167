"""Incremental embedding as a stream that ends: new files in, batches upserted, failures kept.

A checkpoint holds what has been read, so a run takes up where the last one ended. The watermark
is the largest ``updated_at`` that was read, not the time of the run, and rows that could not be
used go to a table of their own: neither an update during a run nor a failure is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.operators import ingest


def upserted(current: DataFrame | None, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of both, of each key the one with the largest version."""
    return ingest.newest(new if current is None else current.unionByName(new, allowMissingColumns=True), keys, version)


def run(spark: SparkSession, source: str, schema, sink: str, dead: str, state: str, usable: Callable[[DataFrame], DataFrame]) -> None:
    """Reads what is new under ``source``; ``usable`` adds a boolean column ``ok``.

    Every batch is one folder of the sink, written anew if the batch is, so a batch that runs
    twice leaves what one run leaves."""

    def write(batch: DataFrame, number: int) -> None:
        judged = usable(batch).persist()
        judged.where("ok").drop("ok").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        judged.where("NOT coalesce(ok, false)").drop("ok").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        judged.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, sink: str, keys: list[str], version: str) -> DataFrame:
    """What the batches amount to."""
    return upserted(None, spark.read.parquet(sink).drop("batch"), keys, version)


def watermark(spark: SparkSession, sink: str, version: str):
    return spark.read.parquet(sink).agg(F.max(version)).first()[0]


def compacted(spark: SparkSession, sink: str, keys: list[str], version: str, to: str) -> None:
    """What the batches amount to, written as one batch of another sink: a long history is read
    once, and later runs go on from the new sink."""
    table(spark, sink, keys, version).write.mode("overwrite").parquet(f"{to}/batch=0")
