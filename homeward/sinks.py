"""Results as files: CSV with all fields, JSON for a backend, lines for a console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeward.operators import match


def results_csv(ranked: DataFrame, path: str) -> None:
    """All fields, a header in each file; lists are comma-joined, bytes of UTF-8 marked as such."""
    flat = [F.array_join(f.name, ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in ranked.schema.fields]
    rows = ranked.select(flat)
    first = rows.columns[0]
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def backend_json(ranked: DataFrame, weights: DataFrame, model: str, version: str) -> DataFrame:
    """One JSON document for each request: versions, notice, weights and all results in order."""
    rows = match.backend(ranked)
    result = F.struct(*(c for c in rows.columns if c != "request_id"))
    lists = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(result)).alias("results"))
    every = weights.select("request_id", F.struct(*(F.col(f"w_{k}").alias(k) for k in ("image", "tags", "text", "location"))).alias("weights")).join(lists, "request_id", "left")
    notice = "Scores rank candidates and are not identity probabilities."
    doc = F.struct(F.lit(model).alias("modelVersion"), F.lit(version).alias("rerankVersion"), F.lit(notice).alias("scoreNotice"), "weights", F.coalesce("results", F.array().cast(lists.schema["results"].dataType)).alias("results"))
    return every.select("request_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))


def report(ranked: DataFrame) -> DataFrame:
    """The console's lines, in order within each request."""
    return match.reported(ranked)
