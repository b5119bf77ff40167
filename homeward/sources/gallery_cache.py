"""Galleries kept as Parquet with a manifest, galleries taken over from npz files, small JSON states.

All files are read and written through Spark, in whatever store the path names.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.operators import ingest

MANIFEST = "model_version string, preprocess_version string, cache_version int, dim int, gallery_size bigint, species array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def json_or(spark: SparkSession, path: str, default):
    """A JSON document, or ``default`` where there is none."""
    if not exists(spark, path):
        return default
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def save_json(spark: SparkSession, path: str, value) -> None:
    """One small document (a state, a manifest), in UTF-8 with an indent of two."""
    body = json.dumps(value, ensure_ascii=False, indent=2)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write(gallery: DataFrame, root: str, model: str, preprocess: str, version: int, dim: int) -> None:
    """The gallery by species, then its manifest: a cache without a manifest is not one."""
    gallery.write.mode("overwrite").partitionBy("species").parquet(f"{root}/features")
    kept = gallery.sparkSession.read.parquet(f"{root}/features")
    made = kept.agg(F.count("*").alias("gallery_size"), F.array_sort(F.collect_set("species")).alias("species"))
    made = made.select(F.lit(model).alias("model_version"), F.lit(preprocess).alias("preprocess_version"), F.lit(version).alias("cache_version"), F.lit(dim).alias("dim"), "gallery_size", "species")
    made.write.mode("overwrite").json(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def load(spark: SparkSession, root: str, model: str, preprocess: str, version: int, dim: int) -> DataFrame:
    """The cached gallery, if it was made by the same versions."""
    found = ingest.compatible(manifest(spark, root), model, preprocess, version, dim).first()
    if found is None:
        raise FileNotFoundError(f"no gallery cache under {root}")
    if not found["compatible"]:
        raise ValueError("the gallery cache was made by another model or preprocessing")
    return spark.read.parquet(f"{root}/features")


def for_search(gallery: DataFrame, species: str, model: str, preprocess: str, animals: bool = True, reports: bool = True) -> DataFrame:
    """The part of a stored gallery that a search needs; all conditions reach the scan."""
    own = gallery.where((F.col("species") == species) & (F.col("model_version") == model) & (F.col("preprocess_version") == preprocess))
    kinds = [k for k, on in (("SHELTER", animals), ("REPORT", reports)) if on]
    return own.where(F.col("candidate_type").isin(*kinds))


def build(records: DataFrame, spark: SparkSession, root: str, featurise, model: str, preprocess: str, version: int, dim: int) -> DataFrame:
    """``records`` with vectors: from a compatible cache where id, url and species agree, made by
    ``featurise`` (DataFrame to DataFrame with ``embedding``; rows it drops are skipped) elsewhere."""
    judged = ingest.compatible(manifest(spark, root), model, preprocess, version, dim).first()
    if judged is None or not judged["compatible"]:
        return featurise(records).withColumn("hit", F.lit(False))
    both = ingest.reuse(records, spark.read.parquet(f"{root}/features"))
    old = both.where("hit").withColumnRenamed("c_embedding", "embedding")
    new = featurise(both.where("NOT hit").drop("c_embedding", "hit")).withColumn("hit", F.lit(False))
    return old.unionByName(new, allowMissingColumns=True)


NPZ = "gallery_id string, record_id string, species string, embedding_full array<float>, embedding_crop array<float>, phash_full string, phash_crop string, detection_confidence float, blur float"
#: Arrays of an npz gallery, in the order of NPZ.
NPZ_ARRAYS = ["gallery_ids", "record_ids", "species", "embeddings_full", "embeddings_crop", "phashes_full", "phashes_crop", "detection_confidences", "blurs"]


def read_npz(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """The rows of npz galleries under ``path``, a task for each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with np.load(io.BytesIO(blob), allow_pickle=False) as f:
                    arrays = [f[k] for k in NPZ_ARRAYS]
                for at in range(0, len(arrays[0]), rows):
                    part = [x[at : at + rows] for x in arrays]
                    cols = [pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())) if x.ndim == 2 else pa.array(x.astype(np.float32)) if x.dtype.kind == "f" else pa.array(x.astype(str).tolist()) for x in part]
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in NPZ.split(", ")])

    return files.mapInArrow(run, NPZ)


def import_rows(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of an npz gallery with what the metadata knows (gallery_id, image_url, photo_index);
    ``ok`` tells which can be taken over: those with an url."""
    from homeward.functions import columns as fn

    m = meta.select(F.col("gallery_id").alias("m_id"), F.trim("image_url").alias("image_url"), F.col("photo_index").alias("m_index"))
    out = rows.join(m, F.col("gallery_id") == F.col("m_id"), "left")
    return out.withColumns({"photo_index": fn.photo_index(F.col("m_index"), F.col("gallery_id")), "ok": F.coalesce(F.col("image_url") != "", F.lit(False))}).drop("m_id", "m_index")
