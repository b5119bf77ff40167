"""Keeping embeddings up to date: reuse, gaps, batches, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeward.shared import held

#: Ranges of a table at most, whose counts one task adds up.
RANGES = 1 << 17


def reuse(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records with what the cache has for the same id, url and species; ``hit`` tells which."""
    c = cache.select(F.col("gallery_id").alias("c_id"), F.col("image_url").alias("c_url"), F.col("species").alias("c_species"), F.col("embedding").alias("c_embedding"))
    same = (F.col("gallery_id") == F.col("c_id")) & (F.col("image_url") == F.col("c_url")) & (F.col("species") == F.col("c_species"))
    return records.join(c, same, "left").withColumn("hit", F.col("c_id").isNotNull()).drop("c_id", "c_url", "c_species")


def since(rows: DataFrame, column: str, watermark) -> DataFrame:
    """Rows after the watermark; all of them without one."""
    return rows if watermark is None else rows.where(F.col(column) > F.lit(watermark))


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def photos(animals: DataFrame, urls: str = "photo_urls", most: int = 3) -> DataFrame:
    """One row for each of the first urls, with the id of its photo; blank urls are skipped
    after they are counted."""
    rows = animals.select("*", F.posexplode(F.slice(urls, 1, most)).alias("photo", "url"))
    return rows.where(F.trim("url") != "").withColumn("gallery_id", F.concat_ws(":", "species", "record_id", F.col("photo").cast("string")))


def batches(rows: DataFrame, key: str, size: int, each: int = 20_000) -> DataFrame:
    """``rows`` with ``batch``: slices of ``size`` in the order of ``key``, as one sequence.

    Rows are dealt by ranges of the key; where a range begins follows from the counts of those
    before it (one row a range, RANGES at most), so no task orders the table. Ranges follow a sample
    that another run of the same plan does not repeat, so rows and counts are read from one table."""
    parts = max(1, min(RANGES, -(-rows.count() // each)))
    dealt = rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    dealt = held(dealt, "batches")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = dealt.join(starts, F.col("_part") == F.col("_p"))
    return out.withColumn("batch", F.floor((F.col("_start") + F.col("_at")) / size).cast("long")).drop("_part", "_at", "_p", "_start")


def text_batches(rows: DataFrame, role: str, text: str, size: int = 32) -> DataFrame:
    """The different texts of each role once, in batches of ``size``: what a text encoder is given."""
    return batches(rows.select(role, F.trim(text).alias(text)).where(F.col(text) != "").distinct().withColumn("_k", F.struct(role, text)), "_k", size).drop("_k")


def summary(rows: DataFrame, ok: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("seen"), F.sum(ok.cast("int")).alias("upserted"), F.sum((~ok).cast("int")).alias("skipped"))


def compatible(manifest: DataFrame, model: str, preprocess: str, version: int, dim: int) -> DataFrame:
    """Whether a cache's manifest agrees in all four."""
    same = (F.col("model_version") == model) & (F.col("preprocess_version") == preprocess) & (F.col("cache_version") == version) & (F.col("dim") == dim)
    return manifest.withColumn("compatible", F.coalesce(same, F.lit(False)))


def best_detection(boxes: DataFrame, key: str) -> DataFrame:
    """Of each photo's boxes (confidence, area, image_area, place) the one of the largest confidence
    times the root of its share; the first of equals. Photos without boxes have no row."""
    rank = F.struct((F.col("confidence") * F.sqrt(F.greatest(F.col("area") / F.col("image_area"), F.lit(0.0)))).alias("r"), (-F.col("place")).alias("o"))
    rest = [c for c in boxes.columns if c != key]
    return boxes.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(key, "b.*", (F.col("b.area") / F.col("b.image_area")).alias("share"))


def sharpness(gray: Column, width: int) -> Column:
    """Variance of the Laplacian (four neighbours) of a gray image, an array of rows of ``width``."""
    at = lambda i: F.get(gray, i)
    n = F.size(gray)
    inner = F.filter(F.sequence(F.lit(width + 1), n - width - 2), lambda i: (i % width > 0) & (i % width < width - 1))
    values = F.transform(inner, lambda i: -4.0 * at(i) + at(i - width) + at(i + width) + at(i - 1) + at(i + 1))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return mean(F.transform(values, lambda x: x * x)) - F.pow(mean(values), F.lit(2.0))


def sync_plan(candidates: DataFrame, done: DataFrame | None, mark, missing_only: bool, updated: str, key: str) -> DataFrame:
    """Candidates of a sync run: those without vectors, or those changed since the watermark."""
    if missing_only:
        return candidates if done is None else missing(candidates, done, key)
    return since(candidates, updated, mark)


def sync_summary(candidates: DataFrame, photos: DataFrame, ok: Column, size: int, dry_run: bool = False) -> DataFrame:
    """Counters of a sync run, one row. A dry run counts the photos that there are and does nothing.

    ``photos`` has a row for each photo of the candidates."""
    n = candidates.agg(F.count("*").alias("candidates"))
    if dry_run:
        made = candidates.agg(F.coalesce(F.sum(F.size("photo_urls")), F.lit(0)).alias("prepared"))
        made = made.withColumns({"skipped": F.lit(0).cast("long"), "upserted": F.lit(0).cast("long"), "batches": F.lit(0).cast("long")})
    else:
        good = F.count(F.when(ok, 1))
        made = photos.agg(good.alias("prepared"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("skipped")).withColumns({"upserted": F.col("prepared"), "batches": F.ceil(F.col("prepared") / size)})
    return n.crossJoin(made).withColumn("dry_run", F.lit(dry_run))  # one row with one row


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row with the largest version: what an upsert leaves."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")
