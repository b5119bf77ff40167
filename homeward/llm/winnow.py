"""Winnowing fingerprints of documents, with built-in functions only.

A text's words (white space parts them) give one hash for each run of ``k`` neighbours; of every
``window`` runs in a row the least hash is chosen, the rightmost of equal ones. So two texts that
share ``k + window - 1`` words in a row share a fingerprint, and none shorter than ``k`` words
makes one. A chosen hash is kept with its place: 36 bits of hash above 28 bits that hold the place
counted downwards, so that the least number is also the rightmost of equal hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 8
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
WHITE = "[\\x20\\x09-\\x0D]+"
#: Consecutive ids that are put in order together.
RUN = 256


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with the chosen hashes of ``text`` as ``out``, an array of numbers.

    Texts of fewer than ``k`` words give one hash of all their words, texts without words none.
    """
    at, cols = f"_{out}", df.columns
    df = df.withColumn(at, F.filter(F.split(text, WHITE), lambda w: w != ""))
    df = df.withColumn(at, F.transform(at, lambda w: F.xxhash64(w)))
    gram = F.transform(F.sequence(F.lit(0), F.size(at) - k), lambda i: F.xxhash64(*(F.get(at, i + j) for j in range(k))))
    few = F.when(F.size(at) > 0, F.array(F.xxhash64(at))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(at, F.when(F.size(at) >= k, gram).otherwise(few))
    keep = F.lit(-(1 << PLACE_BITS)).cast("bigint")
    df = df.withColumn(at, F.transform(at, lambda h, i: h.bitwiseAND(keep) + (PLACES - i).cast("bigint")))
    width = 1
    while width < window:  # the least of 2, 4, 8 ... in a row
        step = min(width, window - width)
        # behind the end there is nothing, and the least of a number and nothing is the number
        df = df.withColumn(at, F.zip_with(at, F.slice(at, step + 1, F.size(at)), lambda a, b: F.least(a, b)))
        width += step
    full = F.greatest(F.size(at) - (window - 1), F.least(F.size(at), F.lit(1)))  # without cut-off windows
    return df.withColumn(at, F.slice(at, 1, full)).select(*cols, F.array_distinct(at).alias(out))


def hashes(chosen: str | Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two arrays of hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def shown(chosen: str) -> Column:
    """place:hash of each chosen hash, in the order of places."""
    mark = lambda x: F.concat_ws(":", (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("string"), F.lower(F.hex(F.shiftrightunsigned(x, PLACE_BITS))))
    return F.array_join(F.transform(chosen, mark), " ")


def followers(df: DataFrame, ids: DataFrame, key: str, carried: list[str], ties: list[str]) -> DataFrame:
    """``df`` with the columns ``carried`` of the next row, descending ``key``, as next_<column>.

    ``df`` must have ``_run`` (see ``runs``) and be dealt by it. Rows are put in order within runs
    of ids, and the last of each run gets the first row of the run that comes next; ``ids`` (the
    distinct ``_run``) tells which that is. The last row of all gets the first.
    """
    order = [F.desc_nulls_last(key), *ties]
    own = Window.partitionBy("_run").orderBy(*order)
    held = F.struct(*carried)
    rows = df.withColumn("_next", F.lead(held).over(own)).withColumn("_place", F.row_number().over(own))
    heads = rows.where("_place = 1").select(F.col("_run").alias("_head"), held.alias("_first"))
    heads = heads.join(ids.withColumnRenamed("_run", "_r"), F.col("_head") == F.col("_r")).select(F.col("_before").alias("_b"), "_first")
    rows = rows.join(heads, F.col("_run") == F.col("_b"), "left")
    rows = rows.withColumn("_next", F.coalesce("_next", "_first"))
    return rows.select(*df.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in carried))


def run_of(key: str) -> Column:
    """The run an id belongs to; null ids come after all others."""
    return F.coalesce(F.floor(F.col(key) / RUN).cast("bigint"), F.lit(-(1 << 62)))


def runs(docs: DataFrame, key: str, scratch) -> DataFrame:
    """(_run, _before): each run of ids and the run that comes before it, descending.

    The runs are dealt by range, and within a range each has its neighbour; of the ranges, of
    which there are as many as partitions, only the ends are put in one row of order.
    """
    found = docs.select(run_of(key).alias("_run")).distinct()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.written(found.repartitionByRange(parts, "_run").withColumn("_range", F.spark_partition_id()), "runs")
    ends = found.groupBy("_range").agg(F.min("_run").alias("_low"), F.max("_run").alias("_high"))
    all_ends = Window.partitionBy(F.lit(0)).orderBy("_low")
    above = F.coalesce(F.lead("_low").over(all_ends), F.first("_low").over(all_ends))
    ends = ends.withColumn("_above", above).select(F.col("_range").alias("_e"), "_above")
    own = Window.partitionBy("_range").orderBy("_run")
    found = found.withColumn("_before", F.lead("_run").over(own)).join(ends, F.col("_range") == F.col("_e"))
    # descending, the run before is the next larger one; before the largest comes the smallest
    return found.select("_run", F.coalesce("_before", "_above").alias("_before"))


def edited_fingerprints(docs: DataFrame, scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of the next document's and of the text with its second half
    replaced by the next document's beginning; columns as the query has them.

    A null text is an empty one; a single document is its own next one. Rows with one id follow
    each other in the order of their texts' hashes. Null ids come last. An empty table gives no
    rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), body.alias("text"))
    parts = runs(src, "doc_id", scratch)
    src = src.withColumn("_run", run_of("doc_id")).repartition("_run")
    src = with_fingerprint(src, "text", "fp").withColumn("tie", F.xxhash64("text"))
    rows = followers(src, parts, "doc_id", ["text", "fp"], ["tie", "text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "efp")
    rows = rows.withColumns({"a": hashes("fp"), "b": hashes("efp"), "c": hashes("next_fp")})
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown("fp").alias("fingerprint"),
        shown("efp").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
    )
