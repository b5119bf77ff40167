"""The queries of this folder: name -> (spark, sf_dir) -> DataFrame, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm import lm, packing, pii, quality, repeats, sharding, simhash, tokens, warc, winnow
from homeward.llm.common import Scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of the passages that op2 counts beside what it removes: a little under 50 words.
PASSAGE = 256


def op2_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(spark, table(spark, sf_dir, "documents"), passage=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes", (F.col("n_passages") > 0).alias("has_passage"))


#: Of the queries; a real run gets its own from whoever keeps secrets.
PII_KEY = "homeward public test key"


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(spark, table(spark, sf_dir, "documents"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "n_values")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"), Scratch(spark, "winnow"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    found = tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path, with_offsets=True, with_decoded=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_chars"),
    )


def op6_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(spark, docs, table(spark, sf_dir, "labels"))
    return out.drop("text")


def op7_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark, table(spark, sf_dir, "documents"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_deleted_interpolation, op2_bwt_repeats, op3_feistel_pseudonyms, op4_winnowing, op5_byte_bpe, op6_quality_llr, op7_simhash_gray, op8_minimax_shards, op9_arc_to_warc, op10_best_two_fit)}
ORACLE_SQL: dict[str, str] = {}
