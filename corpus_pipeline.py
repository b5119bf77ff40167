"""Raw documents to training sequences: five stages, each one operator over all that is left.

Every stage is written as Parquet and read again as the next one's input, so a lost executor costs
tasks of one stage, and each stage plans on the sizes it really has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm import packing, pii, quality, repeats, simhash
from homeward.llm.common import Scratch, small_batches, table
from homeward.llm.queries import PII_KEY, vocabulary

#: Bytes of a passage that may stand only once; 50 words have more.
PASSAGE_BYTES = 200


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    cols = {"n_chars": F.char_length("text").cast("bigint")} if "n_chars" in like.columns else {}
    return docs.withColumns(cols).select(like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep.

    Null, empty and blank texts have no words and go. Rows that are repeated are judged alike; null
    ids and labels without a document change nothing. Without labels the ratio is 0 and the base
    rules decide. Empty table: no rows. All columns stay, also those named like the operator's."""
    small_batches(spark)
    return quality.judge(spark, docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    The least id stays; rows without an id are dropped only as repeats of each other. Null texts count
    as empty, and texts without words as copies. Empty table: no rows. All columns stay."""
    small_batches(spark)
    return simhash.one_of_each(spark, docs).select(docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in more than one place.

    All copies of a passage go, whole characters only; every other character stays. A null text
    becomes an empty one. Repeated rows are copies of each other and lose their whole text, from the
    passage's length on. Empty table: no rows. All columns stay."""
    small_batches(spark)
    safe = {c: f"_carry{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = repeats.without_repeats(spark, docs.withColumnsRenamed(safe), PASSAGE_BYTES, carry=tuple(safe.values()), characters=True)
    found = found.select("doc_id", F.decode("kept", "UTF-8").alias("text"), *(F.col(x).alias(c) for c, x in safe.items()))
    return _with_text(found, docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data. Null and empty texts stay as they are,
    repeated rows change alike. Empty table: no rows. All columns stay."""
    return _with_text(pii.pseudonymise(docs, PII_KEY), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they stand in sequences of 1024 tokens. A null or empty
    text is one piece of one token; repeated rows and rows without an id are each packed. Empty
    table: no rows."""
    small_batches(spark)
    return packing.pack(spark, docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("pii", pseudonyms),
    ("best_fit_packing", sequences),
]

#: Fingerprints, transforms and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
