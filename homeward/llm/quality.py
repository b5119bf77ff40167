"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio.

Multinomials over hash buckets, one of trusted documents and one of all documents, score every
document by log(trusted / raw). There are three kinds of n-grams, each with buckets of its own:
words, pairs of neighbouring words, and runs of three bytes (letters). A document's score is the
sum of the kinds' means over its n-grams, so its length does not matter. It is kept if it passes
the base rules and its score reaches the threshold.

Words (runs of letters and digits, or of signs) and pairs are many, and a sample of trusted
documents has seen few of them: their ratio is drawn towards 1 where the sample tells little.
Runs of three bytes are few, and what trusted text never has is evidence: both multinomials hold
a share of all buckets alike, the raw one a larger share, so text of letters that do not occur
together scores low, even where the corpus has nothing like it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import fresh, giving_back, slices
from homeward.llm.hashing import LOT, mixed, words

SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Continuation bytes of UTF-8, of which no character has one first.
CONTINUED = bytes(range(0x80, 0xC0))
#: 0: white space; 1: letters, digits and all of UTF-8's longer forms; 2: signs.
KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
#: Buckets of words, of pairs and of runs of three bytes.
BUCKETS = (1 << 15, 1 << 15, 1 << 16)
#: Words and pairs: how many more trusted ones a bucket counts as, spread as the raw ones are.
DRAWN = 5.0
#: Letters: the share of trusted and of raw text that falls on all buckets alike.
TRUSTED_SHARE, RAW_SHARE = 1e-4, 1e-2
#: Labelled rows that the trusted counts are made from, about; those of least hash.
TRUSTED_ROWS = 20_000
#: Set on the labelled documents of even id of the sf0.1 tables; see README for the odd ones.
THRESHOLD = -1.0
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def ngrams(texts: list[bytes], sizes: tuple[int, ...] = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The kind, and the text's number and the bucket of each n-gram, in lots that hold few at
    once, however long a text is; texts in lower case (A-Z)."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    place = lambda h, kind: (h % np.uint64(sizes[kind])).astype(np.int64)
    starts, found = words(data, KIND)
    for at in range(0, len(found), LOT):
        own = found[at : at + LOT + 1]
        of = np.searchsorted(ends, starts[at : at + LOT + 1], "right")
        yield 0, of[:LOT], place(own[:LOT], 0)
        same = of[1:] == of[:-1]
        yield 1, of[:-1][same], place(mixed(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])[same], 1)
    for at in range(0, len(data) - 2, LOT):
        signs = data[at : at + LOT + 2].astype(np.uint64)
        signs[KIND[data[at : at + LOT + 2]] == 0] = 32
        runs = mixed(signs[:-2] | signs[1:-1] << np.uint64(8) | signs[2:] << np.uint64(16))
        places = np.arange(at, at + len(runs))
        of = np.searchsorted(ends, places, "right") if len(ends) > 1 else np.zeros(len(runs), np.int64)
        whole = places + 3 < ends[of]  # a run ends before its text does
        yield 2, of[whole], place(runs[whole], 2)


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).translate(None, CONTINUED))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found, reach = Counter(windows), 0  # reach: the first word not yet counted
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> list[int]:
    """Ids of labelled rows of good quality that are not toxic; about ``most`` where there are more,
    chosen by hash."""
    good = labels.where("quality = 1 AND NOT toxic <=> 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    n = good.count()
    if n > most:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    return [r[0] for r in good.collect()]


def ratios(raw: np.ndarray, own: np.ndarray, letters: bool) -> np.ndarray:
    """log(trusted / raw) of each bucket of a kind, from its counts."""
    p = raw / max(raw.sum(), 1)
    if letters:
        q = own / max(own.sum(), 1)
        return np.log((1 - TRUSTED_SHARE) * q + TRUSTED_SHARE / len(p)) - np.log((1 - RAW_SHARE) * p + RAW_SHARE / len(p))
    return np.log((own + DRAWN) / (own.sum() * p + DRAWN))


def fit(docs: DataFrame, trusted: list[int], sizes: tuple[int, ...] = BUCKETS, key: str = "doc_id", text: str = "text") -> list[np.ndarray]:
    """The ratios of each kind, from all documents. With no trusted document: zeros."""
    good = np.array(sorted(trusted), np.int64)
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    firsts = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(firsts[-1], np.int64), np.zeros(firsts[-1], np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                keys = part.column("k")
                is_good = np.isin(keys.fill_null(0).to_numpy(), good) & keys.is_valid().to_numpy(zero_copy_only=False)
                for kind, of, found in ngrams([t or b"" for t in part.column("t").to_pylist()], sizes):
                    here = slice(firsts[kind], firsts[kind + 1])
                    raw[here] += np.bincount(found, minlength=sizes[kind])
                    own[here] += np.bincount(found[is_good[of]], minlength=sizes[kind])
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int32), raw[at], own[at])], ["b", "raw", "own"])

    # at most as many rows as there are buckets
    rows = src.mapInArrow(giving_back(run), "b int, raw bigint, own bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toArrow()
    sums = np.zeros((2, firsts[-1]))
    for i, name in enumerate(("raw", "own")):
        sums[i, rows.column("b").to_numpy()] = rows.column(name).to_numpy()
    if not sums[1].any():
        return [np.zeros(n) for n in sizes]
    return [ratios(sums[0, a:b], sums[1, a:b], i == 2) for i, (a, b) in enumerate(zip(firsts, firsts[1:], strict=False))]


def means(texts: list[bytes], ratio: list[np.ndarray]) -> np.ndarray:
    """The score of each text; 0 for a text without n-grams."""
    sums, n = np.zeros((3, len(texts))), np.zeros((3, len(texts)), np.int64)
    for kind, of, found in ngrams(texts, tuple(map(len, ratio))):
        sums[kind] += np.bincount(of, ratio[kind][found], len(texts))
        n[kind] += np.bincount(of, minlength=len(texts))
    return (sums / np.maximum(n, 1)).sum(axis=0)


def score(docs: DataFrame, ratio: list[np.ndarray], threshold: float = THRESHOLD, least_words: int = 50, repeat_percent: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``llr`` and ``kept``; all its rows and columns.

    A null text counts as empty: no words, llr 0, base_failed. Very long texts are read whole.
    Columns of ``docs`` with the names of the new ones are replaced. Repeated rows are each judged,
    and alike; null ids change nothing. Empty table: no rows.
    """
    made = [f.split()[0] for f in COUNTS.split(", ")] + ["llr"]
    own = [c for c in docs.columns if c.lower() not in {*made, "base_failed", "kept"}]
    body = fresh("_t", own)
    src = docs.select(*own, F.col(text).cast("string").cast("binary").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                texts = [t or b"" for t in part.column(body).to_pylist()]
                found = np.array([counts(t) for t in texts], np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(found[:, i]) for i in range(5)), pa.array(means(texts, ratio))], [*own, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    out = src.mapInArrow(giving_back(run), f"{kinds}, {COUNTS}, llr double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= F.lit(threshold)))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` with the ratio that ``fit`` learns from all of ``docs`` and the labels."""
    return score(docs, fit(docs, trusted_ids(labels)), threshold)
