"""The stages one after the other, and what each must do."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from homeward.llm.common import SLICE_BYTES, Scratch, small_batches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["in"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.written(stage(spark, docs, SF), name)
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["in"].columns for n in names[:-1])
    assert "sequence_id" in stages[names[-1]].columns


def test_near_copies_leave_one(stages):
    kept = [(r.doc_id, r.text.lower().split()) for r in stages["simhash_near_dedup"].collect()]
    sets = [(i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) for i, w in kept]
    close = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= 0.8 * len(x | y)]
    assert not close
    gone = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    before = {i: t.lower().split() for i, t in gone.items()}
    have = {i for i, _ in kept}
    for i in set(before) - have:
        x = {tuple(before[i][j : j + 5]) for j in range(max(1, len(before[i]) - 4))}
        assert any(len(x & y) >= 0.8 * len(x | y) for _, y in sets)


def test_no_passage_stands_twice(stages):
    before, after = (stages[n].agg(F.count("*"), F.sum("n_chars")).first() for n in ("simhash_near_dedup", "suffix_array_dedup"))
    assert before[0] == after[0] and after[1] <= before[1]


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_no_personal_value_is_left(stages):
    """Cards and mail names of the documents stand nowhere in what is left."""
    before, after = ([r.text for r in stages[n].collect()] for n in ("suffix_array_dedup", "pii"))
    cards = {m for t in before for m in re.findall(r"(?<![0-9A-Za-z])\d{4}(?:[ -]?\d{4}){3}(?![0-9A-Za-z])", t) if luhn(re.sub(r"\D", "", m))}
    mails = {m for t in before for m in re.findall(r"\S+@mail\d\.example\.com", t)}
    assert cards and mails
    assert not any(v in t for v in cards | mails for t in after)


def test_text_that_no_other_has_stays(spark):
    """Characters at the edge of a passage and marks of the text's own."""
    shared = "une phrase partagée, répétée ailleurs — " * 8
    rows = [(1, "日本 \ufffd avant " + shared + "é après \ufffd"), (2, "autre début ü" + shared + "fin")]
    got = {r.doc_id: r.text for r in corpus_pipeline.passage_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got[1].startswith("日本 \ufffd avant") and got[1].endswith("é après \ufffd") and got[2].startswith("autre début ü") and got[2].endswith("fin")
    assert all("partagée" not in t for t in got.values())


def test_all_documents_are_packed(stages):
    assert {r.doc_id for r in stages["best_fit_packing"].select("doc_id").distinct().collect()} == {r.doc_id for r in stages["pii"].select("doc_id").collect()}


def test_odd_rows_and_none(spark, docs, rows):
    """Nulls, ties, long texts and columns named as the operators' own, stage by stage."""
    n = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert n[name].columns == docs.columns
    texts = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)
    assert {i for i, _ in texts(n["quality_rules"])} <= {str(i) for i, t in rows if len((t or "").split()) >= 50}
    assert len(texts(n["simhash_near_dedup"])) == len({i for i, _ in texts(n["simhash_near_dedup"])})
    cut = texts(n["suffix_array_dedup"])
    assert len(cut) == len(rows) and all(t is not None for _, t in cut)
    assert texts(n["pii"]) == sorted(((str(i), t) for i, t in rows), key=str)
    assert {str(r.doc_id) for r in n["best_fit_packing"].collect()} == {str(i) for i, _ in rows}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["best_fit_packing"].count()


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"])
def test_workers_get_small_batches(spark, docs, name):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    spark.conf.unset(BATCH)
    dict(corpus_pipeline.STAGES)[name](spark, docs.drop("n_chars"), SF)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789abcdef"), 256).alias("t"))  # 16 MB in one partition
    found = texts.mapInArrow(sizes, "size bigint, n bigint").collect()
    assert sum(r.n for r in found) == 4000 and max(r.size for r in found) <= 1.1 * SLICE_BYTES


def test_smaller_batches_stay(spark):
    try:
        for given, then in (("1m", "1m"), ("64m", str(SLICE_BYTES))):
            spark.conf.set(BATCH, given)
            small_batches(spark)
            assert spark.conf.get(BATCH) == then
    finally:
        spark.conf.unset(BATCH)
