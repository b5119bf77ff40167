"""Matching: values worked out by hand, and the paths a small table does not take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeward import config as C
from homeward.functions import columns as fn
from homeward.operators import ingest, match
from homeward.streaming import sync


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("서울특별시 강남구 역삼동", "서울특별시 강남구 역삼동", 0.9),
        ("서울특별시 강남구", "서울특별시 강남구 삼성동", 0.7),
        ("서울특별시 중구", "부산광역시 중구", 0.1),
        ("서울특별시강남구역삼동", "서울특별시 강남구 역삼동", 0.9),
        ("", "서울특별시", None),
        ("101동", "서울특별시", None),
    ],
)
def test_addresses(spark, a, b, score):
    assert one(spark, fn.address_similarity(F.lit(a), F.lit(b))) == score


@pytest.mark.parametrize(("days", "score"), [(-9, 0.05), (-1, 0.5), (0, 1.0), (3, 1.0), (4, 0.9), (30, 0.75), (90, 0.55), (180, 0.35), (181, 0.2)])
def test_day_scores(spark, days, score):
    assert one(spark, fn.banded(F.lit(days), C.DAY_SCORES)) == score


def test_spatiotemporal_mix(spark):
    assert one(spark, fn.spatiotemporal(F.lit(0.7), F.lit(1.0))) == pytest.approx(0.805)
    assert one(spark, fn.spatiotemporal(F.lit(None).cast("double"), F.lit(1.0))) == 1.0


@pytest.mark.parametrize(("text", "tags"), [("흰색, 수컷", ["white", "male"]), ("검정/블랙", ["black"]), ("미상", []), (None, []), ("삼색 및 단모", ["tricolor", "short_coat"])])
def test_tags(spark, text, tags):
    assert one(spark, fn.split_tags(F.lit(text).cast("string"), fn.tag_names(), F.lit(False))) == tags


def test_sex_by_its_first_sign(spark):
    assert one(spark, fn.split_tags(F.lit("수컷추정"), fn.tag_names(), F.lit(True))) == ["male"]


def test_hash_distance(spark):
    assert one(spark, fn.hamming(fn.phash_bits(F.lit("ffffffffffffffff")), fn.phash_bits(F.lit("0000000000000000")))) == 64
    assert one(spark, fn.phash_bits(F.lit("aaa"))) is None


@pytest.mark.parametrize(("hours", "factor"), [(6.0, 0.6), (6.01, 1.0), (24.0, 1.0), (24.01, 1.4), (72.0, 1.4), (72.01, 1.8)])
def test_hour_factors(spark, hours, factor):
    assert one(spark, fn.banded(F.lit(hours), C.HOUR_FACTORS)) == factor


def gallery(spark):
    rows = [(i, f"dog:{i // 2}:{i % 2}", str(i // 2), "SHELTER", None, "dog", [float(i % 3), 1.0], "ffffffffffffffff" if i == 5 else "0123456789abcdef", None) for i in range(8)]
    return spark.createDataFrame(rows, "ordinal long, gallery_id string, record_id string, candidate_type string, candidate_report_id long, species string, embedding array<float>, phash_full string, phash_crop string")


def asked(spark):
    q = spark.createDataFrame([(1, 9, "dog", [1.0, 0.0], "fffffffffffffffe"), (2, 9, "cat", [1.0, 0.0], None)], "request_id long, report_id long, species string, embedding array<float>, h string")
    return q.withColumn("phashes", F.array_compact(F.array(fn.phash_bits(F.col("h"))))).drop("h")


def test_near_duplicates_come_first(spark):
    got = match.search(asked(spark), gallery(spark), 10).orderBy("image_rank").collect()
    assert [r.gallery_id for r in got][0] == "dog:2:1" and got[0].near_duplicate and got[0].phash_distance == 1
    assert len(got) == 4  # one photo for each record


def test_ties_go_by_the_order_of_scanning(spark):
    got = match.search(asked(spark), gallery(spark).withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>")).where("ordinal <> 5"), 10).orderBy("image_rank")
    assert [r.ordinal for r in got.collect()] == [0, 2, 4, 6]


@pytest.mark.parametrize("parts", [(1, 1), (3, 1), (2, 2)])
def test_blocks_find_what_pairs_find(spark, parts):
    """Block products against pairs on the JVM, in one block and in several."""
    pairs = match.without_own(match.scored(asked(spark), gallery(spark)))
    cols = ["request_id", "gallery_id", "image_rank", "phash_distance", "near_duplicate"]
    every = {tuple(r) for r in match.top(match.best_per_record(pairs), 3, "image_rank").select(cols).collect()}
    assert {tuple(r) for r in match.nearest(asked(spark), gallery(spark), 3, parts=parts).select(cols).collect()} == every
    photos = {tuple(r) for r in match.top(pairs, 3, "image_rank").select(cols).collect()}
    assert {tuple(r) for r in match.nearest(asked(spark), gallery(spark), 3, per_record=False, parts=parts).select(cols).collect()} == photos


def test_random_blocks(spark):
    rnd = np.random.default_rng(4)
    hexed = lambda: f"{int(rnd.integers(0, 1 << 63)):016x}"
    hashes = [hexed() for _ in range(5)]
    rows = [(i, f"g{i}", str(i // 2), "REPORT" if i % 3 else "SHELTER", i // 2 if i % 3 else None, "dog", rnd.normal(size=3).tolist(), hashes[i % 5] if i % 4 else None, hexed()) for i in range(60)]
    gal = spark.createDataFrame(rows, "ordinal long, gallery_id string, record_id string, candidate_type string, candidate_report_id long, species string, embedding array<float>, phash_full string, phash_crop string")
    q = spark.createDataFrame([(i, i * 3, "dog", rnd.normal(size=3).tolist(), hashes[i]) for i in range(5)], "request_id long, report_id long, species string, embedding array<float>, h string")
    q = q.withColumn("phashes", F.array_compact(F.array(fn.phash_bits(F.col("h"))))).drop("h")
    cols = ["request_id", "gallery_id", "image_rank", "phash_distance"]
    expected = {tuple(r) for r in match.top(match.best_per_record(match.without_own(match.scored(q, gal))), 7, "image_rank").select(cols).collect()}
    assert len(expected) == 35 and {tuple(r) for r in match.nearest(q, gal, 7, parts=(2, 2)).select(cols).collect()} == expected


def test_own_photos_are_left_out(spark):
    gal = gallery(spark).withColumns({"candidate_type": F.lit("REPORT"), "candidate_report_id": F.when(F.col("ordinal") == 5, 9)})
    got = match.search(asked(spark), gal, 10).collect()
    assert "dog:2:1" not in {r.gallery_id for r in got} and not any(r.near_duplicate for r in got)


def test_many_queries_are_spread(spark, monkeypatch):
    cols = ["request_id", "gallery_id", "phash_distance"]
    before = {tuple(r) for r in match.scored(asked(spark), gallery(spark)).select(cols).collect()}
    monkeypatch.setattr(match, "HELD_BYTES", 0)
    assert {tuple(r) for r in match.scored(asked(spark), gallery(spark)).select(cols).collect()} == before


def test_decisions(spark):
    got = {r.request_id: r.decision for r in match.decision(asked(spark), match.search(asked(spark), gallery(spark), 1), "image_rank").collect()}
    assert got == {1: "NEAR_DUPLICATE_CANDIDATE", 2: "NO_GALLERY"}
    far = match.search(asked(spark).withColumn("phashes", F.array().cast("array<bigint>")), gallery(spark), 1)
    assert [r.decision for r in match.decision(asked(spark), far, "image_rank").where("request_id = 1").collect()] == ["RANKED_CANDIDATES_NEED_HUMAN_REVIEW"]


def test_a_missing_signal_is_no_penalty(spark):
    pool = spark.createDataFrame([(1, "a", 0.8, None, 0.0, None), (1, "b", 0.8, 1.0, 0.5, 0.9)], "request_id long, record_id string, visual double, tag_score double, tag_coverage double, st_score double")
    pool = pool.withColumns({"has_tags": F.lit(True), "has_text": F.lit(True), "has_place": F.lit(True), "text_score": F.lit(None).cast("double"), "near_duplicate": F.lit(False), "rank_hash": F.lit(-65), "image_rank": F.lit(1)})
    got = {r.record_id: r for r in match.rerank(pool, 5).collect()}
    assert got["a"].ranking == pytest.approx(0.9) and got["a"].w_text == 0
    assert got["b"].ranking == pytest.approx(0.75 * 0.9 + 0.15 * 0.95 + 0.1 * 0.9)


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    src, sink, dead, state = (str(tmp_path / x) for x in ("src", "sink", "dead", "state"))
    schema = "id long, url string, updated_at long"
    usable = lambda df: df.withColumn("ok", F.col("url").isNotNull())
    spark.createDataFrame([(1, "a", 1), (2, None, 2)], schema).write.mode("append").parquet(src)
    sync.run(spark, src, spark.read.parquet(src).schema, sink, dead, state, usable)
    spark.createDataFrame([(1, "b", 5), (3, "c", 4)], schema).write.mode("append").parquet(src)
    sync.run(spark, src, spark.read.parquet(src).schema, sink, dead, state, usable)
    assert {(r.id, r.url) for r in sync.table(spark, sink, ["id"], "updated_at").collect()} == {(1, "b"), (3, "c")}
    assert [r.id for r in spark.read.parquet(dead).collect()] == [2]
    assert sync.watermark(spark, sink, "updated_at") == 5
    sync.compacted(spark, sink, ["id"], "updated_at", str(tmp_path / "one"))
    assert sync.table(spark, str(tmp_path / "one"), ["id"], "updated_at").count() == 2


def test_batches_and_summary(spark):
    for each in (20, 20_000):
        got = {r.id: r.batch for r in ingest.batches(spark.range(130), "id", 7, each).collect()}
        assert got == {i: i // 7 for i in range(130)}
    assert ingest.summary(spark.range(5), F.col("id") > 1).first().asDict() == {"seen": 5, "upserted": 3, "skipped": 2}


def test_batches_of_more_rows_than_ranges_are_sampled_from(spark):
    rows = spark.range(40_000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS role", "sha1(CAST(id AS STRING)) AS text").distinct()
    got = ingest.batches(rows.selectExpr("*", "struct(role, text) AS k"), "k", 32, 2_000).orderBy("role", "text").collect()
    assert len(got) == 40_000 and [r.batch for r in got] == [i // 32 for i in range(40_000)]
