"""Files in and out: caches, npz galleries, states, results; settings; map answers; metadata."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeward import queries as own
from homeward import sinks
from homeward.functions import columns as fn
from homeward.functions import metadata
from homeward.operators import areas, match, requests
from homeward.sources import gallery_cache, osm
from homeward.sources.settings import Galleries, Settings

SF = "/root/testdata/sf0.001"


def photos(spark, n=6):
    rows = [(f"g{i}", f"u{i}", "dog" if i % 2 else "cat", [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "gallery_id string, image_url string, species string, embedding array<float>")


def test_a_cache_is_read_by_its_own_version_only(spark, tmp_path):
    root = str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError):
        gallery_cache.load(spark, root, "m", "p", 1, 2)
    gallery_cache.write(photos(spark), root, "m", "p", 1, 2)
    made = gallery_cache.manifest(spark, root).first()
    assert (made.gallery_size, made.species, made.dim) == (6, ["cat", "dog"], 2)
    assert gallery_cache.load(spark, root, "m", "p", 1, 2).count() == 6
    with pytest.raises(ValueError):
        gallery_cache.load(spark, root, "other", "p", 1, 2)


def test_a_gallery_is_built_from_what_the_cache_has(spark, tmp_path):
    root = str(tmp_path / "cache")
    gallery_cache.write(photos(spark), root, "m", "p", 1, 2)
    now = photos(spark, 8).drop("embedding").withColumn("image_url", F.when(F.col("gallery_id") == "g2", "new").otherwise(F.col("image_url")))
    made = lambda df: df.where("gallery_id <> 'g7'").withColumn("embedding", F.array(F.lit(-1.0), F.lit(-1.0)).cast("array<float>"))
    got = {r.gallery_id: (r.hit, list(r.embedding)) for r in gallery_cache.build(now, spark, root, made, "m", "p", 1, 2).collect()}
    assert {k for k, (hit, _) in got.items() if hit} == {"g0", "g1", "g3", "g4", "g5"} and set(got) == {f"g{i}" for i in range(7)}
    assert got["g3"][1] == [3.0, 1.0] and got["g2"][1] == [-1.0, -1.0]
    assert not any(r.hit for r in gallery_cache.build(now, spark, root, made, "m2", "p", 1, 2).collect())


def test_npz_galleries(spark, tmp_path):
    n = 5
    arrays = dict(gallery_ids=[f"dog:{i}:{i}" for i in range(n)], record_ids=[str(i) for i in range(n)], species=["dog"] * n, embeddings_full=np.zeros((n, 3), "f4"), embeddings_crop=np.arange(3 * n, dtype="f4").reshape(n, 3), phashes_full=["0" * 16] * n, phashes_crop=[""] * n, detection_confidences=np.ones(n, "f4"), blurs=np.zeros(n, "f4"))
    np.savez_compressed(tmp_path / "gallery_features.npz", **{k: np.asarray(v) for k, v in arrays.items()})
    rows = gallery_cache.read_npz(spark, str(tmp_path), rows=2)
    assert {r.gallery_id: list(r.embedding_crop) for r in rows.collect()} == {f"dog:{i}:{i}": [3 * i, 3 * i + 1, 3 * i + 2] for i in range(n)}
    meta = spark.createDataFrame([("dog:0:0", " u "), ("dog:1:1", "  ")], "gallery_id string, image_url string").withColumn("photo_index", F.lit(None).cast("int"))
    got = {r.gallery_id: (r.ok, r.photo_index) for r in gallery_cache.import_rows(rows, meta).collect()}
    assert got["dog:0:0"] == (True, 0) and got["dog:1:1"] == (False, 1) and got["dog:4:4"] == (False, 4)


def test_json_states(spark, tmp_path):
    path = str(tmp_path / "state")
    assert gallery_cache.json_or(spark, path, {"at": None}) == {"at": None}
    gallery_cache.save_json(spark, path, {"at": "2024-01-01", "이름": [1]})
    assert gallery_cache.json_or(spark, path, {}) == {"at": "2024-01-01", "이름": [1]}


def test_settings():
    assert Settings.of({}) == Settings() and Settings.of({"HOMEWARD_TOP_K": "20", "HOMEWARD_TEXT_RERANK": "TRUE"}).weights["text"] == 0.05
    for bad in ({"HOMEWARD_MAP_TIMEOUT": "nan"}, {"HOMEWARD_MAP_TIMEOUT": "0"}, {"HOMEWARD_MAP_TIMEOUT": "x"}, {"HOMEWARD_TOP_K": "21"}, {"HOMEWARD_GALLERY_SOURCE": "disk"}):
        with pytest.raises(ValueError):
            Settings.of(bad)


def test_galleries_are_read_again_when_old(spark):
    now, reads = [0.0], []
    held = Galleries(Settings(gallery_seconds=10), lambda s: reads.append(s) or spark.range(1), lambda: now[0])
    for at in (0, 5, 10, 11, 12):
        now[0] = at
        held.get("dog")
    held.get("cat")
    assert reads == ["dog", "dog", "cat"]


def test_results_as_files(spark, tmp_path):
    rows = own._reranked(spark, SF).cache()
    sinks.results_csv(rows.select("rank", "request_id", "record_id", "matched"), str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv").glob("*.csv") for x in list(csv.DictReader(f.open(encoding="utf-8-sig")))]
    assert len(lines) == rows.count() and set(lines[0]) == {"rank", "request_id", "record_id", "matched"}
    weights = rows.groupBy("request_id").agg(*(F.max(f"w_{k}").alias(f"w_{k}") for k in ("image", "tags", "text", "location")))
    docs = {r.request_id: json.loads(r.payload) for r in sinks.backend_json(rows, weights, "m", "v").collect()}
    for i, doc in docs.items():
        assert list(doc) == ["modelVersion", "rerankVersion", "scoreNotice", "weights", "results"]
        assert [x["rank"] for x in doc["results"]] == list(range(1, len(doc["results"]) + 1)) and len(doc["results"]) == rows.where(F.col("request_id") == i).count()
        assert doc["results"][0]["scoreIsProbability"] is False and "textSimilarity" in doc["results"][0]
    assert sinks.report(rows).count() == rows.count()


def test_damaged_map_answers_fail_alone(spark):
    good = json.dumps({"elements": [{"lat": 1.5, "lon": 2, "tags": {"highway": "path"}}, {"center": {"lat": 3.0, "lon": 4.0}, "lat": 9.0, "lon": 9.0, "tags": {"shop": "x"}}, {"lat": 1.0, "tags": {"building": "yes"}}, {"lat": 1.0, "lon": 1.0}]})
    answers = spark.createDataFrame([(1, good), (2, "oops"), (3, '{"elements": []}'), (4, None)], "request_id long, payload string")
    found = osm.features(answers)
    assert sorted((r.request_id, r.latitude, r.longitude, tuple(r.kinds)) for r in found.collect()) == [(1, 1.5, 2.0, ("FOOTPATH",)), (1, 3.0, 4.0, ("COMMERCIAL",))]
    assert sorted(r.request_id for r in osm.failed(answers, found).collect()) == [2, 3, 4]


def test_requests_without_a_map_fall_back(spark):
    asked = spark.createDataFrame([(i, 37.5, 127.0, 500, "ALOOF", False) for i in (1, 2)], "request_id long, latitude double, longitude double, radius int, behavior string, limited boolean")
    features = spark.createDataFrame([(1, 37.5, 127.0, ["FOOTPATH"])], "request_id long, latitude double, longitude double, kinds array<string>")
    failed = spark.createDataFrame([(2,)], "request_id long")
    got = areas.recommend(asked, features, failed=failed).collect()
    assert {(r.request_id, r.fallback_used) for r in got} == {(1, False), (2, True)}
    assert [r.priority for r in got if r.request_id == 2] == [50, 40]
    cells = areas.with_strengths(areas.grid(areas.mapped(asked, failed)), features)
    both = areas.answered(asked, areas.select_both(cells), (1, 2), failed)
    said = {r.request_id: r for r in areas.compare_summary(both).collect()}
    assert said[2].fallback_used and said[2].summary == areas.LIMITED_COMPARISON
    assert not said[1].fallback_used and said[1].summary.startswith("추천 영역 2개 → 2개. 동일 순위 중심 이동 최대 ")
    one = both.where("request_id = 1").first()
    for v in (1, 2):
        assert all(sum(a.points) == a.priority for a in one[f"areas_{v}"])


def test_evidence_in_order():
    """Winners only, the largest contribution first, and a cautious sentence where there is little."""
    class Cell:
        behavior_kind, corridor_kind, behavior_environment, corridor = "GREEN_SPACE", "FOOTPATH", 1.0, 1.0

    area = {"values": {"distance": 1.5, "behavior_environment": 30.0, "corridor": 20.0, "accessibility": 10.0, "event_context": 5.0}, "kinds": ["FOOTPATH", "GREEN_SPACE", "ROAD"], "members": [Cell]}
    codes, text = areas.evidence(area, "FEARFUL")
    assert codes == ["BEHAVIOR_NEAR_GREEN_SPACE", "CORRIDOR_NEAR_FOOTPATH", "BARRIER_DISTANCE_CONSIDERED"]
    assert text.index("녹지") < text.index("보행로") < text.index("감점") and text.endswith("참고 정보입니다.")
    Cell.behavior_kind = Cell.corridor_kind = None
    codes, text = areas.evidence(area | {"kinds": []}, "FEARFUL")
    assert codes == ["DISTANCE_FROM_LAST_SEEN", "LIMITED_ENVIRONMENT_EVIDENCE"] and "제한적" in text


def test_future_events_are_rejected_and_alone(spark):
    rows = spark.createDataFrame([(1, "강아지", "소형", "2024-05-01", 9, 37.0, 127.0), (2, "강아지", "소형", "2024-05-02", 13, 37.0, 127.0), (3, "강아지", "소형", "2024-05-02", None, 37.0, 127.0), (4, "강아지", None, None, 30, None, 200.0)], "report_id long, species string, size string, d string, event_hour int, latitude double, longitude double")
    p = "named_struct('activityLevel', 'LOW', 'strangerResponse', 'NEUTRAL', 'noiseSensitivity', 'LOW', 'chaseTendency', 'LOW', 'mobility', 'NORMAL', 'escapeCause', CAST(NULL AS STRING))"
    rows = rows.withColumns({"event_date": F.to_date("d"), "profile": F.expr(p)})
    now = F.make_timestamp(F.lit(2024), F.lit(5), F.lit(2), F.lit(11), F.lit(0), F.lit(0), F.lit("Asia/Seoul"))
    judged = requests.judged(rows, now)
    assert {r.report_id: list(r.problems) for r in judged.collect()} == {1: [], 2: ["future"], 3: [], 4: ["size", "eventDate", "eventHour", "latitude", "longitude"]}
    got = {r.report_id: (r.hours, r.from_now) for r in requests.valid(judged).collect()}
    assert got == {1: (26.0, False), 3: (0.0, True)} and requests.rejected(judged).count() == 2


def test_text_is_brought_to_nfkc(spark):
    df = spark.createDataFrame([("ＡＢ①", ), (None, )], "t string")
    assert [r[0] for r in df.select(metadata.nfkc("t")).collect()] == ["AB1", None]


def test_metadata_of_any_shape(spark):
    texts = ["{}", "no json", None, "[1, 2]", '{"sex": ["수컷", " ", "암"], "colors": "", "color": "흰색 및 검정", "lat": "x", "lng": 1e400, "location": [1], "memo": 5}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, meta string")
    got = {r.i: r for r in metadata.normalized(df, "meta").collect()}
    for i in range(4):
        assert (got[i].report_type, list(got[i].sex), got[i].latitude, got[i].metadata_text) == ("LOST", [], None, "")
    assert (list(got[4].sex), list(got[4].colors), got[4].latitude, got[4].longitude, got[4].metadata_text) == (["male", "female"], ["white", "black"], None, None, "성별 male female; 색상 white black; 5")


def test_only_the_last_keyword_of_a_category_is_shown(spark):
    asked = spark.sql("SELECT 1 AS request_id, array(named_struct('category', 'a', 'keyword', 'x'), named_struct('category', 'a', 'keyword', 'y')) AS features")
    got = match.mock(asked).orderBy("rank").collect()
    assert [r.matchedTags for r in got] == [{"a": "y"}, None, None] and [r.rank for r in got] == [1, 2, 3]


def test_spaces_are_trimmed_whatever_the_place(spark):
    df = spark.createDataFrame([(["a0", "b1", " c "],)], "l array<string>").select(fn.split_tags(F.array_join("l", ","), fn.tag_names(), F.lit(False)).alias("t"))
    assert list(df.first().t) == ["a0", "b1", "c"]


def test_now_is_utc(spark):
    from datetime import datetime, timezone

    got = datetime.fromisoformat(spark.range(1).select(fn.utc_now()).first()[0])
    assert abs((datetime.now(timezone.utc) - got).total_seconds()) < 60
