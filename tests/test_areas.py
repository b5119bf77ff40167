"""Search areas: the known scenarios, and properties."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from homeward import config as C
from homeward.functions import columns as fn
from homeward.operators import areas

AT = (37.5665, 126.978)
PROFILE = "activityLevel string, strangerResponse string, noiseSensitivity string, chaseTendency string, mobility string, escapeCause string"
#: profile, features (metres north, kind), behaviour, radius, scores of both versions.
SCENARIOS = {
    "fearful_park": ({"noiseSensitivity": "HIGH"}, [(75, "GREEN_SPACE")], "FEARFUL", 1000, [92, 86], [81, 68]),
    "active_path": ({"activityLevel": "HIGH", "chaseTendency": "HIGH"}, [(20, "FOOTPATH"), (290, "GREEN_SPACE")], "CHASE_DRIVEN", 1250, [98, 93], [94, 70]),
    "road_barrier": ({"mobility": "LIMITED"}, [(20, "MAJOR_ROAD"), (80, "RAILWAY_BARRIER")], "ALOOF", 500, [32, 29], [33, 30]),
    "sparse": ({"strangerResponse": "APPROACH"}, [(290, "BUILDING_RESIDENTIAL")], "HUMAN_SEEKING", 1000, [72, 66], [58, 50]),
    "empty_static": ({}, [], "ALOOF", 1000, [53, 47], [45, 39]),
}


@pytest.fixture(scope="module")
def world(spark):
    names = [f.split()[0] for f in PROFILE.split(", ")]
    asked = [(i, *AT, "중형", 24.0, tuple(p.get(n) for n in names)) for i, (p, *_) in enumerate(SCENARIOS.values())]
    raw = spark.createDataFrame(asked, f"request_id long, latitude double, longitude double, size string, hours double, profile struct<{', '.join(f'{n}: string' for n in names)}>")
    p = F.col("profile")
    requests = raw.select("request_id", "latitude", "longitude", fn.search_radius(F.col("size"), F.col("hours"), p).alias("radius"), fn.behavior_of(p).alias("behavior"), F.coalesce(p["mobility"] == "LIMITED", F.lit(False)).alias("limited"))
    places = [(i, float(m), k) for i, (_, fs, *_) in enumerate(SCENARIOS.values()) for m, k in fs]
    found = spark.createDataFrame(places, "request_id long, north double, kind string")
    features = found.select("request_id", fn.offset_lat(F.lit(AT[0]), F.col("north")).alias("latitude"), F.lit(AT[1]).alias("longitude"), F.array("kind").alias("kinds"))
    return requests, features


def test_behavior_and_radius(world):
    got = {r.request_id: (r.behavior, r.radius) for r in world[0].collect()}
    assert got == {i: (b, radius) for i, (_, _, b, radius, _, _) in enumerate(SCENARIOS.values())}


@pytest.mark.parametrize("improved", [False, True])
def test_priorities(world, improved):
    got: dict[int, list] = {}
    for r in areas.recommend(*world, improved).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.priority)
    assert got == {i: s[5 if improved else 4] for i, s in enumerate(SCENARIOS.values())}


def test_first_scenario_in_full(world):
    cells = areas.with_strengths(areas.grid(world[0].where("request_id = 0")), world[1])
    one = areas.select(areas.score_v1(cells), False).withColumn("reason", areas.reason(F.col("behavior"), F.col("near_kinds"))).orderBy("rank").collect()
    assert [(r.lat, r.lon, r.radius_m, list(r.codes)) for r in one] == [(37.5665, 126.978, 150, ["FEARFUL_HIDE", "GREEN_SPACE", "LOW_TRAFFIC"]), (37.564701, 126.978, 150, ["FEARFUL_HIDE", "GREEN_SPACE", "LOW_TRAFFIC"])]
    assert [one[0][p] for p in C.PARTS] == [30, 30, 14, 10, 8]
    assert one[0].reason == "두려움이 강한 행동 특성 및 주변 녹지와 이동 가능 경로을 고려한 우선 수색 영역입니다."
    two = areas.select(areas.score_v2(cells), True).orderBy("rank").first()
    assert [two[p] for p in C.PARTS] == [30, 23, 10, 10, 8]


def test_fallback(world):
    got = areas.fallback(world[0].where("request_id = 0")).orderBy("rank").collect()
    assert [(r.radius_m, r.priority) for r in got] == [(250, 50), (350, 40)]


def test_grid_sizes(spark):
    asked = spark.createDataFrame([(1, *AT, 1000), (2, *AT, 400)], "request_id long, latitude double, longitude double, radius int")
    assert {r.request_id: r["count"] for r in areas.grid(asked).groupBy("request_id").count().collect()} == {1: 81, 2: 13}


def test_range_join_is_the_theta_join(spark):
    rnd = random.Random(3)
    cells = spark.createDataFrame([(i, 0, i, 37.5 + rnd.uniform(-0.02, 0.02), 127 + rnd.uniform(-0.02, 0.02)) for i in range(300)], "request_id long, row int, col int, lat double, lon double")
    features = spark.createDataFrame([(37.5 + rnd.uniform(-0.02, 0.02), 127 + rnd.uniform(-0.02, 0.02), ["ROAD"]) for _ in range(400)], "latitude double, longitude double, kinds array<string>")
    every = cells.crossJoin(features).where(fn.distance_m(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")) <= C.INFLUENCE_M)
    got = sorted((r.request_id, round(r.f_lat, 9)) for r in areas.near(cells, features).collect())
    assert got and got == sorted((r.request_id, round(r.latitude, 9)) for r in every.collect())


def test_range_join_is_never_a_broadcast(spark):
    """Sizes before explode seem small enough for one, the exploded features are not."""
    cells = spark.range(10).selectExpr("id AS request_id", "0 AS row", "0 AS col", f"{AT[0]}D + id * 1e-6D AS lat", f"{AT[1]}D + id * 1e-6D AS lon")
    features = spark.range(10).selectExpr(f"{AT[0]}D + id * 1e-6D AS latitude", f"{AT[1]}D + id * 1e-6D AS longitude", "array('ROAD') AS kinds")
    plan = areas.near(cells, features)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert areas.near(cells, features).count() == 100


def test_strengths_make_no_pairs(spark):
    """No join of cells and features, whose pairs grow with the square of the events (F1)."""
    cells = spark.range(2000).selectExpr("id AS request_id", "0 AS row", "0 AS col", f"{AT[0]}D + id * 1e-7D AS lat", f"{AT[1]}D + id * 1e-7D AS lon")
    features = spark.range(2000).selectExpr(f"{AT[0]}D + id * 1e-7D AS latitude", f"{AT[1]}D + id * 1e-7D AS longitude", "array('ROAD', 'WATER') AS kinds")
    found = areas.with_strengths(cells, features)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroups" in plan
    assert found.agg(F.min("ROAD"), F.min("WATER"), F.count("*"), F.count("FOOTPATH")).first() == (1.0, 1.0, 2000, 0)


@pytest.mark.parametrize("north", [0.0, 37.5, -64.0, 89.9])
def test_strengths_are_those_of_all_pairs(spark, north):
    """Also across tiles, near a pole, for repeated features, and for places that are not known."""
    rnd = random.Random(5)
    wide = 0.02 / max(0.01, math.cos(math.radians(north)))
    at = lambda spread: (north + rnd.gauss(0, 0.02) * spread, 127 + rnd.gauss(0, wide) * spread)
    cells = spark.createDataFrame([(i, 0, 0, *(at(1.0) if i % 50 else (None, None))) for i in range(400)], "request_id long, row int, col int, lat double, lon double")
    places = [(*at(0.001 if i % 2 else 1.0), rnd.sample(C.KINDS, i % 3)) for i in range(600)]
    features = spark.createDataFrame(places + places[:200] + [(None, 127.0, ["ROAD"])], "latitude double, longitude double, kinds array<string>")
    away = fn.distance_m(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    every = cells.crossJoin(features.where("latitude IS NOT NULL")).withColumn("away", away).groupBy("request_id").agg(*(F.min(F.when((F.col("away") <= C.INFLUENCE_M) & F.array_contains("kinds", k), F.col("away"))).alias(k) for k in C.KINDS))
    want = {r.request_id: [None if x is None else 1 - x / C.INFLUENCE_M for x in r[1:]] for r in every.collect()}
    got = {r.request_id: list(r[5:]) for r in areas.with_strengths(cells, features).collect()}
    assert got.keys() == want.keys() and any(x is not None for v in got.values() for x in v)
    for i, strengths in want.items():
        assert [x is None for x in got[i]] == [x is None for x in strengths]
        assert all(a is None or a == pytest.approx(b, abs=1e-9) for a, b in zip(got[i], strengths, strict=True))


def test_strength_falls_with_distance(spark):
    cells = spark.createDataFrame([(1, 0, 0, *AT)], "request_id long, row int, col int, lat double, lon double")
    for metres, strength in ((0, 1.0), (75, 0.75), (150, 0.5), (225, 0.25), (299.999, 0.0)):
        f = spark.range(1).select(fn.offset_lat(F.lit(AT[0]), F.lit(float(metres))).alias("latitude"), F.lit(AT[1]).alias("longitude"), F.array(F.lit("ROAD")).alias("kinds"))
        assert areas.with_strengths(cells, f).first()["ROAD"] == pytest.approx(strength, abs=1e-4)


def test_empty_inputs(spark, world):
    assert areas.recommend(world[0].limit(0), world[1]).count() == 0
    assert areas.recommend(world[0], world[1].limit(0)).count() == 2 * len(SCENARIOS)


def test_labels_are_the_clusters():
    """The clusters of many requests at once are those of each alone (F2)."""
    rnd = random.Random(9)
    for share in (0.05, 0.3, 0.45, 0.7, 1.0):
        cells = sorted((q, r, c) for q in (1, 2, 7) for r in range(-7, 8) for c in range(-7, 8) if rnd.random() < share)
        labels = areas._labels(*(np.array(x) for x in zip(*cells, strict=True)))
        want = {(q, *k): (q, *own[0]) for q in (1, 2, 7) for own in areas._clusters([x[1:] for x in cells if x[0] == q]) for k in own}
        assert {x: cells[i] for x, i in zip(cells, labels.tolist(), strict=True)} == want


def test_requests_are_whole_wherever_batches_end():
    rnd = random.Random(4)
    ids = sorted(rnd.choices(range(12), k=60))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_pydict({"request_id": ids[i : i + size]}) for i in range(0, len(ids), size)]
        tables = [t.column("request_id").to_pylist() for t in areas._whole(batches)]
        assert sum(tables, []) == ids and all(a[-1] < b[0] for a, b in zip(tables, tables[1:]))


def test_selection_takes_many_requests_at_once(world):
    """No call of Python for each request (F2)."""
    cells = areas.with_strengths(areas.grid(world[0]), world[1])
    plan = areas.select(areas.score_v1(cells), False)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1
