"""The engine's own queries: name -> (spark, sf_dir) -> DataFrame. Oracles are in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homeward import config as C
from homeward.functions import columns as fn
from homeward.functions import metadata
from homeward.operators import areas, ingest, match, requests
from homeward.oracle import ORACLE_SQL  # noqa: F401  (the driver's entry reads it here)
from homeward.plans import plans
from homeward.sources import derived as d
from homeward.sources import gallery_cache, osm


def r(c, places: int = 5):
    return F.round(c, places)


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.nearest(d.queries(spark, sf), d.gallery(spark, sf), C.TOP_K, per_record=False, own=True)
    return rows.select("request_id", "gallery_id", r("visual").alias("visual"), F.col("image_rank").alias("rank"))


def query_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    photos = d.gallery(spark, sf).select("record_id", (F.col("vec_id") % 4).alias("photo"), "embedding")
    mean = match.normalized_mean(photos, "record_id", "embedding")
    return mean.select("record_id", r(F.get("embedding", F.lit(0))).alias("first"), r(F.get("embedding", F.lit(63))).alias("last"), r(fn.dot(F.col("embedding"), F.col("embedding"))).alias("norm"))


def best_per_record(spark: SparkSession, sf: str) -> DataFrame:
    best = match.best_per_record(match.without_own(match.scored(d.queries(spark, sf), d.gallery(spark, sf))))
    return best.select("request_id", "record_id", "gallery_id", r("visual").alias("visual"))


def phash_hamming_min(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.scored(d.queries(spark, sf), d.gallery(spark, sf))
    return rows.select("request_id", "gallery_id", F.col("phash_distance").cast("int").alias("phash_distance"), "near_duplicate")


def near_dup_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.search(d.queries(spark, sf), d.gallery(spark, sf), C.POOL)
    return rows.select("request_id", "record_id", "near_duplicate", F.col("rank_hash").cast("int").alias("rank_hash"), "image_rank")


def self_exclude(spark: SparkSession, sf: str) -> DataFrame:
    pairs = match.paired(d.queries(spark, sf), d.gallery(spark, sf)).select("request_id", "report_id", "gallery_id", "candidate_report_id")
    return match.without_own(pairs).select("request_id", "gallery_id")


def gallery_union(spark: SparkSession, sf: str) -> DataFrame:
    every = d.gallery(spark, sf).drop("candidate_type", "candidate_report_id")
    animals = every.where(F.col("vec_id") % 3 != 0)
    rows = match.gallery_union(animals, every.join(animals.select("vec_id"), "vec_id", "left_anti"))
    return rows.select("gallery_id", "candidate_type", "candidate_report_id", "part", "phash_crop")


def metadata_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "customer").selectExpr("c_custkey", "IF(c_custkey % 3 = 0, '  ', c_mktsegment) AS a", "IF(c_custkey % 5 = 0, NULL, c_name) AS b", "CAST(c_acctbal AS STRING) AS c", "CASE c_custkey % 4 WHEN 0 THEN '실종' WHEN 1 THEN 'sighting' WHEN 3 THEN ' Lost ' END AS t")
    return rows.select("c_custkey", fn.first_text(F.col("a"), F.col("b"), F.col("c_custkey")).alias("label"), r(fn.number(F.col("c")), 2).alias("amount"), fn.report_type(F.col("t"), "FOUND").alias("type"))


def decision(spark: SparkSession, sf: str) -> DataFrame:
    """Every 350th asks for a species that no gallery has."""
    asked = d.queries(spark, sf).withColumn("species", F.when(F.col("request_id") % 350 == 0, "rabbit").otherwise(F.col("species")))
    return match.decision(asked, match.search(asked, d.gallery(spark, sf), 1), "image_rank")


def top1_top2_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.gaps(match.search(d.queries(spark, sf), d.gallery(spark, sf), 2), "image_rank")
    return rows.select("request_id", r("gap").alias("gap"))


def tag_split_canonical(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*map(F.lit, d.WORDS))
    raw = F.concat(F.regexp_replace("p_name", " ", ","), F.lit("+"), F.get(words, F.col("p_size") % len(d.WORDS)))
    tags = fn.split_tags(raw, fn.tag_names(), F.lit(False))
    return d.table(spark, sf, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"))


def _tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's tags and those of the part seven keys on."""
    own = d.tags(spark, sf)
    other = own.select((F.col("p_partkey") - 7).alias("p_partkey"), *(F.col(c).alias(f"o_{c}") for c in own.columns[1:]))
    return own.join(other, "p_partkey")


TAGS = ["sex", "colors", "patterns", "size", "behavior"]


def _tag_score(rows: DataFrame, other: str = "o_") -> DataFrame:
    null = F.lit(None).cast("array<string>")
    side = lambda p: {f: F.col(p + f) if f in TAGS else null for f in C.TAG_WEIGHTS}
    return rows.withColumns(match.tag_similarity(side(""), side(other)))


def tag_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tag_score(_tag_pairs(spark, sf))
    return rows.select("p_partkey", r("tag_score").alias("score"), r("tag_coverage").alias("coverage"), F.array_join("matched", "|").alias("matched"), F.array_join("conflicts", "|").alias("conflicts"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, [*C.CATEGORY_FIELDS, "기타"]))
    at = (F.col("l_partkey") % (len(C.CATEGORY_FIELDS) + 1)).cast("int")
    # several rows may have one line number: their places follow from what they hold
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    return d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), pos.alias("pos"), F.get(names, at).alias("category"), F.col("l_suppkey").cast("string").alias("keyword"))


def feature_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.feature_pivot(_features(spark, sf), "k")
    return rows.select("k", "sex", "size", F.array_join("colors", "|").alias("colors"), F.array_join("distinctive_features", "|").alias("distinctive_features"))


def shown_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tag_score(_tag_pairs(spark, sf)).withColumn("m", match.shown_tags(F.col("matched")))
    return rows.select("p_partkey", F.element_at("m", F.lit("털색")).alias("color"), F.element_at("m", F.lit("행동")).alias("behavior"), F.coalesce(F.size("m"), F.lit(0)).alias("n"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every report and the one that follows."""
    own = d.reports(spark, sf)
    return own.join(own.select((F.col("report_id") - 1).alias("report_id"), *(F.col(c).alias(f"o_{c}") for c in own.columns[1:])), "report_id")


def haversine(spark: SparkSession, sf: str) -> DataFrame:
    km = fn.haversine_km(*(F.col(c) for c in ("latitude", "longitude", "o_latitude", "o_longitude")))
    return _neighbours(spark, sf).select("report_id", r(km, 4).alias("km"), r(F.exp(-km / C.LOCATION_DECAY_KM)).alias("score"))


def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.reports(spark, sf)
    odd = F.when(F.col("report_id") % 9 == 0, "x2024-13-45").when(F.col("report_id") % 11 == 0, "2024").otherwise(F.col("date_text"))
    return rows.select("report_id", fn.flexible_date(odd).alias("day"))


def time_bands(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.lit("2024-02-20").cast("date"), "event_date") - (F.col("report_id") % 240).cast("int") + 60
    return d.reports(spark, sf).select("report_id", days.alias("days"), fn.banded(days, C.DAY_SCORES).alias("score"))


def address_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("report_id", fn.address_similarity(F.col("address"), F.col("o_address")).alias("score"))


def _spatiotemporal(rows: DataFrame) -> DataFrame:
    place, km, method = fn.location_score(*(F.col(c) for c in ("latitude", "longitude", "o_latitude", "o_longitude", "address", "o_address")))
    own, other = fn.report_type(F.col("type_text"), "LOST"), fn.report_type(F.col("o_type_text"), "FOUND")
    days = fn.elapsed_days(own, fn.flexible_date(F.col("date_text")), other, fn.flexible_date(F.col("o_date_text")))
    time = fn.banded(days, C.DAY_SCORES)
    return rows.withColumns({"place_score": place, "distance_km": km, "place_method": method, "elapsed_days": days, "time_score": time, "st_score": fn.spatiotemporal(place, time)})


def spatiotemporal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _neighbours(spark, sf).withColumn("latitude", F.when(F.col("report_id") % 4 != 0, F.col("latitude")))
    return _spatiotemporal(rows).select("report_id", r("place_score").alias("place"), "place_method", "elapsed_days", r("time_score").alias("time"), r("st_score").alias("score"))


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    """The image pool of each query with tags, places and dates of both sides."""
    asked, gal = d.queries(spark, sf), d.gallery(spark, sf)
    pool = match.search(asked, gal, C.POOL)
    tags, rep = d.tags(spark, sf), d.reports(spark, sf)
    own_tags = tags.select(F.col("p_partkey").alias("request_id"), *tags.columns[1:])
    own_rep = rep.withColumnRenamed("report_id", "request_id")
    side = pool.join(own_tags, "request_id", "left").join(own_rep, "request_id", "left")
    o_tags = tags.select(F.col("p_partkey").alias("vec_id"), *(F.col(c).alias(f"o_{c}") for c in tags.columns[1:]))
    o_rep = rep.select(F.col("report_id").alias("vec_id"), *(F.col(c).alias(f"o_{c}") for c in rep.columns[1:]))
    side = side.join(o_tags, "vec_id", "left").join(o_rep, "vec_id", "left")
    side = _spatiotemporal(_tag_score(side))
    has = lambda cs: F.coalesce(*(F.col(c) for c in cs)).isNotNull()
    return side.withColumns({"has_tags": has(["colors"]), "has_text": F.lit(False), "has_place": has(["event_date"]), "text_score": F.lit(None).cast("double")})


def active_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.active_weights(_pool(spark, sf))
    return rows.groupBy("request_id").agg(*(r(F.max(f"w_{k}")).alias(f"w_{k}") for k in C.RERANK_WEIGHTS))


def rerank_full(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("request_id", "record_id", "image_rank", r("ranking").alias("ranking"), "rank")


def wire_results(spark: SparkSession, sf: str) -> DataFrame:
    return match.wire(_reranked(spark, sf))


def behavior_radius(spark: SparkSession, sf: str) -> DataFrame:
    return d.requests(spark, sf, every=True).select("request_id", "behavior", "radius", "limited")


def event_hours(spark: SparkSession, sf: str) -> DataFrame:
    day, hour = F.to_date(F.col("ts")), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 24).cast("int"))
    now = F.make_timestamp(F.lit(2026), F.lit(10), F.lit(29), F.lit(12), F.lit(0), F.lit(0), F.lit("Asia/Seoul"))
    hours = (now.cast("double") - fn.event_time(day, hour, now).cast("double")) / 3600
    return d.table(spark, sf, "events").select("event_id", r(hours, 3).alias("hours"))


def grid_generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = areas.grid(d.requests(spark, sf, every=True))
    return rows.select("request_id", "row", "col", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), r("distance_m", 3).alias("distance_m"))


def osm_classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "events").withColumn("tags", F.expr(
        "map_filter(map('building', IF(event_id % 8 = 0, 'yes', NULL), 'highway', CASE event_id % 7 WHEN 0 THEN 'footway' WHEN 1 THEN 'primary' WHEN 2 THEN 'service' END, 'landuse', CASE event_id % 5 WHEN 0 THEN 'forest' WHEN 1 THEN 'retail' WHEN 2 THEN 'residential' END, 'natural', IF(event_id % 6 = 0, 'water', NULL), 'barrier', IF(event_id % 9 = 0, 'wall', IF(event_id % 9 = 1, 'gate', NULL)), 'leisure', IF(event_id % 10 = 0, 'park', NULL)), (k, v) -> v IS NOT NULL)"
    ))
    return rows.select("event_id", F.array_join(fn.osm_kinds(F.col("tags")), "|").alias("kinds"))


def cell_feature_range_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = areas.near(areas.grid(d.requests(spark, sf)), d.features(spark, sf))
    return rows.groupBy(*areas.CELL).agg(F.count("*").alias("n"), r(F.min("away_m"), 3).alias("nearest_m"))


def _scored(spark: SparkSession, sf: str, improved: bool) -> DataFrame:
    cells = areas.with_strengths(areas.grid(d.requests(spark, sf)), d.features(spark, sf))
    return (areas.score_v2 if improved else areas.score_v1)(cells)


def score_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, False).select(*areas.CELL, r("score").alias("score"), F.array_join("near_kinds", "|").alias("kinds"))


def score_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, True).select(*areas.CELL, r("score").alias("score"), r("behavior_environment").alias("behavior_environment"), r("accessibility").alias("accessibility"))


def eligible_cells(spark: SparkSession, sf: str) -> DataFrame:
    return areas.eligible(_scored(spark, sf, False)).select(*areas.CELL, r("score").alias("score"))


def cluster_components(spark: SparkSession, sf: str) -> DataFrame:
    return areas.clusters(areas.eligible(_scored(spark, sf, False)))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    cells = areas.eligible(_scored(spark, sf, False))
    return areas.candidates(cells, areas.clusters(cells))


def cluster_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("request_id", "cluster_row", "cluster_col", r("lat").alias("lat"), r("lon").alias("lon"), "n_cells", "radius_m", "priority")


def contributions_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return areas.largest_remainder(_candidates(spark, sf), ["request_id", "cluster_row", "cluster_col"]).select("request_id", "cluster_row", "cluster_col", "part", "points")


def _picked(rows: DataFrame, *more) -> DataFrame:
    joined = [F.array_join("codes", "|").alias("codes"), "reason"]
    return rows.select("request_id", "rank", r("lat").alias("lat"), r("lon").alias("lon"), "radius_m", "priority", *more, *joined)


def select_areas(spark: SparkSession, sf: str) -> DataFrame:
    return _picked(areas.select(_scored(spark, sf, False), False), "n_cells", *C.PARTS, F.array_join("near_kinds", "|").alias("kinds"))


def explain_topevidence(spark: SparkSession, sf: str) -> DataFrame:
    return _picked(areas.select(_scored(spark, sf, True), True), *C.PARTS)


def _without_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh request."""
    return d.requests(spark, sf).where("request_id DIV 50 % 7 = 0").select("request_id")


def recommend_areas(spark: SparkSession, sf: str) -> DataFrame:
    rows = areas.recommend(d.requests(spark, sf), d.features(spark, sf), failed=_without_map(spark, sf))
    return _picked(rows, "fallback_used")


def fallback_areas(spark: SparkSession, sf: str) -> DataFrame:
    return areas.fallback(d.requests(spark, sf, every=True)).select("request_id", "rank", "radius_m", "priority", F.array_join("codes", "|").alias("codes"))


def compare_rank_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = plans.compare(d.requests(spark, sf), d.features(spark, sf), _without_map(spark, sf))
    return rows.select(
        "request_id", "rank", "status", "shift_m", "score_delta", "before_radius_m", "after_radius_m", "before_priority", "after_priority",
        r("before_lat").alias("before_lat"), r("after_lon").alias("after_lon"), F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"),
    )


def compare_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return plans.compare_summary(d.requests(spark, sf), d.features(spark, sf), _without_map(spark, sf))


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with metadata under changing keys."""
    k = "p_partkey"
    return d.table(spark, sf, "part").selectExpr(k, "p_name", "p_brand", f"""to_json(named_struct(
        'sexCd', CASE {k} % 3 WHEN 0 THEN 'M' WHEN 1 THEN '암컷' END, 'gender', IF({k} % 3 = 2, '수컷 추정', NULL),
        'color', IF({k} % 4 = 0, '흰색/검정', NULL), 'colors', IF({k} % 4 = 1, array('흰색', '삼색이', ' '), NULL), 'colorCd', IF({k} % 4 = 2, '갈색 및 갈색', NULL),
        'lostLocation', IF({k} % 3 = 0, named_struct('lat', '37.5', 'lng', 127.125D, 'roadAddress', '서울특별시 강남구'), NULL), 'latitude', IF({k} % 3 = 1, 37.25D, NULL), 'lon', IF({k} % 3 = 1, '127.5', NULL),
        'happenPlace', IF({k} % 3 = 1, ' 경기도 수원시 ', NULL), 'memo', p_name, 'missingAt', IF({k} % 2 = 0, '2024.01.05', NULL), 'eventDate', IF({k} % 2 = 1, '2024-02-06', NULL), 'type', IF({k} % 5 = 0, '발견', NULL))) AS meta""")


def metadata_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = metadata.normalized(_metadata(spark, sf), "meta")
    return rows.select("p_partkey", "report_type", F.array_join("sex", "|").alias("sex"), F.array_join("colors", "|").alias("colors"), "latitude", "longitude", "address", "lost_at", "metadata_text")


def metadata_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Sex from the match where the metadata has no ``sexCd``; descriptions joined without repeats."""
    k = "p_partkey"
    rows = d.table(spark, sf, "part").selectExpr(k, f"IF({k} % 3 = 0, NULL, '암') AS own_sex", f"""to_json(named_struct('sexCd', IF({k} % 3 = 0, 'M', NULL), 'color', IF({k} % 4 = 0, '흰색/검정', NULL), 'colors', IF({k} % 4 = 1, array('흰색', '삼색이', ' '), NULL), 'colorCd', IF({k} % 4 = 2, '갈색 및 갈색', NULL),
        'specialMark', p_name, 'description', p_name, 'etcBigo', IF({k} % 2 = 1, p_brand, NULL), 'happenDt', IF({k} % 2 = 0, '20240105', NULL), 'noticeSdt', '20240206', 'foundLocation', IF({k} % 3 = 0, named_struct('foundLat', 37.5D), NULL))) AS meta""")
    rows = metadata.normalized(rows, "meta", candidate=True, sex="own_sex")
    return rows.select(k, "report_type", F.array_join("sex", "|").alias("sex"), F.array_join("colors", "|").alias("colors"), "found_at", "lost_at", "description", "latitude")


def tag_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """Full-width letters and signs, brought to NFKC before they are looked up."""
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Ｍ' WHEN 1 THEN '화이트　' ELSE concat(substr(p_brand, 1, 5), '①２') END")
    return d.table(spark, sf, "part").select("p_partkey", fn.canonical_tag(metadata.nfkc(raw), fn.tag_names(), F.lit(False)).alias("tag"))


def _map_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each five events; every eleventh is damaged."""
    element = """named_struct('lat', IF(event_id % 3 = 0, 1.0D, event_id % 100 / 4.0D), 'lon', IF(event_id % 3 = 0, 2.0D, 127.5D), 'center', IF(event_id % 3 = 0, named_struct('lat', event_id % 100 / 4.0D, 'lon', 127.25D), NULL),
        'tags', IF(event_id % 7 = 0, NULL, CASE event_id % 4 WHEN 0 THEN map('building', 'yes') WHEN 1 THEN map('highway', 'path') WHEN 2 THEN map('waterway', 'river') ELSE map('name', 'x') END))"""
    each = d.table(spark, sf, "events").selectExpr("event_id DIV 5 AS request_id", f"{element} AS e")
    made = each.groupBy("request_id").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("payload"))
    return made.withColumn("payload", F.when(F.col("request_id") % 11 == 0, "no answer").otherwise(F.col("payload")))


def osm_features(spark: SparkSession, sf: str) -> DataFrame:
    return osm.features(_map_answers(spark, sf)).withColumn("kinds", F.array_join("kinds", "|"))


def osm_failed(spark: SparkSession, sf: str) -> DataFrame:
    answers = _map_answers(spark, sf)
    return osm.failed(answers, osm.features(answers))


def osm_question(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "events").select("event_id", osm.question(F.lit(37.5), F.lit(127.25), F.col("event_id") % 5000).alias("question"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as they come in, some of them wrong."""
    i = "event_id"
    rows = d.table(spark, sf, "events").selectExpr(
        f"{i} AS report_id", f"IF({i} % 6 = 1, '고양이', '강아지') AS species", f"IF({i} % 10 = 3, 'XL', CASE {i} % 3 WHEN 0 THEN '소형' WHEN 1 THEN '중형' ELSE '대형' END) AS size",
        f"IF({i} % 23 = 0, DATE '2031-01-01', CAST(ts AS DATE)) AS event_date", f"CAST(IF({i} % 13 = 0, 24, IF({i} % 4 = 0, NULL, {i} % 24)) AS INT) AS event_hour",
        f"IF({i} % 17 = 0, 91.0D, 37.5D) AS latitude", "127.0D AS longitude",
        f"""named_struct('activityLevel', CAST(NULL AS STRING), 'strangerResponse', 'NEUTRAL', 'noiseSensitivity', 'LOW', 'chaseTendency', 'LOW', 'mobility', IF({i} % 19 = 0, 'FAST', IF({i} % 2 = 0, 'LIMITED', 'NORMAL')), 'escapeCause', 'DOOR_OPEN') AS profile""",
    )
    now = F.make_timestamp(F.lit(2030), F.lit(1), F.lit(1), F.lit(12), F.lit(0), F.lit(0), F.lit("Asia/Seoul"))
    return requests.judged(rows, now)


def request_problems(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(spark, sf).select("report_id", F.array_join("problems", "|").alias("problems"))


def request_prepared(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests.prepared(_asked(spark, sf))
    said = areas.assumptions(F.col("hour_known"), F.col("from_now"), F.lit(False))
    return rows.select("request_id", F.array_join(said, "|").alias("assumptions"), "limited", "radius")


def photo_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "embeddings").selectExpr("vec_id", "IF(vec_id % 4 = 0, array(' ', ''), array(' https://img.example/1 ', '')) AS photo_urls", "IF(vec_id % 3 = 0, 'bird', ' Dog') AS species")
    return requests.photo_requests(rows, any_species=False).select("vec_id", F.size("photo_urls").alias("n_urls"), "problem")


def resolve_species(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("강아지"), F.lit("고양이"), F.lit("토끼"))
    return d.table(spark, sf, "embeddings").select("vec_id", requests.species(F.get(names, (F.col("vec_id") % 3).cast("int"))).alias("species"))


def image_only_top(spark: SparkSession, sf: str) -> DataFrame:
    pool = match.search(d.queries(spark, sf), d.gallery(spark, sf), C.POOL)
    return match.image_only(pool, C.TOP_K).select("request_id", "record_id", "rank")


def top1_changed(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    return match.first_changed(pool, match.rerank(pool, 1))


def diagnose_records(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.range(0, 2000, 7).select(F.col("id").cast("string").alias("record_id"))
    return match.diagnosed(asked, d.gallery(spark, sf)).select("record_id", "gallery_id", "in_gallery")


def mock_match(spark: SparkSession, sf: str) -> DataFrame:
    asked = d.table(spark, sf, "customer").selectExpr("c_custkey AS request_id", "IF(c_custkey % 3 = 0, array(), array(named_struct('category', '털색', 'keyword', c_mktsegment), named_struct('category', IF(c_custkey % 2 = 0, '털색', '귀'), 'keyword', c_name))) AS features")
    return match.mock(asked).select("request_id", "rank", "desertionNo", "visualScore", F.element_at("matchedTags", F.lit("털색")).alias("color"))


def conflicting_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tag_score(_tag_pairs(spark, sf)).withColumn("m", match.conflicting_tags(F.col("conflicts")))
    return rows.select("p_partkey", F.element_at("m", F.lit("성별")).alias("sex"), F.element_at("m", F.lit("크기")).alias("size"))


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    return match.rerank(_pool(spark, sf), C.TOP_K)


def backend_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.backend(_reranked(spark, sf))
    return rows.select("request_id", "rank", "imageRank", "animalId", "visualSimilarity", "rankingScore", "visualDisplayScore")


def console_report(spark: SparkSession, sf: str) -> DataFrame:
    return match.reported(_reranked(spark, sf)).withColumn("line", F.regexp_extract("line", r"^(.*) visual=", 1))


def text_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Texts' vectors stand in for photos' here: each against the next."""
    own = d.table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return own.join(other, "vec_id").select("vec_id", r(match.text_score(F.col("embedding"), F.col("o"))).alias("score"))


def gallery_scan(spark: SparkSession, sf: str) -> DataFrame:
    stored = d.gallery(spark, sf).withColumns({"model_version": F.expr("IF(vec_id % 5 = 0, 'v1', 'v2')"), "preprocess_version": F.lit("p1")})
    return gallery_cache.for_search(stored, "dog", "v2", "p1", reports=False).select("gallery_id")


def gallery_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return d.gallery(spark, sf).agg(F.count("*").alias("gallery_size"), F.array_join(F.array_sort(F.collect_set("species")), "|").alias("species"))


def cache_compatible(spark: SparkSession, sf: str) -> DataFrame:
    made = d.table(spark, sf, "nation").selectExpr("n_nationkey", "IF(n_nationkey % 4 = 0, 'old', 'm1') AS model_version", "'p1' AS preprocess_version", "3 AS cache_version", "IF(n_nationkey % 5 = 0, NULL, 64) AS dim")
    return ingest.compatible(made, "m1", "p1", 3, 64).select("n_nationkey", "compatible")


def import_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Photos of a gallery file; every seventh has no metadata, every sixth no url in it."""
    gal = d.gallery(spark, sf)
    meta = gal.where("vec_id % 7 <> 0").selectExpr("gallery_id", "IF(vec_id % 6 = 0, ' ', image_url) AS image_url", "IF(vec_id % 2 = 0, 9, NULL) AS photo_index")
    return gallery_cache.import_rows(gal.drop("image_url"), meta).select("gallery_id", "ok", "photo_index")


def sync_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.to_date("o_orderdate")).alias("updated"))
    mark = rows.agg(F.date_sub(F.max("updated"), 60)).first()[0]
    return ingest.sync_plan(rows, None, mark, False, "updated", "k")


def _sync(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = d.gallery(spark, sf).withColumn("photo_urls", F.expr("transform(sequence(0, CAST(vec_id % 5 AS INT)), i -> concat(image_url, '/', CAST(i AS STRING)))"))
    return rows, rows.select("vec_id")


def sync_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.sync_summary(*_sync(spark, sf), F.lit(True), 50, dry_run=True)


def sync_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.sync_summary(*_sync(spark, sf), F.col("vec_id") % 6 != 0, 50)


def upsert_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    return ingest.newest(rows, ["k"], "version").select("k", "version", "price")


def text_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "customer").select(F.expr("IF(c_custkey % 2 = 0, 'query', 'passage')").alias("role"), F.concat(F.lit(" "), "c_name").alias("text"))
    return ingest.text_batches(rows.unionByName(rows), "role", "text", C.TEXT_BATCH)


def best_detection(spark: SparkSession, sf: str) -> DataFrame:
    boxes = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(1.0).alias("confidence"), F.col("o_totalprice").cast("double").alias("area"), F.lit(1e6).alias("image_area"), F.col("o_orderkey").alias("place"))
    return ingest.best_detection(boxes, "k").select("k", "place")


def sharpness(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of 64 numbers read as images of 8 by 8."""
    gray = F.transform("embedding", lambda x: x.cast("double"))
    return d.table(spark, sf, "embeddings").select("vec_id", r(ingest.sharpness(gray, 8)).alias("sharpness"))


def photo_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _sync(spark, sf)
    return rows.agg(F.sum(F.size(F.slice("photo_urls", 1, 3))).alias("photos"))


def cache_reuse(spark: SparkSession, sf: str) -> DataFrame:
    gal = d.gallery(spark, sf)
    cache = gal.where("vec_id % 3 <> 1").withColumn("image_url", F.when(F.col("vec_id") % 5 == 0, F.concat("image_url", F.lit("?v=2"))).otherwise(F.col("image_url")))
    return ingest.reuse(gal.drop("embedding"), cache).select("gallery_id", "hit")


def incremental_since(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "orders").withColumn("updated", F.to_date("o_orderdate"))
    mark = rows.agg(F.date_sub(F.max("updated"), 30)).first()[0]
    return ingest.since(rows, "updated", mark).select("o_orderkey", "updated")


def missing_only(spark: SparkSession, sf: str) -> DataFrame:
    done = d.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return ingest.missing(d.table(spark, sf, "customer"), done, "c_custkey").select("c_custkey", "c_name")


def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.batches(d.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 50)


def photo_rows(spark: SparkSession, sf: str) -> DataFrame:
    urls = F.expr("transform(sequence(0, CAST(vec_id % 5 AS INT)), i -> IF(i = 1, ' ', concat(image_url, '/', CAST(i AS STRING))))")
    rows = ingest.photos(d.gallery(spark, sf).drop("gallery_id").withColumn("photo_urls", urls))
    return rows.select("vec_id", "photo", "url", "gallery_id", fn.photo_index(F.lit(None).cast("int"), F.col("gallery_id")).alias("photo_index"))


def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.summary(d.gallery(spark, sf), F.col("phash_crop").isNotNull())


def quality_notes(spark: SparkSession, sf: str) -> DataFrame:
    notes = fn.quality_warnings(F.expr("vec_id % 6 <> 0"), F.expr("(vec_id % 10) / 10.0D"), F.expr("(vec_id % 20) / 100.0D"), F.expr("CAST(vec_id % 90 AS DOUBLE)"), F.expr("100 + vec_id % 200"))
    return d.gallery(spark, sf).select("vec_id", F.array_join(notes, "|").alias("notes"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, query_mean_vector, best_per_record, phash_hamming_min, near_dup_rank, self_exclude, gallery_union, metadata_coalesce, decision, top1_top2_gap,
        tag_split_canonical, tag_jaccard, feature_pivot, shown_tags, haversine, date_parse, time_bands, address_similarity, spatiotemporal, active_weights, rerank_full, wire_results,
        behavior_radius, event_hours, grid_generate, osm_classify, cell_feature_range_join, score_v1, score_v2, eligible_cells, cluster_components, cluster_candidates,
        contributions_largest_remainder, select_areas, explain_topevidence, fallback_areas, compare_rank_diff, compare_summaries,
        recommend_areas, metadata_query, metadata_candidate, tag_nfkc, osm_features, osm_failed, osm_question, request_problems, request_prepared, photo_requests, resolve_species,
        image_only_top, top1_changed, diagnose_records, mock_match, conflicting_tags, backend_results, console_report, text_scores, gallery_scan, gallery_manifest, cache_compatible,
        import_rows, sync_candidates, sync_dry_run, sync_summary, upsert_newest, text_batches, best_detection, sharpness, photo_counts,
        cache_reuse, incremental_since, missing_only, batch_assign, photo_rows, ingest_summary, quality_notes,
    )
}
