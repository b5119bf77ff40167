"""Matching: galleries, vector search, best photo of a record, re-ranking.

Queries have request_id, species, embedding and phashes (an array of numbers); galleries have
gallery_id, record_id, candidate_type, candidate_report_id, species, embedding, phash_full,
phash_crop and ordinal (the order of scanning, which decides between equals).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from homeward import config as C
from homeward.functions import columns as fn

#: Bytes of queries that every executor may hold, and of queries and of photos that one task compares.
HELD_BYTES, QUERY_BYTES, PHOTO_BYTES = 8 << 20, 4 << 20, 32 << 20
#: Bytes of a partition where pairs are made on the JVM, and of a row whose size is not known.
PART_BYTES, ROW_BYTES = 64 << 20, 4096


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size of a plan's rows: an upper bound as a rule, and no job is run for it. Where
    Catalyst knows nothing (rows of an RDD), they are counted."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 50 else df.count() * ROW_BYTES


def normalized_mean(photos: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of up to three photos' vectors, of length 1; no row where it has length 0."""
    first = photos.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("photo"))).where("_n <= 3")
    each = first.groupBy(key).agg(F.collect_list(F.struct("_n", F.transform(vector, lambda x: x.cast("double")).alias("v"))).alias("_l"))
    each = each.withColumn("_l", F.transform(F.array_sort("_l"), lambda s: s["v"]))
    total = F.aggregate(F.slice("_l", 2, 2), F.get("_l", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = each.withColumn("_v", F.transform(total, lambda x: x / F.size("_l")))
    norm = F.sqrt(fn.dot(F.col("_v"), F.col("_v")))
    return mean.withColumn("_norm", norm).where("_norm > 1e-12").select(key, F.transform("_v", lambda x: x / F.col("_norm")).alias(vector))


def gallery_union(animals: DataFrame, reports: DataFrame) -> DataFrame:
    """Animals, then reports; null hashes become empty, null measures 0. Types decide on ids."""
    a = animals.withColumns({"candidate_type": F.lit("SHELTER"), "candidate_report_id": F.lit(None).cast("bigint")})
    r = reports.withColumns({"candidate_type": F.lit("REPORT"), "candidate_report_id": F.col("record_id").try_cast("bigint")})
    every = a.withColumn("part", F.lit(0)).unionByName(r.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return every.withColumns({"phash_full": F.coalesce("phash_full", F.lit("")), "phash_crop": F.coalesce("phash_crop", F.lit(""))})


def without_own(pairs: DataFrame) -> DataFrame:
    """Without the photos of the report that asks; candidates that are no report stay."""
    return pairs.where(~F.col("candidate_report_id").eqNullSafe(F.col("report_id")) | F.col("candidate_report_id").isNull())


def paired(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Every query with every photo of its species.

    There is no key finer than the species, of which there are two. Few queries (by their bytes) go
    to every task of the gallery; more are copied once for each part that the gallery is dealt
    into, of which there are as many as it has partitions' worth of bytes."""
    q = queries.withColumnRenamed("embedding", "q_embedding")
    if planned_bytes(q) <= HELD_BYTES:
        return gallery.join(F.broadcast(q), "species")
    n = max(2, -(-planned_bytes(gallery) // PART_BYTES))
    parts = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = gallery.withColumn("_part", F.pmod(F.xxhash64("gallery_id"), F.lit(n)).cast("int"))
    return dealt.join(parts, ["species", "_part"]).drop("_part")


def least_hamming(queries: Column, *own: Column) -> Column:
    """The least distance of any query hash to any hash of a photo; null without both."""
    return F.array_min(F.transform(queries, lambda q: F.least(*(fn.hamming(q, h) for h in own))))


def scored(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Pairs with visual score, hash distance and the key that ranks them."""
    pairs = paired(queries, gallery)
    visual = fn.clamp(fn.dot(F.col("embedding"), F.col("q_embedding")), -1.0, 1.0)
    far = least_hamming(F.col("phashes"), fn.phash_bits(F.col("phash_full")), fn.phash_bits(F.col("phash_crop")))
    pairs = pairs.withColumns({"visual": visual, "phash_distance": far}).drop("embedding", "q_embedding", "phashes")
    pairs = pairs.withColumn("near_duplicate", F.coalesce(F.col("phash_distance") <= C.NEAR_DUPLICATE_BITS, F.lit(False)))
    return pairs.withColumn("rank_hash", F.when(F.col("near_duplicate"), -F.col("phash_distance")).otherwise(C.FAR_PHASH))


RANKED = [F.desc, F.desc, F.desc, F.asc]
RANK_KEYS = ["near_duplicate", "rank_hash", "visual", "ordinal"]


def rank_order() -> list[Column]:
    return [way(c) for way, c in zip(RANKED, RANK_KEYS, strict=True)]


def best_per_record(pairs: DataFrame, record: list[str] = ["candidate_type", "record_id"]) -> DataFrame:  # noqa: B006
    """The best photo of each record; aggregated where the pairs are made, before any shuffle."""
    keys = ["request_id", *record]
    rest = [c for c in pairs.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("near_duplicate", "rank_hash", "visual", (-F.col("ordinal")).alias("o")))
    return pairs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def top(rows: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    own = Window.partitionBy("request_id").orderBy(*rank_order())
    return rows.withColumn(rank, F.row_number().over(own)).where(F.col(rank) <= k)


def nearest(queries: DataFrame, gallery: DataFrame, k: int, per_record: bool = True, own: bool = False, parts: tuple[int, int] | None = None) -> DataFrame:
    """The ``k`` best records of each query, each by its best photo (or the ``k`` best photos), with
    ``image_rank``; photos of the asking report are left out before, unless ``own``.

    Blocks of queries meet blocks of photos, whose scores are one matrix product; of each pair of
    blocks only the k best of every query leave the task. Both blocks have bounded bytes (``parts``:
    how many of photos and of queries; by Catalyst's sizes otherwise)."""
    n, m = parts or (-(-planned_bytes(gallery) // PHOTO_BYTES), -(-planned_bytes(queries) // QUERY_BYTES))
    n, m = max(1, min(n, 1 << 20)), max(1, min(m, 1 << 20))
    deal = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own_hashes = F.array_compact(F.array(fn.phash_bits(F.col("phash_full")), fn.phash_bits(F.col("phash_crop"))))
    photos = gallery.withColumns({"_hashes": own_hashes, "_g": deal("gallery_id", n)}).select("*", every(m).alias("_q"))
    asked = queries.select("request_id", "report_id", "species", "embedding", "phashes", deal("request_id", m).alias("_q")).select("*", every(n).alias("_g"))
    rest = [f for f in gallery.schema.fields if f.name not in ("embedding", "species")]
    made = "request_id bigint, visual double, phash_distance int, near_duplicate boolean, rank_hash int"
    schema = ", ".join([made, "species string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in made.split(", ")]
        take, cols = [], [[] for _ in names]
        if left.num_rows and right.num_rows:
            # photos in the order of scanning, so that stable sorting leaves equals in it
            left = left.sort_by([("ordinal", "ascending")])
            vectors = np.stack(left.column("embedding").to_numpy()).astype(np.float64)
            hashes = [np.array([(h[i : i + 1] or [0])[0] for h in left.column("_hashes").to_pylist()], np.int64).view(np.uint64) for i in (0, 1)]
            known = [np.array([len(h) > i for h in left.column("_hashes").to_pylist()]) for i in (0, 1)]
            reports = np.array([-1 if x is None else x for x in left.column("candidate_report_id").to_pylist()], np.int64)
            record = np.array([f"{a}|{b}" for a, b in zip(left.column("candidate_type").to_pylist(), left.column("record_id").to_pylist(), strict=True)])
            _, record = np.unique(record, return_inverse=True)
            for q in right.to_pylist():
                visual = np.clip(vectors @ np.array(q["embedding"], np.float64), -1.0, 1.0)
                far = np.full(len(visual), 99)
                for h in q["phashes"] or []:
                    for own_h, has in zip(hashes, known, strict=True):
                        far = np.minimum(far, np.where(has, np.bitwise_count(own_h ^ np.int64(h).view(np.uint64)).astype(np.int64), 99))
                near = far <= C.NEAR_DUPLICATE_BITS
                key = np.where(near, 10.0 - far + (visual + 1) / 4, visual)  # near duplicates by distance, then all by score
                order = np.argsort(-key, kind="stable")
                if not own and q["report_id"] is not None:
                    order = order[reports[order] != q["report_id"]]
                if per_record:
                    _, once = np.unique(record[order], return_index=True)
                    order = order[np.sort(once)]
                order = order[:k]
                take.append(order)
                for c, x in zip(cols, (np.full(len(order), q["request_id"]), visual[order], far[order], near[order], np.where(near[order], -far[order], C.FAR_PHASH)), strict=True):
                    c.append(x)
        if not take:
            return pa.table({f.name: pa.array([], f.type) for f in arrow}, schema=arrow)
        at = pa.array(np.concatenate(take))
        got = {name: np.concatenate(c) for name, c in zip(names, cols, strict=True)}
        out = {name: pa.array(v, from_pandas=False) for name, v in got.items()}
        out["phash_distance"] = pa.array(got["phash_distance"].astype(np.int32), mask=got["phash_distance"] == 99)
        every_col = [*(out[name].cast(arrow.field(name).type) for name in names), *(left.column(name).take(at).combine_chunks().cast(arrow.field(name).type) for name in ("species", *(f.name for f in rest)))]
        return pa.table(every_col, schema=arrow)

    arrow = to_arrow_schema(photos.sparkSession.createDataFrame([], schema).schema)
    keys = ["species", "_g", "_q"]
    found = photos.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, schema)
    if per_record and n > 1:
        found = best_per_record(found)
    return top(found, k, "image_rank")


def search(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """The ``k`` best records of each query, each by its best photo, without the asking report's own."""
    return nearest(queries, gallery, k)


def image_only(pool: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of a pool by image alone, ranked anew."""
    return pool.where(F.col("image_rank") <= k).withColumn("rank", F.col("image_rank"))


def first_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each request the first record by image and the first after re-ranking, and if they differ."""
    one = before.where("image_rank = 1").select("request_id", F.col("record_id").alias("before"))
    two = after.where("rank = 1").select("request_id", F.col("record_id").alias("after"))
    return one.join(two, "request_id").withColumn("changed", F.col("before") != F.col("after"))


def diagnosed(records: DataFrame, gallery: DataFrame) -> DataFrame:
    """The gallery's photos of some records (``record_id``), a row without photo where it has none."""
    return records.select("record_id").distinct().join(gallery, "record_id", "left").withColumn("in_gallery", F.col("gallery_id").isNotNull())


# What is said of the first match.
DECISIONS = ("NO_GALLERY", "NEAR_DUPLICATE_CANDIDATE", "RANKED_CANDIDATES_NEED_HUMAN_REVIEW")


def decision(requests: DataFrame, ranked: DataFrame, rank: str = "rank") -> DataFrame:
    first = ranked.where(F.col(rank) == 1).select("request_id", "near_duplicate")
    said = F.when(F.col("near_duplicate").isNull(), DECISIONS[0]).when(F.col("near_duplicate"), DECISIONS[1]).otherwise(DECISIONS[2])
    return requests.select("request_id").join(first, "request_id", "left").select("request_id", said.alias("decision"))


def gaps(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """Lead of the first over the second, unless the first is a near duplicate."""
    own = Window.partitionBy("request_id").orderBy(rank)
    rows = ranked.withColumn("second", F.lead("visual").over(own)).where(F.col(rank) == 1)
    return rows.where("NOT near_duplicate AND second IS NOT NULL").select("request_id", (F.col("visual") - F.col("second")).alias("gap"))


def _labelled(values: Column, field: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{field}:"), v))


def tag_similarity(own: dict[str, Column], other: dict[str, Column]) -> dict[str, Column]:
    """Weighted Jaccard over the fields both sides have: score, coverage, matches, conflicts."""
    zero, none = F.lit(0.0), F.array().cast("array<string>")
    earned, compared, available, matched, against = zero, zero, zero, [], []
    for field, weight in C.TAG_WEIGHTS.items():
        a, b = F.coalesce(own[field], none), F.coalesce(other[field], none)
        both = (F.size(a) > 0) & (F.size(b) > 0)
        shared = F.array_sort(F.array_intersect(a, b))
        available = available + F.when(F.size(a) > 0, weight).otherwise(0.0)
        compared = compared + F.when(both, weight).otherwise(0.0)
        earned = earned + F.when(both, weight * F.size(shared) / F.size(F.array_union(a, b))).otherwise(0.0)
        matched.append(_labelled(shared, field))
        if field in C.EXCLUSIVE_TAGS:
            against.append(F.when(both & (F.size(shared) == 0), F.lit(field)))
    any_ = compared > 0
    return {
        "tag_score": F.when(any_, earned / compared),
        "tag_coverage": F.when(any_, compared / F.greatest(available, F.lit(1e-12))).otherwise(0.0),
        "matched": F.concat(*matched),
        "conflicts": F.array_compact(F.array(*against)),
    }


def feature_pivot(features: DataFrame, key: str) -> DataFrame:
    """(key, pos, category, keyword) rows to one row of tag fields: lists gather all keywords in
    order, of the others the last counts; unknown categories are distinctive features."""
    field = fn.lookup(F.col("category"), C.CATEGORY_FIELDS)
    word = F.when(field.isNull(), F.concat_ws(":", "category", "keyword")).otherwise(F.col("keyword"))
    rows = features.withColumns({"field": F.coalesce(field, F.lit("distinctive_features")), "word": word})
    made = []
    for f in C.TAG_WEIGHTS:
        here = F.col("field") == f
        if f in C.LIST_TAGS:
            all_ = F.sort_array(F.collect_list(F.when(here, F.struct("pos", "word"))))
            made.append(F.transform(all_, lambda s: s["word"]).alias(f))
        else:
            made.append(F.max_by(F.when(here, F.col("word")), F.when(here, F.col("pos"))).alias(f))
    return rows.groupBy(key).agg(*made)


def shown_tags(matched: Column) -> Column:
    """``field:value`` to category -> value, the last of a category; null if there are none."""
    field, value = (lambda x: F.substring_index(x, ":", 1)), (lambda x: F.expr("substring(x, instr(x, ':') + 1)"))
    names = F.create_map(*(F.lit(x) for kv in C.FIELD_CATEGORIES.items() for x in kv))
    last = lambda x, i: ~F.exists(F.slice(matched, i + 2, F.size(matched)), lambda y: field(y) == field(x))
    kept = F.filter(matched, last)
    entries = F.transform(kept, lambda x: F.struct(F.coalesce(F.element_at(names, field(x)), field(x)).alias("k"), F.substr(x, F.instr(x, ":") + 1, F.length(x)).alias("v")))
    return F.when(F.size(matched) > 0, F.map_from_entries(entries))


def conflicting_tags(conflicts: Column) -> Column:
    """Category -> "conflict" of each conflicting field; null if there are none."""
    names = F.create_map(*(F.lit(x) for kv in C.FIELD_CATEGORIES.items() for x in kv))
    entries = F.transform(F.array_distinct(conflicts), lambda x: F.struct(F.coalesce(F.element_at(names, x), x).alias("k"), F.lit("conflict").alias("v")))
    return F.when(F.size(conflicts) > 0, F.map_from_entries(entries))


def text_score(query: Column, candidate: Column) -> Column:
    """How near two texts' vectors are, 0 to 1; null where a side has none."""
    return (fn.clamp(fn.dot(query, candidate), -1.0, 1.0) + 1) / 2


def active_weights(pool: DataFrame, weights: dict[str, float] = C.RERANK_WEIGHTS) -> DataFrame:
    """Weights of a request: of what it has and any candidate of its pool has; they add up to 1.

    Needs has_tags, has_text, has_place (of the query) and the three scores."""
    any_ = lambda c: F.max(F.col(c).isNotNull()).over(Window.partitionBy("request_id"))
    parts = {"image": F.lit(True), "tags": F.col("has_tags") & any_("tag_score"), "text": F.col("has_text") & any_("text_score"), "location": F.col("has_place") & any_("st_score")}
    raw = {k: F.when(on, max(weights[k], 0.0)).otherwise(0.0) for k, on in parts.items()}
    total = raw["image"] + raw["tags"] + raw["text"] + raw["location"]
    pool = pool.withColumns({f"_{k}": v for k, v in raw.items()} | {"_total": total})
    share = {f"w_{k}": F.when(F.col("_total") > 0, F.col(f"_{k}") / F.col("_total")).otherwise(1.0 if k == "image" else 0.0) for k in parts}
    return pool.withColumns(share).drop(*(f"_{k}" for k in parts), "_total")


def rerank(pool: DataFrame, k: int) -> DataFrame:
    """Re-ranks a pool that has all scores; what is missing counts as the image's own score."""
    pool = active_weights(pool)
    image = (F.col("visual") + 1) / 2
    tags = F.when(F.col("tag_score").isNotNull(), F.col("tag_coverage") * F.col("tag_score") + (1 - F.col("tag_coverage")) * image).otherwise(image)
    ranking = F.col("w_image") * image + F.col("w_tags") * tags + F.col("w_text") * F.coalesce("text_score", image) + F.col("w_location") * F.coalesce("st_score", image)
    pool = pool.withColumn("ranking", ranking)
    order = [F.desc("near_duplicate"), F.desc("rank_hash"), F.desc(F.coalesce("ranking", F.lit(-1.0))), F.desc("visual"), F.asc("image_rank")]
    own = Window.partitionBy("request_id").orderBy(*order)
    return pool.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def wire(ranked: DataFrame) -> DataFrame:
    """What a client gets of a match: five places, three for kilometres; unknown types are shelters'."""
    report = F.col("candidate_type") == "REPORT"
    return ranked.select(
        "request_id", "rank", F.when(report, "REPORT").otherwise("SHELTER").alias("candidateType"),
        F.when(~report, F.col("record_id")).alias("desertionNo"), F.when(report, F.col("candidate_report_id")).alias("candidateReportId"),
        F.bround("visual", 5).alias("visualScore"), F.bround("ranking", 5).alias("finalScore"), F.bround("distance_km", 3).alias("distanceKm"),
        F.col("phash_distance").cast("int").alias("phashDistance"), F.col("near_duplicate").alias("nearDuplicate"), F.col("gallery_id").alias("galleryId"),
    )


def backend(ranked: DataFrame) -> DataFrame:
    """What a backend gets of a match, rounded to six places (half-even), kilometres to three."""
    places = {"visual": "visualSimilarity", "tag_score": "tagSimilarity", "tag_coverage": "tagCoverage", "text_score": "textSimilarity", "place_score": "locationSimilarity", "time_score": "timeSimilarity", "st_score": "spatiotemporalSimilarity", "ranking": "rankingScore"}
    return ranked.select(
        "request_id", "rank", F.col("image_rank").alias("imageRank"), F.col("record_id").alias("animalId"), F.col("gallery_id").alias("galleryId"), "species",
        *(F.bround(c, 6).alias(name) for c, name in places.items()), F.bround("distance_km", 3).alias("distanceKm"), F.col("elapsed_days").alias("elapsedDays"), F.col("place_method").alias("locationMethod"),
        F.lit(False).alias("rankingScoreIsProbability"), F.bround(100 * F.greatest(F.col("visual"), F.lit(0.0)), 1).alias("visualDisplayScore"),
        F.lit("AI visual similarity").alias("scoreLabel"), F.lit(False).alias("scoreIsProbability"), F.col("near_duplicate").alias("nearDuplicate"),
        F.col("matched").alias("matchedTags"), F.col("conflicts").alias("conflictingTags"), F.col("image_url").alias("imageUrl"),
    )


def reported(ranked: DataFrame) -> DataFrame:
    """A line of text for each match, as shown on a console."""
    show = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.3f", F.col(c)))
    line = F.format_string("%02d. ID=%s image_rank=%d visual=%s tag=%s text=%s where/when=%s ranking=%s matched=%s", "rank", "record_id", "image_rank", show("visual"), show("tag_score"), show("text_score"), show("st_score"), show("ranking"), F.array_join("matched", ","))
    return ranked.select("request_id", "rank", line.alias("line"))


# What the mock mode answers.
MOCK_MODEL, MOCK_RERANK = "mock-v0", "mock-rerank-v0"
MOCK_ROWS = [
    (1, "445467202601598", "dog:record:0", "https://example.com/animals/445467202601598.jpg", 0.91234, 0.88765, 0.75),
    (2, "445467202601599", "dog:record:1", "https://example.com/animals/445467202601599.jpg", 0.84102, 0.81234, 0.62),
    (3, "445467202601600", "dog:record:2", "https://example.com/animals/445467202601600.jpg", 0.76543, 0.73456, 0.55),
]


def mock(requests: DataFrame) -> DataFrame:
    """The mock mode: three fixed rows for each request (``features``: array of category and
    keyword); the first shows the request's own features, the last keyword of a category."""
    rows = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("rank", "desertionNo", "galleryId", "imageUrl", "visualScore", "finalScore", "tagScore"), row, strict=True))) for row in MOCK_ROWS)))
    last = F.filter("features", lambda x, i: ~F.exists(F.slice("features", i + 2, F.size("features")), lambda y: y["category"] == x["category"]))
    tags = F.when(F.size("features") > 0, F.map_from_entries(F.transform(last, lambda x: F.struct(x["category"], x["keyword"]))))
    out = requests.select("request_id", tags.alias("tags"), rows.alias("m")).select("request_id", "tags", "m.*")
    return out.select(*(c for c in out.columns if c != "tags"), F.lit("SHELTER").alias("candidateType"), F.lit(False).alias("nearDuplicate"), F.when(F.col("rank") == 1, F.col("tags")).alias("matchedTags"), F.lit(DECISIONS[2]).alias("decision"))
