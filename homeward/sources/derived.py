"""The engine's inputs derived from the driver's tables, with expressions that DuckDB has too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward import config as C
from homeward.functions import columns as fn

#: Rows that ask: of a table's ids those divisible by this.
ASK = 50
WORDS = ["흰색, 수컷", "검정/치즈", "삼색 및 단모", "소형 | 미상", "Long-Coat ; 점박이"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "vec_id AS ordinal", "IF(label % 2 = 0, 'dog', 'cat') AS species", "CAST(vec_id DIV 4 AS STRING) AS record_id",
        "IF((vec_id DIV 4) % 3 = 0, 'REPORT', 'SHELTER') AS candidate_type", "IF((vec_id DIV 4) % 3 = 0, vec_id DIV 4, NULL) AS candidate_report_id",
        "concat_ws(':', IF(label % 2 = 0, 'dog', 'cat'), CAST(vec_id DIV 4 AS STRING), CAST(vec_id % 4 AS STRING)) AS gallery_id", "embedding",
        "substr(md5(CAST(vec_id DIV 3 AS STRING)), 1, 16) AS phash_full", "IF(vec_id % 5 = 0, NULL, substr(md5(CAST(vec_id * 31 + 7 AS STRING)), 1, 16)) AS phash_crop",
        "concat('https://img.example/', CAST(vec_id AS STRING)) AS image_url",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gallery(spark, sf_dir).where(F.col("vec_id") % ASK == 0)
    hashes = F.array_compact(F.array(fn.phash_bits(F.col("phash_full")), fn.phash_bits(F.col("phash_crop"))))
    return rows.select(F.col("vec_id").alias("request_id"), F.expr("vec_id DIV 4").alias("report_id"), "species", "embedding", hashes.alias("phashes"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS report_id", "CAST(ts AS DATE) AS event_date", "date_format(ts, 'yyyy.MM.dd') AS date_text", "IF(event_id % 2 = 0, 'LOST', '발견') AS type_text",
        "37.5665D + ((event_id * 7919) % 2000 - 1000) / 5000.0D AS latitude", "126.978D + ((event_id * 104729) % 1999 - 1000) / 5000.0D AS longitude",
        "CASE event_id % 5 WHEN 0 THEN '서울특별시 강남구 역삼동' WHEN 1 THEN '서울특별시 강남구 삼성동' WHEN 2 THEN '경기도 수원시 팔달구 101동' WHEN 3 THEN '서울특별시 중구' ELSE '' END AS address",
    )


def requests(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Search-area requests: a query set of the events, or all of them where they meet nothing."""
    events = table(spark, sf_dir, "events")
    rows = (events if every else events.where(F.col("event_id") % ASK == 0)).selectExpr(
        "event_id AS request_id", "37.5665D + ((event_id * 7919) % 2000 - 1000) / 5000.0D AS latitude", "126.978D + ((event_id * 104729) % 1999 - 1000) / 5000.0D AS longitude",
        "CASE event_id DIV 50 % 3 WHEN 0 THEN '소형' WHEN 1 THEN '중형' ELSE '대형' END AS size", "CAST(1 + event_id DIV 50 % 90 AS DOUBLE) AS hours",
        """named_struct('activityLevel', CASE user_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END,
            'strangerResponse', CASE user_id % 3 WHEN 0 THEN 'APPROACH' WHEN 1 THEN 'AVOID' ELSE 'UNKNOWN' END, 'noiseSensitivity', CASE user_id % 5 WHEN 0 THEN 'HIGH' ELSE 'LOW' END,
            'chaseTendency', CASE user_id % 7 WHEN 0 THEN 'HIGH' ELSE 'LOW' END, 'mobility', CASE user_id % 6 WHEN 0 THEN 'LIMITED' ELSE 'NORMAL' END,
            'escapeCause', CASE user_id % 11 WHEN 0 THEN 'CHASE' WHEN 1 THEN 'NOISE' ELSE 'OTHER' END) AS profile""",
    )
    p = F.col("profile")
    return rows.select(
        "request_id", "latitude", "longitude", fn.search_radius(F.col("size"), F.col("hours"), p).alias("radius"),
        fn.behavior_of(p).alias("behavior"), (F.coalesce(p["mobility"], F.lit("UNKNOWN")) == "LIMITED").alias("limited"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features: all events, each of one or two kinds."""
    kinds = F.array(*map(F.lit, C.KINDS))
    own = F.array_distinct(F.array_compact(F.array(F.get(kinds, (F.col("event_id") % 8).cast("int")), F.when(F.col("event_id") % 3 == 0, F.get(kinds, ((F.col("event_id") + 3) % 8).cast("int"))))))
    place = table(spark, sf_dir, "events").selectExpr("event_id", "37.5665D + ((event_id * 7919) % 2000 - 1000) / 5000.0D + (event_id % 13 - 6) / 9000.0D AS latitude", "126.978D + ((event_id * 104729) % 1999 - 1000) / 5000.0D + (event_id % 17 - 8) / 9000.0D AS longitude")
    return place.select("latitude", "longitude", own.alias("kinds"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag fields of a record, by part key; sets as arrays."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN array('male') WHEN 1 THEN array('female') END AS sex", "array_distinct(split(lower(p_name), ' ')) AS colors",
        "array(lower(p_brand)) AS patterns", "array(CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END) AS size", "array_distinct(split(lower(p_type), ' ')) AS behavior",
    )
