"""Map answers (JSON of elements) to features, and the question they answer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward import config as C
from homeward.functions import columns as fn

POINT = "struct<lat:double,lon:double>"
ELEMENTS = f"struct<elements:array<struct<lat:double,lon:double,center:{POINT},tags:map<string,string>>>>"


def question(lat: Column, lon: Column, radius: Column, timeout: float = 10.0) -> Column:
    """What a map service is asked for around a point, at most the largest search radius."""
    around = F.format_string("(around:%d,%s,%s);", F.least(radius, F.lit(C.MOST_RADIUS)).cast("int"), lat.cast("string"), lon.cast("string"))
    kinds = ['"building"', '"landuse"', '"leisure"', f'"highway"~"^({"|".join(C.MAP_HIGHWAYS)})$"', '"natural"="water"', '"waterway"', '"railway"', '"barrier"']
    parts = [x for k in kinds for x in (F.lit(f"nwr[{k}]"), around)]
    return F.concat(F.lit(f"[out:json][timeout:{max(1, math.floor(timeout))}][maxsize:{C.MAP_MAX_BYTES}];("), *parts, F.lit(");out center tags;"))


def features(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each element that has a point, tags and a kind; an area's centre is its point.

    ``answers`` has request_id and the payload as text. What is no element is skipped."""
    parsed = answers.select("request_id", F.from_json(payload, ELEMENTS).alias("a")).select("request_id", F.explode("a.elements").alias("e"))
    at = parsed.select("request_id", F.coalesce("e.center.lat", "e.lat").alias("latitude"), F.coalesce("e.center.lon", "e.lon").alias("longitude"), fn.osm_kinds(F.col("e.tags")).alias("kinds"))
    return at.where("latitude IS NOT NULL AND longitude IS NOT NULL AND size(kinds) > 0")


def failed(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Requests whose map could not be had: no answer, a damaged or an empty one."""
    return answers.select("request_id").distinct().join(found.select("request_id").distinct(), "request_id", "left_anti")
