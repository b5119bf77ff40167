"""Column functions of the engine: text, tags, places, times, vectors. All built in to Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeward import config as C

LEVELS = ("province", "city", "district", "local")


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def first_text(*cs: Column) -> Column:
    """The first that is not blank, else empty."""
    return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in cs), F.lit(""))


def number(c: Column) -> Column:
    return c.try_cast("double")


def lookup(c: Column, values: Mapping[str, object], default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def compact(c: Column) -> Column:
    """Letters and digits only, lower case (input in NFKC)."""
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z가-힣]", ""))


def canonical_tag(c: Column, names: Column, is_sex: Column) -> Column:
    """The canonical name; for sex the first sign decides where the whole has no name."""
    plain = F.upper(F.regexp_replace(c, r"[\s_\-/]", ""))
    short = F.when(is_sex, F.element_at(names, F.substring(plain, 1, 1)))
    return F.coalesce(F.element_at(names, plain), short, F.element_at(names, compact(c)), compact(c))


def tag_names() -> Column:
    pairs = [F.lit(x) for alias, name in C.TAG_ALIASES.items() for x in (alias, name)]
    return F.create_map(*pairs)


def split_tags(c: Column, names: Column, is_sex: Column) -> Column:
    """Canonical tags of a list written as text, without blanks, unknowns and repeats."""
    parts = F.split(text(c), r"[,/|+&·ㆍ;，、]|\s+(?:및|와|과)\s+")
    tags = F.transform(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), lambda x: canonical_tag(x, names, is_sex))
    return F.array_distinct(F.filter(tags, lambda x: (x != "") & (x != "unknown")))


def report_type(c: Column, default: str) -> Column:
    plain = F.upper(compact(text(c)))
    return F.when(plain.isin("LOST", "실종", "찾고있어요"), "LOST").when(plain.isin("FOUND", "SIGHTING", "목격", "발견"), "FOUND").otherwise(default)


def flexible_date(c: Column) -> Column:
    """The first eight digits as a day; null if they are none or fewer."""
    digits = F.regexp_replace(text(c), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return C.EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """On the plane that touches at the mean latitude."""
    north = F.radians(lat2 - lat1) * C.EARTH_M
    east = F.radians(lon2 - lon1) * C.EARTH_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(north * north + east * east)


def offset_lat(lat: Column, north: Column) -> Column:
    return lat + F.degrees(north / C.EARTH_M)


def offset_lon(lat: Column, lon: Column, east: Column) -> Column:
    """At a pole there is no east: the longitude stays."""
    flat = F.cos(F.radians(lat))
    return lon + F.when(F.abs(flat) > 1e-12, F.degrees(east / (C.EARTH_M * flat))).otherwise(0.0)


def valid_point(lat: Column, lon: Column) -> Column:
    """NaN is above all numbers, so it is out of range too."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def address_units(c: Column) -> Column:
    """Names of places in an address, in order, without numbered quarters (input in NFKC)."""
    found = F.regexp_extract_all(text(c), F.lit("[가-힣0-9]+?(?:특별자치도|특별자치시|특별시|광역시|도|시|군|구|읍|면|동|리)"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda u: ~u.rlike("^[0-9]+(동|리)$")))


def address_level(units: Column, level: str) -> Column:
    province = lambda u: u.rlike("(특별자치도|특별자치시|특별시|광역시|도)$")
    city = lambda u: ~province(u) & u.endswith("시")
    district = lambda u: ~province(u) & u.rlike("(군|구)$")
    local = lambda u: ~province(u) & ~u.rlike("(시|군|구)$")
    return F.filter(units, {"province": province, "city": city, "district": district, "local": local}[level])


def address_similarity(a: Column, b: Column) -> Column:
    one, two = address_units(a), address_units(b)
    own = {k: address_level(one, k) for k in LEVELS}
    other = {k: address_level(two, k) for k in LEVELS}
    shared = {k: F.arrays_overlap(own[k], other[k]) for k in LEVELS}
    against = {k: (F.size(own[k]) > 0) & (F.size(other[k]) > 0) & ~shared[k] for k in LEVELS}
    parent = shared["province"] | shared["city"] | shared["district"]
    return (
        F.when((F.size(one) == 0) | (F.size(two) == 0), F.lit(None).cast("double"))
        .when(against["province"], 0.10)
        .when(shared["local"] & parent & ~against["city"] & ~against["district"], 0.90)
        .when(shared["district"] & ~against["city"], 0.70)
        .when(shared["province"] | shared["city"] | shared["local"], 0.40)
        .otherwise(0.10)
    )


def banded(x: Column, bands: list[tuple]) -> Column:
    """The value of the first band whose end is not below ``x``."""
    out = F.lit(bands[-1][1])
    for most, value in reversed(bands[:-1]):
        out = F.when(x <= most, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def elapsed_days(own_type: Column, own_day: Column, other_type: Column, other_day: Column) -> Column:
    """From loss to finding; null if both reports are of one type or a day is not known."""
    days = F.when((own_type == "FOUND") & (other_type == "LOST"), F.datediff(own_day, other_day)).otherwise(F.datediff(other_day, own_day))
    return F.when(own_type != other_type, days)


def location_score(lat1: Column, lon1: Column, lat2: Column, lon2: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Score, km (null without both points) and the method: coordinates before addresses."""
    points = valid_point(lat1, lon1) & valid_point(lat2, lon2)
    km = F.when(points, haversine_km(lat1, lon1, lat2, lon2))
    units = address_similarity(a, b)
    score = F.when(points, F.exp(-km / C.LOCATION_DECAY_KM)).otherwise(units)
    return score, km, F.when(points, "coordinates").when(units.isNotNull(), "address_units").otherwise("unavailable")


def spatiotemporal(place: Column, time: Column) -> Column:
    """Mean of what is known, weighted; null if nothing is."""
    both = C.LOCATION_SHARE * place + C.TIME_SHARE * time
    return F.coalesce(F.when(place.isNotNull() & time.isNotNull(), both / (C.LOCATION_SHARE + C.TIME_SHARE)), place, time)


def phash_bits(hexed: Column) -> Column:
    """16 hex digits as a signed number; anything else is null."""
    return F.when(hexed.rlike("^[0-9a-fA-F]{16}$"), F.conv(hexed, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def photo_index(meta: Column, gallery_id: Column) -> Column:
    """The index in the metadata, else the id's last part if it has three parts or more, else 0."""
    parts = F.split(gallery_id, ":")
    last = F.element_at(parts, -1)
    return F.coalesce(meta, F.when((F.size(parts) >= 3) & last.rlike("^[0-9]+$"), last.try_cast("int")), F.lit(0)).cast("int")


def quality_warnings(detected: Column, confidence: Column, box_ratio: Column, blur: Column, side: Column) -> Column:
    """What may spoil a photo, in a fixed order (fixed values: the warnings shown)."""
    rules = [
        (~detected, "동물을 찾지 못해 원본 전체를 사용함"),
        (detected & (confidence < 0.35), "동물 검출 신뢰도가 낮음"),
        (detected & (box_ratio < 0.04), "사진에서 동물이 너무 작음"),
        (blur < 45, "사진이 흐릴 가능성이 있음"),
        (side < 160, "원본 해상도가 낮음"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in rules)))


def osm_kinds(tags: Column) -> Column:
    """Kinds of a map element, sorted, from its tags."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    rules = {
        "BUILDING_RESIDENTIAL": t("building").isNotNull() | (t("landuse") == "residential"),
        "COMMERCIAL": t("landuse").isin("commercial", "retail") | t("shop").isNotNull(),
        "FOOTPATH": t("highway").isin("footway", "path", "pedestrian", "track"),
        "GREEN_SPACE": t("landuse").isin("forest", "grass", "meadow") | t("leisure").isin("park", "garden"),
        "MAJOR_ROAD": t("highway").isin("motorway", "trunk", "primary", "secondary"),
        "RAILWAY_BARRIER": t("railway").isNotNull() | t("barrier").isin("wall", "fence", "retaining_wall", "city_wall", "hedge", "guard_rail"),
        "ROAD": t("highway").isNotNull() & ~t("highway").isin("footway", "path", "pedestrian", "track", "motorway", "trunk", "primary", "secondary"),
        "WATER": (t("natural") == "water") | t("waterway").isNotNull(),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(kind)) for kind, rule in rules.items())))


def behavior_of(p: Column) -> Column:
    """The behaviour type of a profile (a struct of six strings; a null counts as UNKNOWN)."""
    v = lambda k: F.coalesce(p[k], F.lit("UNKNOWN"))
    return (
        F.when((v("escapeCause") == "CHASE") | (v("chaseTendency") == "HIGH"), "CHASE_DRIVEN")
        .when((v("escapeCause") == "NOISE") | (v("noiseSensitivity") == "HIGH") | (v("strangerResponse") == "AVOID"), "FEARFUL")
        .when(v("strangerResponse") == "APPROACH", "HUMAN_SEEKING")
        .otherwise("ALOOF")
    )


def search_radius(size: Column, hours: Column, p: Column) -> Column:
    base = lookup(size, C.SIZE_RADIUS).cast("double")
    v = lambda k: F.coalesce(p[k], F.lit("UNKNOWN"))
    factor = banded(hours, C.HOUR_FACTORS) * lookup(v("activityLevel"), C.ACTIVITY_FACTORS, F.lit(1.0)) * F.when(v("mobility") == "LIMITED", C.LIMITED_FACTOR).otherwise(1.0)
    cause = F.when(v("escapeCause") == "NOISE", C.NOISE_FACTOR).when(v("escapeCause") == "CHASE", C.CHASE_FACTOR).otherwise(1.0)
    return clamp(F.bround(base * factor * cause, 0), C.LEAST_RADIUS, C.MOST_RADIUS).cast("int")


def event_time(day: Column, hour: Column, now: Column, zone: str = "Asia/Seoul") -> Column:
    """When it happened; without an hour at noon, or now if it is the same day before noon."""
    at = lambda h: F.make_timestamp(F.year(day), F.month(day), F.day(day), h, F.lit(0), F.lit(0), F.lit(zone))
    noon = at(F.lit(12))
    local_day = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(now, F.current_timezone()), zone))
    return F.when(hour.isNotNull(), at(hour)).when((local_day == day) & (now < noon), now).otherwise(noon)


def utc_now() -> Column:
    """The present second as text with its zone, of the query's start."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
