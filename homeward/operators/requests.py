"""What a request must be; those that are not go to a table of their own, with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward import config as C
from homeward.functions import columns as fn


def species(c: Column) -> Column:
    """The species by its Korean name; null for any other."""
    return fn.lookup(c, C.SPECIES)


def profile_of(c: Column) -> Column:
    """A profile (a struct, perhaps null) with UNKNOWN for what it does not say."""
    return F.struct(*(F.coalesce(c[k], F.lit("UNKNOWN")).alias(k) for k in C.PROFILE_VALUES))


def problems(now: Column) -> Column:
    """What is wrong with a search-area request, in order: report_id, species, size, event_date,
    event_hour, latitude, longitude, profile; an event must not be in the future."""
    at = fn.event_time(F.col("event_date"), F.col("event_hour"), now)
    rules = {
        "reportId": F.col("report_id") >= 1,
        "species": F.col("species") == "강아지",
        "size": F.col("size").isin(*C.SIZE_RADIUS),
        "eventDate": F.col("event_date").isNotNull(),
        "eventHour": F.coalesce(F.col("event_hour").between(0, 23), F.col("event_hour").isNull()),
        "latitude": F.col("latitude").between(-90, 90),
        "longitude": F.col("longitude").between(-180, 180),
        **{k: F.coalesce(F.col("profile")[k].isin(*values), F.lit(True)) for k, values in C.PROFILE_VALUES.items()},
    }
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    in_range = F.coalesce(F.col("event_hour").between(0, 23), F.col("event_hour").isNull())
    return F.array_compact(F.array(*bad, F.when(in_range & (at > now), F.lit("future"))))


def judged(requests: DataFrame, now: Column) -> DataFrame:
    """``requests`` with ``problems`` (empty: valid), ``hours`` since the event and whether its hour
    is known or the present one; no row is lost and none stops the others."""
    safe_hour = F.when(F.col("event_hour").between(0, 23), F.col("event_hour"))
    at = fn.event_time(F.col("event_date"), safe_hour, now)
    return requests.withColumns({
        "problems": problems(now),
        "hours": (now.cast("double") - at.cast("double")) / 3600,
        "hour_known": F.col("event_hour").isNotNull(),
        "from_now": F.col("event_hour").isNull() & (at == now),
    })


def valid(judged: DataFrame) -> DataFrame:
    return judged.where(F.size("problems") == 0).drop("problems")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.size("problems") > 0)


def prepared(judged: DataFrame) -> DataFrame:
    """Valid requests as search areas need them: radius, behaviour, mobility."""
    rows = valid(judged).withColumn("profile", F.when(F.col("profile").isNotNull(), F.col("profile")))
    p = profile_of(F.col("profile"))
    return rows.select(
        F.col("report_id").alias("request_id"), "latitude", "longitude", fn.search_radius(F.col("size"), F.col("hours"), p).alias("radius"),
        fn.behavior_of(p).alias("behavior"), (p["mobility"] == "LIMITED").alias("limited"), "hour_known", "from_now",
    )


def photo_requests(rows: DataFrame, any_species: bool) -> DataFrame:
    """Requests to embed photos: urls trimmed, blank ones dropped, species lower-cased; ``problem``
    names what is missing. Only animals' species is checked (``any_species`` False)."""
    urls = F.filter(F.transform("photo_urls", lambda u: F.trim(u)), lambda u: u != "")
    kind = F.lower(F.trim("species"))
    wrong = F.when(F.size(urls) == 0, "photoUrls").when(F.lit(not any_species) & ~F.coalesce(kind.isin("dog", "cat"), F.lit(False)), "species")
    return rows.withColumns({"photo_urls": urls, "species": kind, "problem": wrong})
