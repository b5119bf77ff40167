"""Free metadata (a VARIANT of unknown keys) to fields: aliases, nested places, tags, descriptions.

Parsed once per row with ``parse_json``; every field is a column expression, so a query that needs
three fields computes three.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeward import config as C
from homeward.functions import columns as fn


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, in Arrow batches: for input that is not known to be in it already."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _path(*keys: str) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def _list(v: Column, *keys: str) -> Column:
    """The value as a list of texts, null if it is none."""
    return F.try_variant_get(v, _path(*keys), "array<string>")


def value(v: Column, *keys: str) -> Column:
    """The value as text: lists blank-joined, nothing as empty."""
    parts = F.filter(F.transform(_list(v, *keys), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.coalesce(F.array_join(parts, " "), F.trim(F.try_variant_get(v, _path(*keys), "string")), F.lit(""))


def first_value(v: Column, keys: list[str], *under: str) -> Column:
    """The first key's value that is not empty."""
    return F.coalesce(*(F.nullif(value(v, *under, k), F.lit("")) for k in keys), F.lit(""))


def tags(v: Column, keys: list[str], names: Column, is_sex: bool) -> Column:
    """Canonical tags of the first key that has a value; a list's items are not split."""
    whole = lambda x: F.filter(F.transform(x, lambda t: fn.canonical_tag(F.trim(F.coalesce(t, F.lit(""))), names, F.lit(is_sex))), lambda t: (t != "") & (t != "unknown"))
    out = F.array().cast("array<string>")
    for k in reversed(keys):
        own = F.coalesce(F.array_distinct(whole(_list(v, k))), fn.split_tags(value(v, k), names, F.lit(is_sex)))
        out = F.when(value(v, k) != "", own).otherwise(out)
    return out


def _is_object(v: Column, key: str) -> Column:
    return F.try_variant_get(v, _path(key), "map<string,variant>").isNotNull()


def nested(v: Column, places: list[str], made) -> Column:
    """What ``made`` finds under the first of ``places`` that is an object; empty without one."""
    out = F.lit("")
    for p in reversed(places):
        out = F.when(_is_object(v, p), made(p)).otherwise(out)
    return out


def _placed(v: Column, keys: dict, field: str) -> Column:
    inner, outer = keys[field]
    here = nested(v, keys["place"], lambda p: first_value(v, inner, p))
    return F.coalesce(F.nullif(here, F.lit("")), first_value(v, outer))


def _number(c: Column) -> Column:
    """A finite number, or null."""
    x = F.nullif(c, F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def query_fields(v: Column, names: Column) -> dict[str, Column]:
    """What a report says of itself."""
    keys = C.QUERY_KEYS
    return {
        "report_type": fn.report_type(first_value(v, keys["report_type"]), "LOST"),
        **{f: tags(v, every, names, f == "sex") for f, every in C.TAG_KEYS.items()},
        "description": first_value(v, keys["description"]),
        "lost_at": first_value(v, keys["lost_at"]),
        "latitude": _number(_placed(v, keys, "latitude")),
        "longitude": _number(_placed(v, keys, "longitude")),
        "address": _placed(v, keys, "address"),
    }


def candidate_fields(v: Column, names: Column, sex: Column | None = None, color: Column | None = None) -> dict[str, Column]:
    """What is known of a candidate; sex and colour fall back to the match's own."""
    keys = C.CANDIDATE_KEYS
    texts = F.array_distinct(F.filter(F.array(*(value(v, k) for k in keys["description"])), lambda x: x != ""))
    out = {
        "report_type": fn.report_type(first_value(v, keys["report_type"]), "FOUND"),
        **{f: tags(v, every, names, f == "sex") for f, every in C.CANDIDATE_TAG_KEYS.items()},
        "description": F.array_join(texts, " "),
        "lost_at": F.lit(""),
        "found_at": first_value(v, keys["found_at"]),
        "latitude": _number(_placed(v, keys, "latitude")),
        "longitude": _number(_placed(v, keys, "longitude")),
        "address": _placed(v, keys, "address"),
    }
    # the first key of either is what a match's own column stands in for
    for field, own in (("sex", sex), ("colors", color)):
        if own is not None:
            first = C.CANDIDATE_TAG_KEYS[field][0]
            has = F.coalesce(F.trim(own), F.lit("")) != ""
            out[field] = F.when((value(v, first) == "") & has, fn.split_tags(own, names, F.lit(field == "sex"))).otherwise(out[field])
    return out


def description(fields: dict[str, Column]) -> Column:
    """The tags of each field under its label, then the free text; "; " between."""
    parts = [F.when(F.size(fields[f]) > 0, F.concat_ws(" ", F.lit(label), F.array_join(fields[f], " "))) for f, label in C.FIELD_LABELS.items()]
    return F.concat_ws("; ", *parts, F.nullif(F.trim(fields["description"]), F.lit("")))


def normalized(df: DataFrame, meta: str, candidate: bool = False, sex: str | None = None, color: str | None = None) -> DataFrame:
    """``df`` with the fields of the JSON text ``meta``; text that is no JSON counts as empty."""
    own = df.withColumn("_meta", F.coalesce(F.try_parse_json(meta), F.parse_json(F.lit("{}"))))
    names = fn.tag_names()
    v = F.col("_meta")
    made = candidate_fields(v, names, sex and F.col(sex), color and F.col(color)) if candidate else query_fields(v, names)
    return own.withColumns(made | {"metadata_text": description(made)}).drop("_meta")
