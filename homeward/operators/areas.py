"""Search areas: grids, the join of cells and map features, two scorers, clusters, selection.

A batch of requests is worked on at once; ``request_id`` is part of every key. Requests have
request_id, latitude, longitude, radius, behavior and limited (mobility). Features have latitude,
longitude, kinds, and request_id where each request has a map of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from homeward import config as C
from homeward.functions import columns as fn

CELL = ["request_id", "row", "col"]


def grid(requests: DataFrame, cell: int = C.GRID_M) -> DataFrame:
    """The cells within each request's radius; row and col count from the centre."""
    n = F.ceil(F.col("radius") / cell).cast("int")
    rows = requests.select("*", F.explode(F.sequence(-n, n)).alias("row")).select("*", F.explode(F.sequence(-n, n)).alias("col"))
    north, east = F.col("row") * cell, F.col("col") * cell
    rows = rows.withColumn("distance_m", F.sqrt((north * north + east * east).cast("double"))).where("distance_m <= radius")
    return rows.withColumns({"lat": fn.offset_lat(F.col("latitude"), north), "lon": fn.offset_lon(F.col("latitude"), F.col("longitude"), east)})


def _band(row: Column, lon: Column) -> Column:
    """The bucket column of a longitude in a band of latitude ``row``."""
    scale = F.cos((row + 0.5) * C.BUCKET_M / C.EARTH_M)
    return F.floor(F.radians(lon) * C.EARTH_M * scale / C.BUCKET_M).cast("long")


def near(cells: DataFrame, features: DataFrame, influence: int = C.INFLUENCE_M) -> DataFrame:
    """Pairs of a cell and a feature within ``influence`` metres (at most the bucket's size).

    A range join as an equi-join: a cell is in one bucket, a feature is sent to the buckets of
    the cells it may reach, and the distance decides. No pair is made twice; what moves is a few
    rows for each feature, and dense buckets are split by adaptive execution. Neither side is
    broadcast: Catalyst's sizes do not count what explode adds (15 rows for a feature)."""
    if influence > C.BUCKET_M:
        raise ValueError("a feature reaches neighbouring buckets only")
    row = lambda lat: F.floor(F.radians(lat) * C.EARTH_M / C.BUCKET_M).cast("long")
    left = cells.withColumn("brow", row(F.col("lat"))).withColumn("bcol", _band(F.col("brow"), F.col("lon")))
    own = ["request_id"] if "request_id" in features.columns else []
    right = features.select(*own, F.col("latitude").alias("f_lat"), F.col("longitude").alias("f_lon"), "kinds")
    right = right.withColumn("brow", F.explode(F.sequence(row(F.col("f_lat")) - 1, row(F.col("f_lat")) + 1)))
    right = right.withColumn("bcol", F.explode(F.sequence(_band(F.col("brow"), F.col("f_lon")) - 2, _band(F.col("brow"), F.col("f_lon")) + 2)))
    pairs = left.join(right.hint("merge"), [*own, "brow", "bcol"])
    pairs = pairs.withColumn("away_m", fn.distance_m(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")))
    return pairs.where(F.col("away_m") <= influence).drop("brow", "bcol")


def _tiled(cells: DataFrame, features: DataFrame, influence: int) -> tuple[DataFrame, DataFrame]:
    """``cells`` with the tile they are in (``trow``, ``tcol``), and features in each tile they reach:
    latitude, longitude, and ``bits`` for their kinds."""
    row = lambda lat, more=0: F.floor((F.radians(lat) * C.EARTH_M + more) / C.TILE_M).cast("long")
    scale = F.abs(F.cos((F.col("trow") + 0.5) * C.TILE_M / C.EARTH_M))
    left = cells.withColumn("trow", row(F.col("lat"))).withColumn("tcol", F.floor(F.radians("lon") * C.EARTH_M * scale / C.TILE_M).cast("long"))
    bits = sum((F.when(F.array_contains("kinds", k), 1 << i).otherwise(0) for i, k in enumerate(C.KINDS)), F.lit(0)).cast("int")
    reach = influence + 1.0  # a metre for what rounding does
    right = features.select("latitude", "longitude", bits.alias("bits")).where("bits > 0")
    right = right.withColumn("trow", F.explode(F.sequence(row(F.col("latitude"), -reach), row(F.col("latitude"), reach))))
    # the widest that ``influence`` can be in longitude: half-way to the cell, on the side of the pole
    flat = F.cos(F.least(F.lit(math.pi / 2), F.abs(F.radians("latitude")) + reach / 2 / C.EARTH_M))
    wide = F.least(F.lit(2 * math.pi), reach / C.EARTH_M / F.greatest(F.lit(1e-12), flat))
    col = lambda more: F.floor((F.radians("longitude") + more) * C.EARTH_M * scale / C.TILE_M).cast("long")
    right = right.withColumn("tcol", F.explode(F.sequence(col(-wide), col(wide))))
    return left, right


def _sides(rows: np.ndarray, cols: np.ndarray, reach: float) -> list[float]:
    """Sides of buckets, each twice the one before, for points at ``rows`` and ``cols`` (metres from
    0 on): first so that a point shares its bucket with few others, at last ``reach``."""
    most = max(rows.max(), cols.max(), 1.0)
    side = reach
    while side > 1 and (most / side + 1) ** 2 < 1e6:
        n = np.bincount((rows // side).astype(np.int64) * int(most // side + 1) + (cols // side).astype(np.int64))
        if (n.astype(float) ** 2).sum() <= 2 * len(rows):
            break
        side /= 2
    out = [side]
    while out[-1] < reach:
        out.append(out[-1] * 2)
    return out


def _nearest(lat: np.ndarray, lon: np.ndarray, f_lat: np.ndarray, f_lon: np.ndarray, influence: float, most: int = 1 << 15) -> np.ndarray:
    """Metres from each place to the nearest feature, infinite beyond ``influence``.

    Buckets from fine to coarse: what is found within a bucket's side in the nine buckets around a
    place is the nearest there is, and only places without it are looked at with the next side. So the
    work follows the number of places and of features, not of pairs. ``most`` pairs are held at once."""
    best = np.full(len(lat), np.inf)
    known = np.isfinite(f_lat) & np.isfinite(f_lon)
    f_lat, f_lon = np.unique(np.stack((f_lat[known], f_lon[known])), axis=1) if known.any() else (f_lat[:0], f_lon[:0])
    open_ = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    if not len(f_lat) or not len(open_):
        return best
    # at the least cosine of all, no distance in longitude is longer than it is
    flat = max(0.0, float(np.cos(np.radians(max(np.abs(lat[open_]).max(), np.abs(f_lat).max())))))
    south, west = f_lat.min(), f_lon.min()
    metres = lambda a, o: (np.radians(a - south) * C.EARTH_M, np.radians(o - west) * C.EARTH_M * flat)
    f_y, f_x = metres(f_lat, f_lon)
    y, x = metres(lat, lon)
    turn, half = np.cos(np.radians(lat)), np.sin(np.radians(lat)) / 2
    for side in _sides(f_y, f_x, influence + 0.001):
        rows, cols = int(f_y.max() / side) + 1, int(f_x.max() / side) + 1
        at = np.floor(f_y / side).astype(np.int64) * cols + np.floor(f_x / side).astype(np.int64)
        order = np.argsort(at, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=rows * cols))))
        s_lat, s_lon = f_lat[order], f_lon[order]
        r = np.clip(np.floor(y[open_] / side), -2, rows + 1).astype(np.int64)
        c = np.clip(np.floor(x[open_] / side), -2, cols + 1).astype(np.int64)
        begin, end = np.clip(c - 1, 0, cols), np.clip(c + 2, 0, cols)
        first, n = np.empty((len(open_), 3), np.int64), np.empty((len(open_), 3), np.int64)
        for k in range(3):
            inside = (r + k > 0) & (r + k <= rows)
            line = np.where(inside, r + k - 1, 0) * cols
            first[:, k] = start[line + begin]
            n[:, k] = (start[line + end] - first[:, k]) * inside
        each = n.sum(axis=1)
        ends = np.cumsum(each)
        i = 0
        while i < len(open_):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            some = each[i:j] > 0
            who, much = open_[i:j][some], each[i:j][some]
            if len(who):
                lengths = n[i:j].ravel()
                pick = np.repeat(first[i:j].ravel() - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                of = np.repeat(np.arange(len(who)), much)
                north = np.radians(s_lat[pick] - lat[who][of])
                # the cosine half-way, by its series: what it leaves out is under 1e-14 of it
                flats = turn[who][of]
                east = np.radians(s_lon[pick] - lon[who][of]) * (flats - north * (half[who][of] + north * flats / 8))
                best[who] = np.sqrt(np.minimum.reduceat(north * north + east * east, np.cumsum(much) - much)) * C.EARTH_M
            i = j
        open_ = open_[best[open_] > side - 1e-6]
        if not len(open_):
            break
    best[best > influence] = np.inf
    return best


def with_strengths(cells: DataFrame, features: DataFrame, influence: int = C.INFLUENCE_M) -> DataFrame:
    """All cells, and for each kind how close its nearest feature is (1 at the cell, 0 at the
    reach, null beyond). Both scorers use this one join.

    Where all requests share one map, the cells of a tile meet the features that reach it, in one
    group; only the nearest of a kind is looked for, so no pairs are made."""
    if "request_id" in features.columns:
        strength = F.greatest(F.lit(0.0), 1 - F.col("away_m") / influence)
        best = [F.max(F.when(F.array_contains("kinds", k), strength)).alias(k) for k in C.KINDS]
        found = near(cells, features, influence).groupBy(*CELL).agg(*best)
        return cells.join(found, CELL, "left")

    def run(places: pa.Table, found: pa.Table) -> pa.Table:
        flat = lambda t, name: t.column(name).to_numpy()
        lat, lon = flat(places, "lat").astype(float), flat(places, "lon").astype(float)
        f_lat, f_lon, bits = flat(found, "latitude"), flat(found, "longitude"), flat(found, "bits")
        out = places.drop_columns(["trow", "tcol"])
        for i, k in enumerate(C.KINDS):
            own = bits.astype(np.int64) & (1 << i) > 0
            away = _nearest(lat, lon, f_lat[own].astype(float), f_lon[own].astype(float), influence)
            out = out.append_column(k, pa.array(np.maximum(0.0, 1 - away / influence), mask=np.isinf(away)))
        return out

    left, right = _tiled(cells, features, influence)
    schema = StructType([*cells.schema.fields, *(StructField(k, DoubleType()) for k in C.KINDS)])
    return left.groupBy("trow", "tcol").cogroup(right.groupBy("trow", "tcol")).applyInArrow(run, schema)


def _best(values: dict[str, float], of) -> Column:
    return F.greatest(F.lit(0.0), *(F.coalesce(of(k) * v, F.lit(0.0)) for k, v in values.items()))


def _by_behavior(made) -> Column:
    out = F.lit(0.0)
    for name, values in C.PREFERENCES.items():
        out = F.when(F.col("behavior") == name, made(values)).otherwise(out)
    return out


def _total() -> Column:
    out = None
    for name, weight in C.PARTS.items():
        out = F.col(name) * weight if out is None else out + F.col(name) * weight
    return fn.clamp(100 * out, 0.0, 100.0)


def score_v1(cells: DataFrame) -> DataFrame:
    """Presence of kinds: preferences of the best one, defaults only where there is none at all."""
    has = lambda k: F.col(k).isNotNull()
    here = lambda k: F.when(has(k), F.lit(1.0))
    none = F.coalesce(*(F.col(k) for k in C.KINDS)).isNull()
    penalty = sum((F.when(has(k), v).otherwise(0.0) for k, v in C.PENALTIES.items()), F.lit(0.0))
    b = F.col("behavior")
    context = (
        F.lit(0.5)
        + F.when((b == "FEARFUL") & ~has("MAJOR_ROAD"), 0.3)
        .when((b == "CHASE_DRIVEN") & has("FOOTPATH"), 0.3)
        .when((b == "HUMAN_SEEKING") & (has("COMMERCIAL") | has("BUILDING_RESIDENTIAL")), 0.3)
        .when((b == "ALOOF") & has("GREEN_SPACE"), 0.2)
        .otherwise(0.0)
        - F.when(F.col("limited") & has("RAILWAY_BARRIER"), 0.3).otherwise(0.0)
    )
    parts = {
        "distance": fn.clamp(1 - F.col("distance_m") / F.col("radius"), 0.0, 1.0),
        "behavior_environment": F.when(none, 0.2).otherwise(_by_behavior(lambda v: _best(v, here))),
        "corridor": F.when(none, 0.1).otherwise(_best(C.CORRIDORS, here)),
        "accessibility": fn.clamp(1 - penalty, 0.0, 1.0),
        "event_context": fn.clamp(context, 0.0, 1.0),
    }
    kinds = F.array_compact(F.array(*(F.when(has(k), F.lit(k)) for k in C.KINDS)))
    out = cells.withColumns(parts).withColumns({"score": _total(), "near_kinds": kinds})
    return out.withColumns({"behavior_kind": F.lit(None).cast("string"), "corridor_kind": F.lit(None).cast("string")})


def score_v2(cells: DataFrame) -> DataFrame:
    """Closeness of kinds: preference times strength, and which kind won."""
    s = lambda k: F.coalesce(F.col(k), F.lit(0.0))

    def winner(values: dict[str, float]) -> Column:
        best = _best(values, s)
        out = F.lit(None).cast("string")
        for k in sorted(values, reverse=True):  # of equal ones the first by name
            out = F.when((s(k) * values[k] == best) & (best > 0), k).otherwise(out)
        return out

    penalty = sum((s(k) * v for k, v in sorted(C.PENALTIES.items())), F.lit(0.0))
    b = F.col("behavior")
    context = (
        F.lit(0.5)
        + F.when(b == "FEARFUL", 0.3 * (1 - s("MAJOR_ROAD")))
        .when(b == "CHASE_DRIVEN", 0.3 * s("FOOTPATH"))
        .when(b == "HUMAN_SEEKING", 0.3 * F.greatest(s("COMMERCIAL"), s("BUILDING_RESIDENTIAL")))
        .when(b == "ALOOF", 0.2 * s("GREEN_SPACE"))
        .otherwise(0.0)
        - F.when(F.col("limited"), 0.3 * s("RAILWAY_BARRIER")).otherwise(0.0)
    )
    kind = F.lit(None).cast("string")
    for name, values in C.PREFERENCES.items():
        kind = F.when(b == name, winner(values)).otherwise(kind)
    parts = {
        "distance": fn.clamp(1 - F.col("distance_m") / F.col("radius"), 0.0, 1.0),
        "behavior_environment": F.least(F.lit(1.0), _by_behavior(lambda v: _best(v, s))),
        "corridor": F.least(F.lit(1.0), _best(C.CORRIDORS, s)),
        "accessibility": F.greatest(F.lit(0.0), 1 - penalty),
        "event_context": fn.clamp(context, 0.0, 1.0),
        "behavior_kind": kind,
        "corridor_kind": winner(C.CORRIDORS),
    }
    kinds = F.array_compact(F.array(*(F.when(s(k) > 0, F.lit(k)) for k in C.KINDS)))
    return cells.withColumns(parts).withColumns({"score": _total(), "near_kinds": kinds})


def eligible(scored: DataFrame) -> DataFrame:
    """Cells near the best score of their request and not under the floor (to 9 places)."""
    top = F.max(F.round("score", 9)).over(Window.partitionBy("request_id"))
    return scored.withColumn("threshold", F.greatest(F.lit(float(C.SCORE_FLOOR)), top - C.SCORE_BAND)).where(F.round("score", 9) >= F.col("threshold"))


def _clusters(keys: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Groups of neighbouring cells (corners count), from the least key on."""
    left, out = set(keys), []
    for seed in sorted(keys):
        if seed not in left:
            continue
        left.discard(seed)
        own, stack = [], [seed]
        while stack:
            r, c = stack.pop()
            own.append((r, c))
            for k in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if k in left:
                    left.discard(k)
                    stack.append(k)
        out.append(sorted(own))
    return out


def clusters(cells: DataFrame) -> DataFrame:
    """``cluster_row`` and ``cluster_col``, the least cell of a cell's cluster. A request's cells
    (a few hundred: their number is bounded by the largest radius) are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(pdf.request_id.iloc[0]), r, c, *own[0]) for own in _clusters(list(zip(pdf.row, pdf.col, strict=True))) for r, c in own]
        return pd.DataFrame(rows, columns=[*CELL, "cluster_row", "cluster_col"])

    return cells.select(*CELL).groupBy("request_id").applyInPandas(run, "request_id long, row int, col int, cluster_row int, cluster_col int")


def candidates(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One area for each cluster: score-weighted centre, radius by size, rounded mean score."""
    joined = cells.join(labels, CELL)
    s = F.col("score")
    out = joined.groupBy("request_id", "cluster_row", "cluster_col").agg(
        (F.sum(F.col("lat") * s) / F.sum(s)).alias("lat"),
        (F.sum(F.col("lon") * s) / F.sum(s)).alias("lon"),
        F.count("*").alias("n_cells"),
        F.round(F.avg("score"), 9).alias("mean_score"),
        *(F.avg(p).alias(p) for p in C.PARTS),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_kinds")))).alias("near_kinds"),
    )
    radius = fn.clamp(F.bround(C.CLUSTER_BASE_M + C.GRID_M * F.sqrt(F.col("n_cells").cast("double")) / 2, 0), C.LEAST_AREA, C.MOST_AREA)
    return out.withColumns({"radius_m": radius.cast("int"), "priority": F.bround("mean_score", 0).cast("int")})


def largest_remainder(areas: DataFrame, key: list[str]) -> DataFrame:
    """Whole-number contributions of the parts that add up to ``priority``; one row for each part."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("part"), F.round(F.col(p) * w * 100, 9).alias("value")) for i, (p, w) in enumerate(C.PARTS.items()))))
    rows = areas.select(*key, "priority", parts.alias("p")).select(*key, "priority", "p.*").withColumn("whole", F.floor("value").cast("int"))
    left = F.col("priority") - F.sum("whole").over(Window.partitionBy(*key))
    order = Window.partitionBy(*key).orderBy(F.round(F.col("value") - F.col("whole"), 9).desc(), "place")
    return rows.withColumn("left", left).withColumn("points", (F.col("whole") + (F.row_number().over(order) <= F.col("left")).cast("int")).cast("int")).drop("whole", "left")


def _distance(a: tuple[float, float], b: tuple[float, float]) -> float:
    middle = math.radians((a[0] + b[0]) / 2)
    return math.hypot(math.radians(b[0] - a[0]) * C.EARTH_M, math.radians(b[1] - a[1]) * C.EARTH_M * math.cos(middle))


AREAS = "request_id long, rank int, lat double, lon double, radius_m int, priority int, near_kinds array<string>, n_cells int, " + ", ".join(f"{p} int" for p in C.PARTS) + ", codes array<string>, reason string, behavior string"
#: The kind that won in a cell, and the part it won for.
WINNERS = {"behavior_kind": "behavior_environment", "corridor_kind": "corridor"}


def _shares(means: dict[str, float], priority: int) -> tuple[dict[str, float], dict[str, int]]:
    """What each part adds to the score, and in whole numbers that add up to ``priority``."""
    values = {p: round(means[p] * w * 100, 9) for p, w in C.PARTS.items()}
    points = {p: math.floor(v) for p, v in values.items()}
    for p in sorted(values, key=lambda p: -round(values[p] - points[p], 9))[: priority - sum(points.values())]:
        points[p] += 1
    return values, points


def _apart(found: Iterable[dict], most: int) -> list[dict]:
    kept: list[dict] = []
    for a in found:
        if all(_distance(a["at"], b["at"]) >= C.OVERLAP * (a["radius"] + b["radius"]) for b in kept):
            kept.append(a)
        if len(kept) == most:
            break
    return kept


def _labels(request: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each cell the place of its cluster's least cell among cells in order of request, row and
    col. Runs of cells side by side are joined with those of the row before that they touch."""
    n = len(request)
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (request[1:] != request[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [n])) - 1
    same = np.concatenate(([True], request[first[1:]] != request[first[:-1]]))
    owner, rows, begin, end, new = np.cumsum(same).tolist(), row[first].tolist(), col[first].tolist(), col[last].tolist(), same.tolist()
    root = list(range(len(owner)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    j = 0
    for i in range(len(owner)):
        if new[i]:
            j = i
        while j < i and (rows[j] < rows[i] - 1 or rows[j] == rows[i] - 1 and end[j] < begin[i] - 1):
            j += 1
        k = j
        while k < i and rows[k] == rows[i] - 1 and begin[k] <= end[i] + 1:
            p, q = top(k), top(i)
            if p != q:
                root[max(p, q)] = min(p, q)
            k += 1
    return first[np.array([top(i) for i in range(len(owner))])][np.cumsum(fresh) - 1]


def _chosen(cells: dict[str, np.ndarray], improved: bool) -> list[tuple]:
    """Rows of AREAS for the cells of some requests, in order of request, row and col.

    Clusters by score, each kept if it overlaps none kept before; where fewer than two remain,
    the best single cells instead. Only cells that may be members are looked at, single cells
    only until two are kept."""
    ids, lat, lon = cells["request_id"], cells["lat"], cells["lon"]
    begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    sizes = np.diff(np.concatenate((begin, [len(ids)])))
    score = np.round(cells["score"], 9)
    line = np.maximum(C.SCORE_FLOOR, np.maximum.reduceat(score, begin) - C.SCORE_BAND)
    open_ = np.flatnonzero(score >= np.repeat(line, sizes))
    group, cluster = np.unique(_labels(ids[open_], cells["row"][open_], cells["col"][open_]), return_inverse=True)
    of = lambda name: cells[name][open_]
    total = lambda values: np.bincount(cluster, values, len(group))
    n, s = np.bincount(cluster, minlength=len(group)), total(of("score"))
    middle = list(zip((total(of("lat") * of("score")) / s).tolist(), (total(of("lon") * of("score")) / s).tolist(), strict=True))
    radius = np.clip(np.rint(C.CLUSTER_BASE_M + C.GRID_M * np.sqrt(n) / 2), C.LEAST_AREA, C.MOST_AREA).astype(int).tolist()
    priority = np.rint(np.round(s / n, 9)).astype(int).tolist()
    means = {p: (total(of(p)) / n).tolist() for p in C.PARTS}
    bits = np.zeros(len(group), np.int64)
    np.bitwise_or.at(bits, cluster, of("bits"))
    won = {}
    if improved:
        for kind, part in WINNERS.items():  # who wins does so with more than 0
            at = np.bincount(cluster * (len(C.KINDS) + 1) + of(kind), of(part), len(group) * (len(C.KINDS) + 1))
            won[kind] = at.reshape(-1, len(C.KINDS) + 1).tolist()
    bounds = np.searchsorted(ids[open_][group], ids[begin], "left").tolist() + [len(group)] if len(group) else [0] * (len(begin) + 1)

    def grouped(i: int) -> dict:
        """With one row for each kind that won in member cells, and what it won in all."""
        winners = []
        for kind, part in WINNERS.items() if improved else ():
            for k, name in enumerate(C.KINDS, 1):
                if won[kind][i][k] > 0:
                    winners.append(SimpleNamespace(**(dict.fromkeys(WINNERS) | {kind: name, part: won[kind][i][k]})))
        return {"n": int(n[i]), "bits": int(bits[i]), "means": {p: means[p][i] for p in C.PARTS}, "members": winners}

    def single(i: int) -> dict:
        winner = {kind: (None, *C.KINDS)[cells[kind][i]] for kind in WINNERS} if improved else {}
        parts = {p: float(cells[p][i]) for p in C.PARTS}
        return {"n": 1, "bits": int(cells["bits"][i]), "means": parts, "members": [SimpleNamespace(**winner, **parts)]}

    rows = []
    for k, a in enumerate(begin.tolist()):
        own = sorted(range(bounds[k], bounds[k + 1]), key=lambda i: (-priority[i], *middle[i]))
        kept, whole = _apart(({"at": middle[i], "radius": radius[i], "priority": priority[i], "i": i} for i in own), C.MOST_AREAS), grouped
        if len(kept) < C.LEAST_AREAS:
            best = a + np.argsort(-score[a : a + sizes[k]], kind="stable")
            kept, whole = _apart(({"at": (float(lat[i]), float(lon[i])), "radius": C.LEAST_AREA, "priority": round(float(score[i])), "i": i} for i in best), C.LEAST_AREAS), single
        request, behavior = int(ids[a]), cells["behavior"][k]
        for rank, area in enumerate(kept, 1):
            area |= whole(area["i"])
            area["kinds"] = sorted(kind for j, kind in enumerate(C.KINDS) if area["bits"] >> j & 1)
            area["values"], area["points"] = _shares(area["means"], area["priority"])
            codes, text = evidence(area, behavior) if improved else (reason_codes(behavior, area["kinds"]), plain_reason(behavior, area["kinds"]))
            rows.append((request, rank, round(area["at"][0], 6), round(area["at"][1], 6), area["radius"], area["priority"], area["kinds"], area["n"], *(area["points"][p] for p in C.PARTS), codes, text, behavior))
    return rows


def _needed(scored: DataFrame, improved: bool, tag: str = "") -> list[Column]:
    """What selection needs of scored cells: kinds as bits, and as numbers (0: none) those that won."""
    near = lambda k: F.coalesce(F.col(k), F.lit(0.0)) > 0 if improved else F.col(k).isNotNull()
    bits = sum((F.when(near(k), 1 << i).otherwise(0) for i, k in enumerate(C.KINDS)), F.lit(0)).cast("int")
    won = [fn.lookup(scored[w], {k: i for i, k in enumerate(C.KINDS, 1)}, F.lit(0)).cast("int").alias(w + tag) for w in WINNERS if improved]
    return [scored["score"].alias("score" + tag), bits.alias("bits" + tag), *won, *(scored[p].alias(p + tag) for p in C.PARTS)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole requests, of batches in order of ``request_id``."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("request_id").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        if kept and kept[-1].column("request_id")[-1].as_py() != ids[-1] or cut:
            if head := [*kept, *([b.slice(0, cut)] if cut else [])]:
                yield pa.Table.from_batches(head)
            kept = []
        kept.append(b.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _by_request(cells: DataFrame, versions: dict[int, str], numbered: bool) -> DataFrame:
    """Rows of AREAS (after ``version`` if ``numbered``) for cells with what selection needs under each version's
    tag. All cells of a request are in one task; a task works on many requests at once."""
    out = StructType.fromDDL(("version int, " if numbered else "") + AREAS)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            every = {c: t.column(c).to_numpy() for c in t.column_names if c != "behavior"}
            ids = every["request_id"]
            begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            every["behavior"] = t.column("behavior").take(pa.array(begin)).to_pylist()
            rows = []
            for v, tag in versions.items():
                own = {c.removesuffix(tag) if tag else c: x for c, x in every.items() if not tag or c.endswith(tag) or c in (*CELL, "lat", "lon", "behavior")}
                rows += [(v, *r) if numbered else r for r in _chosen(own, v == 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return cells.repartition("request_id").sortWithinPartitions(*CELL).mapInArrow(run, out)


def select(scored: DataFrame, improved: bool) -> DataFrame:
    """Two or three areas of each request, in order, with their points, reason codes and sentence.

    Each choice depends on those before, and a request has some hundred cells at most, so a
    request is in one task."""
    return _by_request(scored.select(*CELL, "lat", "lon", "behavior", *_needed(scored, improved)), {2 if improved else 1: ""}, False)


def select_both(cells: DataFrame) -> DataFrame:
    """The areas of both versions (``version`` 1 and 2) from one set of strengths, in one pass."""
    one = score_v1(cells)
    both = score_v2(one.select(*cells.columns, *_needed(one, False, "_1")))
    return _by_request(both.select(*CELL, "lat", "lon", "behavior", *(f"{c}_1" for c in ("score", "bits", *C.PARTS)), *_needed(both, True, "_2")), {1: "_1", 2: "_2"}, True)


# Reason codes and the sentences shown with them.
BEHAVIOR_CODES = {"FEARFUL": "FEARFUL_HIDE", "CHASE_DRIVEN": "CHASE_ROUTE", "HUMAN_SEEKING": "HUMAN_CONTACT", "ALOOF": "ALOOF_ROAMING"}
KIND_CODES = {"GREEN_SPACE": "GREEN_SPACE", "FOOTPATH": "WALKING_CORRIDOR", "WATER": "WATERSIDE_CORRIDOR", "BUILDING_RESIDENTIAL": "RESIDENTIAL_SHELTER"}
BEHAVIOR_PHRASES = {"FEARFUL": "두려움이 강한 행동 특성", "CHASE_DRIVEN": "추격 성향과 이동 경로", "HUMAN_SEEKING": "사람에게 접근하는 행동 특성", "ALOOF": "독립적으로 이동하는 행동 특성"}
PLACE_PHRASES = {"GREEN_SPACE": "주변 녹지와 이동 가능 경로", "FOOTPATH": "보행로와 연결된 이동 경로", "BUILDING_RESIDENTIAL": "주거지 주변 은신 가능 공간"}
PLAIN_PHRASE = "주변 환경과 접근성"
FALLBACK_AREAS = [
    (50, ["ENVIRONMENT_FALLBACK", "LAST_SEEN_LOCATION"], "환경 데이터를 사용할 수 없어 마지막 목격 위치 주변을 우선 수색 영역으로 제안합니다."),
    (40, ["ENVIRONMENT_FALLBACK", "EXPANDED_SEARCH_RADIUS"], "환경 데이터를 사용할 수 없어 마지막 목격 위치 주변으로 범위를 넓힌 확장 수색 영역입니다."),
]
# What the improved version says of its evidence.
KIND_LABELS = {"GREEN_SPACE": "녹지", "FOOTPATH": "보행로", "WATER": "수변", "ROAD": "일반 도로", "COMMERCIAL": "상업 시설", "BUILDING_RESIDENTIAL": "주거 건물"}
BEHAVIOR_LABELS = {"FEARFUL": "두려움 관련 행동 특성", "CHASE_DRIVEN": "추격 성향", "HUMAN_SEEKING": "사람에게 접근하는 행동 특성", "ALOOF": "독립적으로 이동하는 행동 특성"}
DISTANCE_SENTENCE = "실종 위치와의 거리가 우선점수에 반영되었습니다."
NEAR_SENTENCE = "{behavior}을 고려한 {what}에 구성 격자와 {kind} 대표점의 가까운 거리가 반영되었습니다."
BEHAVIOR_PART, CORRIDOR_PART = "행동·환경 적합도", "이동 통로 관련 점수"
BARRIER_SENTENCE = "도로·장벽 대표점과의 거리에 따른 감점을 반영했습니다. 실제 통과 가능 여부를 판단한 결과는 아닙니다."
LIMITED_SENTENCE = "주변 환경에 관한 추천 근거가 제한적입니다."
LAST_SENTENCE = "우선 수색을 위한 참고 정보입니다."
# What an answer assumes, and its summary.
HOUR_ASSUMPTION = "실종 시간이 없어 Asia/Seoul 정오(12시)로 추정했습니다."
NOW_ASSUMPTION = "실종 시간이 없고 당일 정오 이전이어서 현재 Asia/Seoul 시각으로 추정했습니다."
FALLBACK_ASSUMPTION = "주변 환경 데이터를 사용할 수 없어 마지막 목격 위치를 중심으로 추천했습니다."
LIMITED_COMPARISON = "환경 데이터를 사용할 수 없어 환경 기반 비교가 제한됩니다. V2 개선 효과를 평가할 수 없습니다."
SUMMARY = "추천 영역 %d개 → %d개. 동일 순위 중심 이동 최대 %.1fm, 점수 변화 %+d~%+d점. 동일 순위 비교는 동일 물리 영역의 추적이 아니며 점수 차이는 정확도 차이를 뜻하지 않습니다."


def reason_codes(behavior: str, kinds: list[str]) -> list[str]:
    quiet = [] if {"MAJOR_ROAD", "RAILWAY_BARRIER"} & set(kinds) else ["LOW_TRAFFIC"]
    return [BEHAVIOR_CODES[behavior], *(code for kind, code in KIND_CODES.items() if kind in kinds), *quiet]


def plain_reason(behavior: str, kinds: list[str]) -> str:
    place = next((phrase for kind, phrase in PLACE_PHRASES.items() if kind in kinds), PLAIN_PHRASE)
    return f"{BEHAVIOR_PHRASES[behavior]} 및 {place}을 고려한 우선 수색 영역입니다."


def evidence(area: dict, behavior: str, most: int = 3) -> tuple[list[str], str]:
    """Codes and sentences of what contributed most; kinds count that won in member cells, not any nearby."""
    found = [(area["values"]["distance"], "DISTANCE_FROM_LAST_SEEN", DISTANCE_SENTENCE)]
    for part, field, prefix, what in (("behavior_environment", "behavior_kind", "BEHAVIOR_NEAR_", BEHAVIOR_PART), ("corridor", "corridor_kind", "CORRIDOR_NEAR_", CORRIDOR_PART)):
        sums: dict[str, float] = {}
        for m in area["members"]:
            if kind := getattr(m, field):
                sums[kind] = sums.get(kind, 0.0) + getattr(m, part)
        if sums:
            kind = min(sums, key=lambda k: (-round(sums[k], 9), k))
            found.append((area["values"][part], prefix + kind, NEAR_SENTENCE.format(behavior=BEHAVIOR_LABELS[behavior], what=what, kind=KIND_LABELS[kind])))
    if {"MAJOR_ROAD", "RAILWAY_BARRIER", "ROAD"} & set(area["kinds"]):
        found.append((area["values"]["accessibility"], "BARRIER_DISTANCE_CONSIDERED", BARRIER_SENTENCE))
    best = sorted((x for x in found if x[0] > 0), key=lambda x: -x[0])[:most]
    if len(best) < 2:
        best.append((0.0, "LIMITED_ENVIRONMENT_EVIDENCE", LIMITED_SENTENCE))
    return [code for _, code, _ in best], " ".join([*(text for _, _, text in best), LAST_SENTENCE])


def reason(behavior: Column, kinds: Column) -> Column:
    place = F.lit(PLAIN_PHRASE)
    for kind, phrase in reversed(PLACE_PHRASES.items()):
        place = F.when(F.array_contains(kinds, kind), phrase).otherwise(place)
    return F.concat(fn.lookup(behavior, BEHAVIOR_PHRASES), F.lit(" 및 "), place, F.lit("을 고려한 우선 수색 영역입니다."))


def fallback_list(radius: Column, lat: Column, lon: Column) -> Column:
    """Two circles around the last sighting as an array; points of parts are null."""
    core = F.least(F.lit(C.MOST_AREA - 100), F.greatest(F.lit(C.LEAST_AREA), F.bround(radius / 4, 0).cast("int")))
    wide = F.least(F.lit(C.MOST_AREA), F.greatest(core + 100, F.bround(radius / 3, 0).cast("int")))
    circle = lambda i, r, p, codes, text: F.struct(
        F.lit(i).alias("rank"), lat.alias("lat"), lon.alias("lon"), r.alias("radius_m"), F.lit(p).alias("priority"),
        F.lit(None).cast(POINTS).alias("points"), F.array(*map(F.lit, codes)).alias("codes"), F.lit(text).alias("reason"),
    )
    return F.array(*(circle(i + 1, r, *x) for i, (r, x) in enumerate(zip((core, wide), FALLBACK_AREAS, strict=True))))


POINTS = "struct<" + ",".join(f"{p}:int" for p in C.PARTS) + ">"


def fallback(requests: DataFrame) -> DataFrame:
    """Two circles around the last sighting, where there is no map."""
    both = fallback_list(F.col("radius"), F.col("latitude"), F.col("longitude"))
    return requests.select("request_id", F.explode(both).alias("a")).select("request_id", "a.rank", "a.lat", "a.lon", "a.radius_m", "a.priority", "a.codes", "a.reason")


def _listed(found: DataFrame, *versions: int) -> DataFrame:
    """One row for each request: its areas of each version in order, at most three."""
    area = F.struct("rank", "lat", "lon", "radius_m", "priority", F.struct(*C.PARTS).alias("points"), "codes", "reason")
    return found.groupBy("request_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("version") == v, area))).alias(f"areas_{v}") for v in versions))


def answered(requests: DataFrame, found: DataFrame, versions: tuple[int, ...], failed: DataFrame | None = None) -> DataFrame:
    """Requests with ``areas_v`` and ``fallback_v`` for each version v.

    The fallback where selection leaves fewer than two areas, and where the map could not be had
    (``failed``: request_id). Requests are joined once, whatever the versions."""
    out = requests.join(_listed(found, *versions), "request_id", "left")
    out = out.withColumn("map_failed", F.lit(False)) if failed is None else out.join(failed.select("request_id").distinct().withColumn("map_failed", F.lit(True)), "request_id", "left").withColumn("map_failed", F.coalesce("map_failed", F.lit(False)))
    for v in versions:
        few = F.col("map_failed") | F.col(f"areas_{v}").isNull() | (F.size(f"areas_{v}") < C.LEAST_AREAS)
        out = out.withColumn(f"fallback_{v}", few)
        out = out.withColumn(f"areas_{v}", F.when(few, fallback_list(F.col("radius"), F.col("latitude"), F.col("longitude"))).otherwise(F.col(f"areas_{v}")))
    return out


def mapped(requests: DataFrame, failed: DataFrame | None) -> DataFrame:
    return requests if failed is None else requests.join(failed.select("request_id").distinct(), "request_id", "left_anti")


def recommend(requests: DataFrame, features: DataFrame, improved: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """Areas of every request, a row each; the fallback where there is no map or too few areas."""
    scored = (score_v2 if improved else score_v1)(with_strengths(grid(mapped(requests, failed)), features))
    out = answered(requests, select(scored, improved).withColumn("version", F.lit(1)), (1,), failed)
    return out.select("request_id", F.col("fallback_1").alias("fallback_used"), F.explode("areas_1").alias("a")).select("request_id", "fallback_used", "a.rank", "a.lat", "a.lon", "a.radius_m", "a.priority", "a.codes", "a.reason")


def assumptions(hour_known: Column, from_now: Column, fallback_used: Column) -> Column:
    """What an answer rests on, in order."""
    hour = F.when(from_now, F.lit(NOW_ASSUMPTION)).when(~hour_known, F.lit(HOUR_ASSUMPTION))
    return F.array_compact(F.array(hour, F.when(fallback_used, F.lit(FALLBACK_ASSUMPTION))))


def compare(both: DataFrame) -> DataFrame:
    """Areas of two versions (see ``answered``) rank by rank: what moved, what came and what went."""
    rank = F.explode(F.sequence(F.lit(1), F.greatest(F.size("areas_1"), F.size("areas_2"))))
    rows = both.select("request_id", "areas_1", "areas_2", rank.alias("rank"))
    rows = rows.select("request_id", "rank", F.get("areas_1", F.col("rank") - 1).alias("old"), F.get("areas_2", F.col("rank") - 1).alias("new"))
    o, n = (lambda f: F.col(f"old.{f}")), (lambda f: F.col(f"new.{f}"))
    empty = F.array().cast("array<string>")
    status = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("BOTH")
    shift = F.bround(fn.distance_m(o("lat"), o("lon"), n("lat"), n("lon")), 3)
    extra = lambda a, b: F.when(a.isNull(), empty).when(b.isNull(), a).otherwise(F.array_except(a, b))
    return rows.select(
        "request_id", "rank", status.alias("status"), shift.alias("shift_m"), (n("priority") - o("priority")).alias("score_delta"),
        *(x for name, of in (("before", o), ("after", n)) for x in (of("lat").alias(f"{name}_lat"), of("lon").alias(f"{name}_lon"), of("radius_m").alias(f"{name}_radius_m"), of("priority").alias(f"{name}_priority"))),
        extra(n("codes"), o("codes")).alias("added"), extra(o("codes"), n("codes")).alias("removed"),
    )


def compare_summary(both: DataFrame) -> DataFrame:
    """One row for each request: numbers of areas, largest shift, range of score changes, the summary."""
    pairs = F.transform(F.slice(F.arrays_zip("areas_1", "areas_2"), 1, F.least(F.size("areas_1"), F.size("areas_2"))), lambda x: F.struct(
        F.bround(fn.distance_m(x["areas_1"]["lat"], x["areas_1"]["lon"], x["areas_2"]["lat"], x["areas_2"]["lon"]), 3).alias("shift"), (x["areas_2"]["priority"] - x["areas_1"]["priority"]).alias("delta")))
    rows = both.withColumn("_p", pairs).select(
        "request_id", (F.col("fallback_1") | F.col("fallback_2")).alias("fallback_used"), F.size("areas_1").alias("areas_before"), F.size("areas_2").alias("areas_after"),
        F.coalesce(F.array_max("_p.shift"), F.lit(0.0)).alias("most_shift_m"), F.coalesce(F.array_min("_p.delta"), F.lit(0)).alias("least_delta"), F.coalesce(F.array_max("_p.delta"), F.lit(0)).alias("most_delta"),
    )
    # one place after the point, half-even, as the shift itself has three
    said = F.format_string(SUMMARY.replace("%.1f", "%s"), "areas_before", "areas_after", F.bround(F.col("most_shift_m"), 1).cast("string"), "least_delta", "most_delta")
    return rows.withColumn("summary", F.when(F.col("fallback_used"), F.lit(LIMITED_COMPARISON)).otherwise(said))
