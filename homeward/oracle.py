"""DuckDB SQL that says, in its own way, what the engine's queries return.

Distances are compared directly (no buckets), prefixes of rankings are numbered over all rows, and
clusters are found by recursion, so none of this repeats how the engine works.
"""

from __future__ import annotations

from homeward import config as C
from homeward.operators import areas

ASK = 50


def _f(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _case(of: str, values: dict, other: str = "NULL", text: bool = False) -> str:
    show = (lambda v: f"'{v}'") if text else _f
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {other} END"


GALLERY = """gallery AS (
  SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'dog' ELSE 'cat' END AS species, CAST(vec_id // 4 AS VARCHAR) AS record_id,
    CASE WHEN (vec_id // 4) % 3 = 0 THEN 'REPORT' ELSE 'SHELTER' END AS candidate_type, CASE WHEN (vec_id // 4) % 3 = 0 THEN vec_id // 4 END AS candidate_report_id,
    concat(CASE WHEN label % 2 = 0 THEN 'dog' ELSE 'cat' END, ':', vec_id // 4, ':', vec_id % 4) AS gallery_id, CAST(embedding AS DOUBLE[]) AS embedding,
    substr(md5(CAST(vec_id // 3 AS VARCHAR)), 1, 16) AS phash_full, CASE WHEN vec_id % 5 <> 0 THEN substr(md5(CAST(vec_id * 31 + 7 AS VARCHAR)), 1, 16) END AS phash_crop
  FROM embeddings)"""
_ham = lambda a, b: f"bit_count(xor(CAST('0x' || {a} AS UBIGINT), CAST('0x' || {b} AS UBIGINT)))"
PAIRS = f"""{GALLERY}, pairs AS (
  SELECT q.vec_id AS request_id, q.vec_id // 4 AS report_id, g.*, greatest(-1.0, least(1.0, list_dot_product(q.embedding, g.embedding))) AS visual,
    least({_ham("q.phash_full", "g.phash_full")}, {_ham("q.phash_full", "g.phash_crop")}, {_ham("q.phash_crop", "g.phash_full")}, {_ham("q.phash_crop", "g.phash_crop")}) AS phash_distance
  FROM gallery q JOIN gallery g USING (species) WHERE q.vec_id % {ASK} = 0),
scored AS (SELECT *, phash_distance <= {C.NEAR_DUPLICATE_BITS} AS near_duplicate, CASE WHEN phash_distance <= {C.NEAR_DUPLICATE_BITS} THEN -CAST(phash_distance AS INT) ELSE {C.FAR_PHASH} END AS rank_hash FROM pairs),
best AS (SELECT * FROM scored WHERE candidate_report_id IS DISTINCT FROM report_id OR candidate_report_id IS NULL QUALIFY row_number() OVER (PARTITION BY request_id, candidate_type, record_id ORDER BY near_duplicate DESC, rank_hash DESC, visual DESC, vec_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY near_duplicate DESC, rank_hash DESC, visual DESC, vec_id) AS image_rank FROM best)"""

_lat, _lon = "37.5665::DOUBLE + ((event_id * 7919) % 2000 - 1000) / 5000.0::DOUBLE", "126.978::DOUBLE + ((event_id * 104729) % 1999 - 1000) / 5000.0::DOUBLE"
REPORTS = f"""reports AS (
  SELECT event_id AS report_id, CAST(ts AS DATE) AS event_date, strftime(ts, '%Y.%m.%d') AS date_text, CASE WHEN event_id % 2 = 0 THEN 'LOST' ELSE 'FOUND' END AS kind,
    {_lat} AS latitude, {_lon} AS longitude,
    CASE event_id % 5 WHEN 0 THEN '서울특별시 강남구 역삼동' WHEN 1 THEN '서울특별시 강남구 삼성동' WHEN 2 THEN '경기도 수원시 팔달구 101동' WHEN 3 THEN '서울특별시 중구' ELSE '' END AS address
  FROM events)"""
_km = (
    lambda a, b: f"(SELECT {_f(C.EARTH_KM)} * 2 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))) FROM (SELECT pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2) AS h))"
)
#: The names in an address by level; the pattern is lazy, so a name ends at its first suffix.
UNITS = """units AS (SELECT report_id, address, list_filter(regexp_extract_all(address, '[가-힣0-9]+?(?:특별자치도|특별자치시|특별시|광역시|도|시|군|구|읍|면|동|리)'), lambda u: NOT regexp_full_match(u, '[0-9]+(동|리)')) AS u FROM reports),
levels AS (SELECT report_id, u, list_filter(u, lambda x: regexp_matches(x, '(특별시|광역시|도|특별자치시)$')) AS p, list_filter(u, lambda x: regexp_matches(x, '시$') AND NOT regexp_matches(x, '(특별시|광역시|특별자치시)$')) AS c,
  list_filter(u, lambda x: regexp_matches(x, '(군|구)$')) AS d, list_filter(u, lambda x: regexp_matches(x, '(읍|면|동|리)$')) AS l FROM units)"""
_share = lambda k: f"list_has_any(a.{k}, b.{k})"
_against = lambda k: f"(len(a.{k}) > 0 AND len(b.{k}) > 0 AND NOT {_share(k)})"
ADDRESS = f"""CASE WHEN len(a.u) = 0 OR len(b.u) = 0 THEN NULL WHEN {_against("p")} THEN 0.1::DOUBLE
  WHEN {_share("l")} AND ({_share("p")} OR {_share("c")} OR {_share("d")}) AND NOT {_against("c")} AND NOT {_against("d")} THEN 0.9::DOUBLE
  WHEN {_share("d")} AND NOT {_against("c")} THEN 0.7::DOUBLE WHEN {_share("p")} OR {_share("c")} OR {_share("l")} THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END"""


def _days(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} <= {most} THEN {_f(v)}" for most, v in C.DAY_SCORES[:-1]) + f" ELSE {_f(C.DAY_SCORES[-1][1])} END"


TAGS = """tags AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['male'] WHEN 1 THEN ['female'] END AS sex, list_distinct(string_split(lower(p_name), ' ')) AS colors, [lower(p_brand)] AS patterns,
    [CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END] AS size, list_distinct(string_split(lower(p_type), ' ')) AS behavior
  FROM part)"""
_FIELDS = ["sex", "colors", "patterns", "size", "behavior"]
_has = lambda f: f"(a.{f} IS NOT NULL AND b.{f} IS NOT NULL)"
_common = lambda f: f"list_intersect(a.{f}, b.{f})"
_compared = " + ".join(f"CASE WHEN {_has(f)} THEN {_f(C.TAG_WEIGHTS[f])} ELSE 0 END" for f in _FIELDS)
_earned = " + ".join(f"CASE WHEN {_has(f)} THEN {_f(C.TAG_WEIGHTS[f])} * len({_common(f)}) / len(list_distinct(list_concat(a.{f}, b.{f}))) ELSE 0 END" for f in _FIELDS)
_available = " + ".join(f"CASE WHEN a.{f} IS NOT NULL THEN {_f(C.TAG_WEIGHTS[f])} ELSE 0 END" for f in _FIELDS)
_matched = "list_concat(" + ", ".join(f"CASE WHEN {_has(f)} THEN list_transform(list_sort({_common(f)}), lambda v: '{f}:' || v) ELSE [] END" for f in _FIELDS) + ")"
_conflicts = "concat_ws('|', " + ", ".join(f"CASE WHEN {_has(f)} AND len({_common(f)}) = 0 THEN '{f}' END" for f in ("sex", "size")) + ")"
TAG_SCORES = f"CASE WHEN {_compared} > 0 THEN ({_earned}) / ({_compared}) END AS tag_score, CASE WHEN {_compared} > 0 THEN ({_compared}) / ({_available}) ELSE 0 END AS tag_coverage"

POOL = f"""{PAIRS}, {REPORTS}, {UNITS}, {TAGS},
sides AS (SELECT r.*, t.sex AS q_sex, t.colors AS q_colors FROM ranked r LEFT JOIN tags t ON t.p_partkey = r.request_id WHERE image_rank <= {C.POOL}),
with_tags AS (SELECT s.request_id, s.vec_id, {TAG_SCORES} FROM sides s JOIN tags a ON a.p_partkey = s.request_id JOIN tags b ON b.p_partkey = s.vec_id),
with_place AS (SELECT s.request_id, s.vec_id, exp(-{_km("x", "y")} / {_f(C.LOCATION_DECAY_KM)}) AS place, {_km("x", "y")} AS distance_km,
    CASE WHEN x.kind = y.kind THEN NULL WHEN x.kind = 'FOUND' THEN date_diff('day', y.event_date, x.event_date) ELSE date_diff('day', x.event_date, y.event_date) END AS days
  FROM sides s JOIN reports x ON x.report_id = s.request_id JOIN reports y ON y.report_id = s.vec_id),
with_st AS (SELECT *, CASE WHEN days IS NULL THEN place ELSE (0.65::DOUBLE * place + 0.35::DOUBLE * ({_days("days")})) / (0.65::DOUBLE + 0.35::DOUBLE) END AS st_score FROM with_place),
pool AS (SELECT s.*, tag_score, coalesce(tag_coverage, 0) AS tag_coverage, st_score, distance_km,
    max(CASE WHEN s.q_colors IS NOT NULL AND tag_score IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.request_id) AS on_tags, max(CASE WHEN st_score IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.request_id) AS on_place
  FROM sides s LEFT JOIN with_tags USING (request_id, vec_id) LEFT JOIN with_st USING (request_id, vec_id)),
weighted AS (SELECT *, 0.75::DOUBLE / (0.75::DOUBLE + 0.15::DOUBLE * on_tags + 0.10::DOUBLE * on_place) AS w_image, 0.15::DOUBLE * on_tags / (0.75::DOUBLE + 0.15::DOUBLE * on_tags + 0.10::DOUBLE * on_place) AS w_tags,
    0.10::DOUBLE * on_place / (0.75::DOUBLE + 0.15::DOUBLE * on_tags + 0.10::DOUBLE * on_place) AS w_location FROM pool),
reranked AS (SELECT *, w_image * (visual + 1) / 2 + w_tags * coalesce(tag_coverage * tag_score + (1 - tag_coverage) * (visual + 1) / 2, (visual + 1) / 2) + w_location * coalesce(st_score, (visual + 1) / 2) AS ranking FROM weighted),
final AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY near_duplicate DESC, rank_hash DESC, ranking DESC, visual DESC, image_rank) AS rank FROM reranked QUALIFY rank <= {C.TOP_K})"""

REQUESTS = f"""asked AS (
  SELECT event_id AS request_id, {_lat} AS latitude, {_lon} AS longitude, CASE event_id // 50 % 3 WHEN 0 THEN 500 WHEN 1 THEN 1000 ELSE 1500 END AS base, 1 + event_id // 50 % 90 AS hours, user_id AS u
  FROM events WHERE event_id % {ASK} = 0),
requests AS (SELECT request_id, latitude, longitude, u % 6 = 0 AS limited,
    CASE WHEN u % 11 = 0 OR u % 7 = 0 THEN 'CHASE_DRIVEN' WHEN u % 11 = 1 OR u % 5 = 0 OR u % 3 = 1 THEN 'FEARFUL' WHEN u % 3 = 0 THEN 'HUMAN_SEEKING' ELSE 'ALOOF' END AS behavior,
    CAST(least(3000, greatest(300, round_even(base * (CASE WHEN hours <= 6 THEN 0.6::DOUBLE WHEN hours <= 24 THEN 1.0::DOUBLE WHEN hours <= 72 THEN 1.4::DOUBLE ELSE 1.8::DOUBLE END
      * CASE u % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN u % 6 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
      * CASE u % 11 WHEN 1 THEN 1.1::DOUBLE WHEN 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 0))) AS INT) AS radius
  FROM asked)"""
CELLS = f"""{REQUESTS}, cells AS (
  SELECT r.*, i.i AS row, j.j AS col, sqrt((i.i * 200.0 * i.i * 200.0 + j.j * 200.0 * j.j * 200.0)::DOUBLE) AS distance_m,
    latitude + degrees(i.i * 200 / {_f(C.EARTH_M)}) AS lat, longitude + degrees(j.j * 200 / ({_f(C.EARTH_M)} * cos(radians(latitude)))) AS lon
  FROM requests r, (SELECT unnest(range(-15, 16))::INT AS i) i, (SELECT unnest(range(-15, 16))::INT AS j) j
  WHERE sqrt((i.i * 200.0 * i.i * 200.0 + j.j * 200.0 * j.j * 200.0)::DOUBLE) <= radius)"""
#: For what meets nothing: all events ask.
EVERY_REQUEST, EVERY_CELL = (x.replace(f" WHERE event_id % {ASK} = 0", "") for x in (REQUESTS, CELLS))
_kinds = "[" + ", ".join(f"'{k}'" for k in C.KINDS) + "]"
#: Features are copied to the coarse cells around their own, so equal keys find all that is near.
NEAR = f"""{CELLS}, features AS (
  SELECT {_lat} + (event_id % 13 - 6) / 9000.0::DOUBLE AS f_lat, {_lon} + (event_id % 17 - 8) / 9000.0::DOUBLE AS f_lon,
    CASE WHEN event_id % 3 = 0 THEN [{_kinds}[event_id % 8 + 1], {_kinds}[(event_id + 3) % 8 + 1]] ELSE [{_kinds}[event_id % 8 + 1]] END AS kinds
  FROM events),
around AS (SELECT f.*, floor(f_lat / 0.004) + i AS a, floor(f_lon / 0.006) + j AS b FROM features f, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
near AS (SELECT * FROM (SELECT c.request_id, c.row, c.col, kinds, sqrt(pow(radians(f_lat - lat) * {_f(C.EARTH_M)}, 2) + pow(radians(f_lon - lon) * {_f(C.EARTH_M)} * cos(radians((lat + f_lat) / 2)), 2)) AS away_m
  FROM cells c JOIN around f ON f.a = floor(c.lat / 0.004) AND f.b = floor(c.lon / 0.006)) WHERE away_m <= {C.INFLUENCE_M})"""
STRENGTHS = f"""{NEAR}, strengths AS (SELECT request_id, row, col, {", ".join(f"max(CASE WHEN list_contains(kinds, '{k}') THEN greatest(0, 1 - away_m / {C.INFLUENCE_M}) END) AS {k}" for k in C.KINDS)} FROM near GROUP BY ALL),
known AS (SELECT c.*, {", ".join(C.KINDS)} FROM cells c LEFT JOIN strengths USING (request_id, row, col))"""


def _best(values: dict, of) -> str:
    return "greatest(0, " + ", ".join(f"coalesce({of(k)} * {_f(v)}, 0)" for k, v in values.items()) + ")"


def _preferred(of) -> str:
    return "CASE behavior " + " ".join(f"WHEN '{b}' THEN {_best(v, of)}" for b, v in C.PREFERENCES.items()) + " END"


_here = lambda k: f"CASE WHEN {k} IS NOT NULL THEN 1.0::DOUBLE END"
_s = lambda k: f"coalesce({k}, 0)"
_none = "coalesce(" + ", ".join(C.KINDS) + ") IS NULL"
_total = "greatest(0, least(100, 100 * (" + " + ".join(f"{p} * {_f(w)}" for p, w in C.PARTS.items()) + ")))"
_shown = "concat_ws('|', " + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in C.KINDS) + ")"
V1 = f"""{STRENGTHS}, parts1 AS (SELECT *, greatest(0, least(1, 1 - distance_m / radius)) AS distance,
    CASE WHEN {_none} THEN 0.2::DOUBLE ELSE {_preferred(_here)} END AS behavior_environment, CASE WHEN {_none} THEN 0.1::DOUBLE ELSE {_best(C.CORRIDORS, _here)} END AS corridor,
    greatest(0, 1 - ({" + ".join(f"CASE WHEN {k} IS NOT NULL THEN {_f(v)} ELSE 0 END" for k, v in C.PENALTIES.items())})) AS accessibility,
    greatest(0, least(1, 0.5::DOUBLE + CASE WHEN behavior = 'FEARFUL' AND MAJOR_ROAD IS NULL THEN 0.3::DOUBLE WHEN behavior = 'CHASE_DRIVEN' AND FOOTPATH IS NOT NULL THEN 0.3::DOUBLE
      WHEN behavior = 'HUMAN_SEEKING' AND (COMMERCIAL IS NOT NULL OR BUILDING_RESIDENTIAL IS NOT NULL) THEN 0.3::DOUBLE WHEN behavior = 'ALOOF' AND GREEN_SPACE IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END
      - CASE WHEN limited AND RAILWAY_BARRIER IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END)) AS event_context FROM known),
v1 AS (SELECT *, {_total} AS score, {_shown} AS kinds FROM parts1)"""
V2 = f"""{STRENGTHS}, parts2 AS (SELECT *, greatest(0, least(1, 1 - distance_m / radius)) AS distance, least(1, {_preferred(_s)}) AS behavior_environment, least(1, {_best(C.CORRIDORS, _s)}) AS corridor,
    greatest(0, 1 - ({" + ".join(f"{_s(k)} * {_f(v)}" for k, v in sorted(C.PENALTIES.items()))})) AS accessibility,
    greatest(0, least(1, 0.5::DOUBLE + CASE behavior WHEN 'FEARFUL' THEN 0.3::DOUBLE * (1 - {_s("MAJOR_ROAD")}) WHEN 'CHASE_DRIVEN' THEN 0.3::DOUBLE * {_s("FOOTPATH")}
      WHEN 'HUMAN_SEEKING' THEN 0.3::DOUBLE * greatest({_s("COMMERCIAL")}, {_s("BUILDING_RESIDENTIAL")}) ELSE 0.2::DOUBLE * {_s("GREEN_SPACE")} END
      - CASE WHEN limited THEN 0.3::DOUBLE * {_s("RAILWAY_BARRIER")} ELSE 0 END)) AS event_context FROM known)"""
ELIGIBLE = f"{V1}, eligible AS (SELECT * FROM v1 QUALIFY round(score, 9) >= greatest({C.SCORE_FLOOR}, max(round(score, 9)) OVER (PARTITION BY request_id) - {C.SCORE_BAND}))"
#: The least cell that each can reach by steps to neighbours (corners count).
CLUSTERS = (
    ELIGIBLE
    + """, reach AS (
  SELECT request_id, row, col, row AS r2, col AS c2 FROM eligible
  UNION SELECT p.request_id, p.row, p.col, e.row, e.col FROM reach p JOIN eligible e ON e.request_id = p.request_id AND abs(e.row - p.r2) <= 1 AND abs(e.col - p.c2) <= 1),
labels AS (SELECT request_id, row, col, min((r2 + 100) * 1000 + c2 + 100) AS least FROM reach GROUP BY ALL),
clustered AS (SELECT *, least // 1000 - 100 AS cluster_row, least % 1000 - 100 AS cluster_col FROM labels)"""
)
CANDIDATES = f"""{CLUSTERS}, candidates AS (
  SELECT request_id, cluster_row, cluster_col, sum(lat * score) / sum(score) AS lat, sum(lon * score) / sum(score) AS lon, count(*) AS n_cells,
    CAST(least({C.MOST_AREA}, greatest({C.LEAST_AREA}, round_even({C.CLUSTER_BASE_M} + {C.GRID_M} * sqrt(count(*)) / 2, 0))) AS INT) AS radius_m, CAST(round_even(round(avg(score), 9), 0) AS INT) AS priority,
    {", ".join(f"avg({p}) AS {p}" for p in C.PARTS)}
  FROM clustered JOIN eligible USING (request_id, row, col) GROUP BY ALL)"""
_all_parts = " UNION ALL ".join(f"SELECT request_id, cluster_row, cluster_col, priority, {i} AS place, '{p}' AS part, round({p} * {_f(w)} * 100, 9) AS value FROM candidates" for i, (p, w) in enumerate(C.PARTS.items()))
_shown_list = "list_filter([" + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in C.KINDS) + "], lambda x: x IS NOT NULL)"
_strong_list = "list_filter([" + ", ".join(f"CASE WHEN coalesce({k}, 0) > 0 THEN '{k}' END" for k in C.KINDS) + "], lambda x: x IS NOT NULL)"


def _winner(values: dict) -> str:
    """The kind of the largest product, the first by name of equals; none if that is 0."""
    best = _best(values, _s)
    return "CASE " + " ".join(f"WHEN {_s(k)} * {_f(values[k])} > 0 AND {_s(k)} * {_f(values[k])} = {best} THEN '{k}'" for k in sorted(values)) + " END"


_behavior_kind = "CASE behavior " + " ".join(f"WHEN '{b}' THEN {_winner(v)}" for b, v in C.PREFERENCES.items()) + " END"
_away = lambda a, b: f"sqrt(pow(radians({b}.lat - {a}.lat) * {_f(C.EARTH_M)}, 2) + pow(radians({b}.lon - {a}.lon) * {_f(C.EARTH_M)} * cos(radians(({a}.lat + {b}.lat) / 2)), 2))"
_apart = lambda a, b: f"{_away(a, b)} >= {_f(C.OVERLAP)} * ({a}.radius_m + {b}.radius_m)"
SOURCES = f"""{STRENGTHS}, """ + V1.removeprefix(STRENGTHS + ", ") + ", " + V2.removeprefix(STRENGTHS + ", ") + f""",
s1 AS (SELECT request_id, row, col, lat, lon, behavior, score, {_shown_list} AS kinds, NULL::VARCHAR AS bk, NULL::VARCHAR AS ck, {", ".join(C.PARTS)} FROM v1),
s2 AS (SELECT request_id, row, col, lat, lon, behavior, {_total} AS score, {_strong_list} AS kinds, {_behavior_kind} AS bk, {_winner(C.CORRIDORS)} AS ck, {", ".join(C.PARTS)} FROM parts2)"""


def _values(i: int) -> str:
    return list(C.PARTS)[i]


def selection(v: int) -> str:
    """The areas of version ``v`` (chosen{v}: request_id, rank and all that is shown), by three steps:
    the best cluster, the best one apart from it, the best one apart from both; else two cells."""
    parts = ", ".join(f"round(avg({p}) * {_f(w)} * 100, 9) AS v_{p}" for p, w in C.PARTS.items())
    own = ", ".join(f"round({p} * {_f(w)} * 100, 9) AS v_{p}" for p, w in C.PARTS.items())
    names = ", ".join(f"v_{p}" for p in C.PARTS)
    step = "request_id, least, lat, lon, radius_m, priority, kinds, n_cells, behavior, " + names
    frac = lambda p: f"round(v_{p} - floor(v_{p}), 9)"
    order = list(C.PARTS)
    place = lambda p: " + ".join(f"CASE WHEN {frac(q)} > {frac(p)} OR ({frac(q)} = {frac(p)} AND {order.index(q) < order.index(p)}) THEN 1 ELSE 0 END" for q in order if q != p)
    rest = "priority - (" + " + ".join(f"floor(v_{p})" for p in order) + ")"
    points = ", ".join(f"CAST(floor(v_{p}) + CASE WHEN {place(p)} < {rest} THEN 1 ELSE 0 END AS INT) AS {p}" for p in order)
    plain = "list_filter([" + ", ".join([_case("behavior", areas.BEHAVIOR_CODES, text=True), *(f"CASE WHEN list_contains(kinds, '{k}') THEN '{c}' END" for k, c in areas.KIND_CODES.items()), "CASE WHEN NOT list_has_any(kinds, ['MAJOR_ROAD', 'RAILWAY_BARRIER']) THEN 'LOW_TRAFFIC' END"]) + "], lambda x: x IS NOT NULL)"
    place_of = "CASE " + " ".join(f"WHEN list_contains(kinds, '{k}') THEN '{t}'" for k, t in areas.PLACE_PHRASES.items()) + f" ELSE '{areas.PLAIN_PHRASE}' END"
    said = f"{_case('behavior', areas.BEHAVIOR_PHRASES, text=True)} || ' 및 ' || {place_of} || '을 고려한 우선 수색 영역입니다.'"
    near = lambda kind, what: f"{_case('behavior', areas.BEHAVIOR_LABELS, text=True)} || '을 고려한 {what}에 구성 격자와 ' || {_case(kind, areas.KIND_LABELS, text=True)} || ' 대표점의 가까운 거리가 반영되었습니다.'"
    found = f"""[{{'v': v_distance, 'n': 0, 'code': 'DISTANCE_FROM_LAST_SEEN', 't': '{areas.DISTANCE_SENTENCE}'}},
      {{'v': CASE WHEN wb IS NULL THEN 0 ELSE v_behavior_environment END, 'n': 1, 'code': 'BEHAVIOR_NEAR_' || wb, 't': {near("wb", areas.BEHAVIOR_PART)}}}, {{'v': CASE WHEN wc IS NULL THEN 0 ELSE v_corridor END, 'n': 2, 'code': 'CORRIDOR_NEAR_' || wc, 't': {near("wc", areas.CORRIDOR_PART)}}},
      {{'v': CASE WHEN list_has_any(kinds, ['MAJOR_ROAD', 'RAILWAY_BARRIER', 'ROAD']) THEN v_accessibility ELSE 0 END, 'n': 3, 'code': 'BARRIER_DISTANCE_CONSIDERED', 't': '{areas.BARRIER_SENTENCE}'}}]"""
    last = (
        f"""said{v} AS (SELECT *, {plain} AS codes, {said} AS reason FROM picked{v})"""
        if v == 1
        else f"""wins{v} AS (SELECT m.request_id, m.rank, (SELECT NULL) AS none, arg_min(bk, (-sb, bk)) FILTER (bk IS NOT NULL) AS wb FROM (SELECT request_id, rank, bk, round(sum(behavior_environment), 9) AS sb FROM members{v} GROUP BY ALL) m GROUP BY ALL),
    winc{v} AS (SELECT request_id, rank, arg_min(ck, (-sc, ck)) FILTER (ck IS NOT NULL) AS wc FROM (SELECT request_id, rank, ck, round(sum(corridor), 9) AS sc FROM members{v} GROUP BY ALL) GROUP BY ALL),
    facts{v} AS (SELECT p.*, wb, wc FROM picked{v} p LEFT JOIN wins{v} USING (request_id, rank) LEFT JOIN winc{v} USING (request_id, rank)),
    best{v} AS (SELECT *, list_sort(list_transform(list_filter({found}, lambda x: x.v > 0), lambda x: {{'o': -x.v, 'n': x.n, 'code': x.code, 't': x.t}}))[1:3] AS e FROM facts{v}),
    said{v} AS (SELECT * EXCLUDE (e), list_transform(e, lambda x: x.code) || CASE WHEN len(e) < 2 THEN ['LIMITED_ENVIRONMENT_EVIDENCE'] ELSE [] END AS codes,
      array_to_string(list_transform(e, lambda x: x.t) || CASE WHEN len(e) < 2 THEN ['{areas.LIMITED_SENTENCE}'] ELSE [] END || ['{areas.LAST_SENTENCE}'], ' ') AS reason FROM best{v})"""
    )
    return f"""el{v} AS (SELECT * FROM s{v} QUALIFY round(score, 9) >= greatest({C.SCORE_FLOOR}, max(round(score, 9)) OVER (PARTITION BY request_id) - {C.SCORE_BAND})),
    reach{v} AS (SELECT request_id, row, col, row AS r2, col AS c2 FROM el{v}
      UNION SELECT p.request_id, p.row, p.col, e.row, e.col FROM reach{v} p JOIN el{v} e ON e.request_id = p.request_id AND abs(e.row - p.r2) <= 1 AND abs(e.col - p.c2) <= 1),
    labels{v} AS (SELECT request_id, row, col, min((r2 + 100) * 1000 + c2 + 100) AS least FROM reach{v} GROUP BY ALL),
    cl{v} AS (SELECT e.*, least FROM el{v} e JOIN labels{v} USING (request_id, row, col)),
    cand{v} AS (SELECT request_id, least, sum(lat * score) / sum(score) AS lat, sum(lon * score) / sum(score) AS lon, CAST(least({C.MOST_AREA}, greatest({C.LEAST_AREA}, round_even({C.CLUSTER_BASE_M} + {C.GRID_M} * sqrt(count(*)) / 2, 0))) AS INT) AS radius_m,
      CAST(round_even(round(avg(score), 9), 0) AS INT) AS priority, list_sort(list_distinct(flatten(list(kinds)))) AS kinds, CAST(count(*) AS INT) AS n_cells, any_value(behavior) AS behavior, {parts} FROM cl{v} GROUP BY request_id, least),
    ord{v} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY priority DESC, lat, lon) AS rn FROM cand{v}),
    k1{v} AS (SELECT *, 1 AS rank FROM ord{v} WHERE rn = 1),
    k2{v} AS (SELECT o.*, 2 AS rank FROM ord{v} o JOIN k1{v} a USING (request_id) WHERE o.rn > 1 AND {_apart("o", "a")} QUALIFY row_number() OVER (PARTITION BY o.request_id ORDER BY o.rn) = 1),
    k3{v} AS (SELECT o.*, 3 AS rank FROM ord{v} o JOIN k1{v} a USING (request_id) JOIN k2{v} b USING (request_id) WHERE o.rn > b.rn AND {_apart("o", "a")} AND {_apart("o", "b")} QUALIFY row_number() OVER (PARTITION BY o.request_id ORDER BY o.rn) = 1),
    one{v} AS (SELECT request_id, (row + 100) * 1000 + col + 100 AS least, lat, lon, {C.LEAST_AREA} AS radius_m, CAST(round_even(round(score, 9), 0) AS INT) AS priority, list_sort(kinds) AS kinds, 1 AS n_cells, behavior, {own},
      row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, row, col) AS rn FROM s{v} WHERE request_id NOT IN (SELECT request_id FROM k2{v})),
    o1{v} AS (SELECT *, 1 AS rank FROM one{v} WHERE rn = 1),
    o2{v} AS (SELECT o.*, 2 AS rank FROM one{v} o JOIN o1{v} a USING (request_id) WHERE o.rn > 1 AND {_apart("o", "a")} QUALIFY row_number() OVER (PARTITION BY o.request_id ORDER BY o.rn) = 1),
    picked{v} AS (SELECT {step}, rank, true AS grouped FROM k1{v} WHERE request_id IN (SELECT request_id FROM k2{v}) UNION ALL SELECT {step}, rank, true FROM k2{v} UNION ALL SELECT {step}, rank, true FROM k3{v}
      UNION ALL SELECT {step}, rank, false FROM o1{v} UNION ALL SELECT {step}, rank, false FROM o2{v}),
    members{v} AS (SELECT p.request_id, p.rank, bk, ck, behavior_environment, corridor FROM picked{v} p JOIN cl{v} c ON p.grouped AND c.request_id = p.request_id AND c.least = p.least
      UNION ALL SELECT p.request_id, p.rank, bk, ck, behavior_environment, corridor FROM picked{v} p JOIN s{v} c ON NOT p.grouped AND c.request_id = p.request_id AND (c.row + 100) * 1000 + c.col + 100 = p.least),
    {last},
    chosen{v} AS (SELECT request_id, CAST(rank AS INT) AS rank, round(lat, 6) AS lat, round(lon, 6) AS lon, radius_m, priority, kinds, n_cells, {points}, codes, reason, behavior FROM said{v})"""


_core = f"least({C.MOST_AREA - 100}, greatest({C.LEAST_AREA}, CAST(round_even(radius / 4, 0) AS INT)))"
_aliases = "MAP {" + ", ".join(f"'{a}': '{name}'" for a, name in C.TAG_ALIASES.items()) + "}"
_categories = "[" + ", ".join(f"'{c}'" for c in [*C.CATEGORY_FIELDS, "기타"]) + "]"
_field = _case("category", C.CATEGORY_FIELDS, text=True)

_sources = "WITH RECURSIVE " + SOURCES
_circle = lambda i, r, p, codes, text: f"SELECT request_id, true AS fallback_used, {i} AS rank, round(latitude, 6) AS lat, round(longitude, 6) AS lon, {r} AS radius_m, {p} AS priority, {codes} AS codes, '{text}' AS reason FROM requests"
_wide = f"least({C.MOST_AREA}, greatest({_core} + 100, CAST(round_even(radius / 3, 0) AS INT)))"
FALLBACK = " UNION ALL ".join(_circle(i + 1, r, p, codes, text) for i, (r, (p, codes, text)) in enumerate(zip((_core, _wide), areas.FALLBACK_AREAS, strict=True)))
#: Every seventh request has no map.
_failed = "(request_id // 50 % 7 = 0)"


def _answer(v: int) -> str:
    return f"""answer{v} AS (SELECT c.request_id, false AS fallback_used, rank, lat, lon, radius_m, priority, codes, reason FROM chosen{v} c WHERE NOT {_failed} AND request_id IN (SELECT request_id FROM chosen{v} WHERE rank = 2)
      UNION ALL SELECT * FROM ({FALLBACK}) WHERE {_failed} OR request_id NOT IN (SELECT request_id FROM chosen{v} WHERE rank = 2))"""


_both = f"{_sources}, {selection(1)}, {selection(2)}, {_answer(1)}, {_answer(2)}"
_shift = f"round_even(sqrt(pow(radians(n.lat - o.lat) * {_f(C.EARTH_M)}, 2) + pow(radians(n.lon - o.lon) * {_f(C.EARTH_M)} * cos(radians((o.lat + n.lat) / 2)), 2)), 3)"
_diff = lambda a, b: f"array_to_string(list_filter(coalesce({a}.codes, []), lambda x: NOT list_contains(coalesce({b}.codes, []), x)), '|')"
_changes = f"""changes AS (SELECT coalesce(o.request_id, n.request_id) AS request_id, coalesce(o.rank, n.rank) AS rank, CASE WHEN o.rank IS NULL THEN 'ADDED' WHEN n.rank IS NULL THEN 'REMOVED' ELSE 'BOTH' END AS status, {_shift} AS shift_m,
    n.priority - o.priority AS score_delta, o.lat AS before_lat, o.lon AS before_lon, o.radius_m AS before_radius_m, o.priority AS before_priority, n.lat AS after_lat, n.lon AS after_lon, n.radius_m AS after_radius_m, n.priority AS after_priority,
    {_diff("n", "o")} AS added, {_diff("o", "n")} AS removed, coalesce(o.fallback_used, n.fallback_used) AS fb1, coalesce(n.fallback_used, o.fallback_used) AS fb2 FROM answer1 o FULL JOIN answer2 n ON o.request_id = n.request_id AND o.rank = n.rank)"""
_summary = areas.SUMMARY.replace("%+d", "%s").replace("%.1f", "%s").replace("%d", "%s")
_signed = lambda x: f"CASE WHEN {x} < 0 THEN CAST({x} AS VARCHAR) ELSE '+' || CAST({x} AS VARCHAR) END"
_picks = "request_id, rank, round(lat, 5) AS lat, round(lon, 5) AS lon, radius_m, priority, "

#: Metadata of parts, as queries.py makes it: what each row holds, by the part's key.
_k = "p_partkey"
_sexes = f"CASE WHEN {_k} % 3 = 0 THEN 'male' WHEN {_k} % 3 = 1 THEN 'female' ELSE 'male' END"
_colors = f"CASE {_k} % 4 WHEN 0 THEN 'white|black' WHEN 1 THEN 'white|tricolor' WHEN 2 THEN 'brown' ELSE '' END"

ORACLE_SQL: dict[str, str] = {
    "knn_topk": f"WITH {PAIRS} SELECT request_id, gallery_id, round(visual, 5) AS visual, row_number() OVER (PARTITION BY request_id ORDER BY near_duplicate DESC, rank_hash DESC, scored.visual DESC, vec_id) AS rank FROM scored QUALIFY rank <= {C.TOP_K}",
    "query_mean_vector": f"""WITH {GALLERY}, each AS (SELECT record_id, i, avg(embedding[i]) AS x FROM gallery, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 4 < 3 GROUP BY ALL),
        norms AS (SELECT record_id, sqrt(sum(x * x)) AS n FROM each GROUP BY ALL)
        SELECT record_id, round(max(CASE WHEN i = 1 THEN x / n END), 5) AS "first", round(max(CASE WHEN i = 64 THEN x / n END), 5) AS "last", round(sum(x * x / n / n), 5) AS norm FROM each JOIN norms USING (record_id) WHERE n > 1e-12 GROUP BY record_id""",
    "best_per_record": f"WITH {PAIRS} SELECT request_id, record_id, gallery_id, round(visual, 5) AS visual FROM best",
    "phash_hamming_min": f"WITH {PAIRS} SELECT request_id, gallery_id, CAST(phash_distance AS INT) AS phash_distance, near_duplicate FROM scored",
    "near_dup_rank": f"WITH {PAIRS} SELECT request_id, record_id, near_duplicate, rank_hash, image_rank FROM ranked WHERE image_rank <= {C.POOL}",
    "self_exclude": f"WITH {PAIRS} SELECT request_id, gallery_id FROM pairs WHERE candidate_report_id IS DISTINCT FROM report_id OR candidate_report_id IS NULL",
    "gallery_union": f"""WITH {GALLERY} SELECT gallery_id, CASE WHEN vec_id % 3 <> 0 THEN 'SHELTER' ELSE 'REPORT' END AS candidate_type, CASE WHEN vec_id % 3 = 0 THEN vec_id // 4 END AS candidate_report_id,
        CASE WHEN vec_id % 3 <> 0 THEN 0 ELSE 1 END AS part, coalesce(phash_crop, '') AS phash_crop FROM gallery""",
    "metadata_coalesce": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN trim(c_mktsegment) WHEN c_custkey % 5 <> 0 THEN trim(c_name) ELSE CAST(c_custkey AS VARCHAR) END AS label, round(c_acctbal, 2) AS amount,
        CASE c_custkey % 4 WHEN 0 THEN 'LOST' WHEN 1 THEN 'FOUND' WHEN 2 THEN 'FOUND' ELSE 'LOST' END AS type FROM customer""",
    "decision": f"""WITH {PAIRS} SELECT q.vec_id AS request_id, CASE WHEN q.vec_id % 350 = 0 OR r.request_id IS NULL THEN 'NO_GALLERY' WHEN near_duplicate THEN 'NEAR_DUPLICATE_CANDIDATE' ELSE 'RANKED_CANDIDATES_NEED_HUMAN_REVIEW' END AS decision
        FROM gallery q LEFT JOIN ranked r ON r.request_id = q.vec_id AND image_rank = 1 WHERE q.vec_id % {ASK} = 0""",
    "top1_top2_gap": f"WITH {PAIRS} SELECT a.request_id, round(a.visual - b.visual, 5) AS gap FROM ranked a JOIN ranked b ON a.request_id = b.request_id AND a.image_rank = 1 AND b.image_rank = 2 WHERE NOT a.near_duplicate",
    "tag_split_canonical": f"""WITH names AS (SELECT {_aliases} AS m), raw AS (SELECT p_partkey, replace(p_name, ' ', ',') || '+' || (['흰색, 수컷', '검정/치즈', '삼색 및 단모', '소형 | 미상', 'Long-Coat ; 점박이'])[p_size % 5 + 1] AS t FROM part),
        words AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(t, '[,/|+&·ㆍ;，、]|\\s+(?:및|와|과)\\s+'), lambda x: trim(x)), lambda x: x <> '') AS w FROM raw),
        tags AS (SELECT p_partkey, list_filter(list_transform(w, lambda x: coalesce(m[upper(regexp_replace(x, '[\\s_\\-/]', '', 'g'))], m[lower(regexp_replace(x, '[^0-9A-Za-z가-힣]', '', 'g'))], lower(regexp_replace(x, '[^0-9A-Za-z가-힣]', '', 'g')))), lambda x: x <> '' AND x <> 'unknown') AS l FROM words, names)
        SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM tags""",
    "tag_jaccard": f"WITH {TAGS} SELECT a.p_partkey, round(tag_score, 5) AS score, round(tag_coverage, 5) AS coverage, matched, conflicts FROM (SELECT a.p_partkey, {TAG_SCORES}, array_to_string({_matched}, '|') AS matched, {_conflicts} AS conflicts FROM tags a JOIN tags b ON b.p_partkey = a.p_partkey + 7) a",
    "shown_tags": f"""WITH {TAGS}, m AS (SELECT a.p_partkey, {_common("colors")} AS c, {_common("behavior")} AS b, {" + ".join(f"CASE WHEN {_has(f)} AND len({_common(f)}) > 0 THEN 1 ELSE 0 END" for f in _FIELDS)} AS n FROM tags a JOIN tags b ON b.p_partkey = a.p_partkey + 7)
        SELECT p_partkey, list_max(c) AS color, list_max(b) AS behavior, n FROM m""",
    "feature_pivot": f"""WITH rows AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos, {_categories}[l_partkey % {len(C.CATEGORY_FIELDS) + 1} + 1] AS category, CAST(l_suppkey AS VARCHAR) AS keyword FROM lineitem),
        f AS (SELECT k, pos, coalesce({_field}, 'distinctive_features') AS field, CASE WHEN {_field} IS NULL THEN category || ':' || keyword ELSE keyword END AS word FROM rows)
        SELECT k, arg_max(word, pos) FILTER (field = 'sex') AS sex, arg_max(word, pos) FILTER (field = 'size') AS size, coalesce(string_agg(word, '|' ORDER BY pos) FILTER (field = 'colors'), '') AS colors,
          coalesce(string_agg(word, '|' ORDER BY pos) FILTER (field = 'distinctive_features'), '') AS distinctive_features FROM f GROUP BY k""",
    "haversine": f"WITH {REPORTS}, d AS (SELECT a.report_id, {_km('a', 'b')} AS km FROM reports a JOIN reports b ON b.report_id = a.report_id + 1) SELECT report_id, round(km, 4) AS km, round(exp(-km / 30.0), 5) AS score FROM d",
    "date_parse": f"WITH {REPORTS} SELECT report_id, CASE WHEN report_id % 9 = 0 OR report_id % 11 = 0 THEN NULL ELSE CAST(try_strptime(date_text, '%Y.%m.%d') AS DATE) END AS day FROM reports",
    "time_bands": f"WITH {REPORTS}, d AS (SELECT report_id, CAST(date_diff('day', event_date, DATE '2024-02-20') - report_id % 240 + 60 AS INT) AS days FROM reports) SELECT report_id, days, {_days('days')} AS score FROM d",
    "address_similarity": f"WITH {REPORTS}, {UNITS} SELECT a.report_id, {ADDRESS} AS score FROM levels a JOIN levels b ON b.report_id = a.report_id + 1",
    "spatiotemporal": f"""WITH {REPORTS}, {UNITS}, j AS (SELECT x.report_id, CASE WHEN x.report_id % 4 <> 0 THEN exp(-{_km("x", "y")} / 30.0::DOUBLE) ELSE {ADDRESS} END AS place,
          CASE WHEN x.report_id % 4 <> 0 THEN 'coordinates' WHEN {ADDRESS} IS NOT NULL THEN 'address_units' ELSE 'unavailable' END AS place_method,
          CASE WHEN x.kind = y.kind THEN NULL WHEN x.kind = 'FOUND' THEN date_diff('day', y.event_date, x.event_date) ELSE date_diff('day', x.event_date, y.event_date) END AS elapsed_days
        FROM reports x JOIN reports y ON y.report_id = x.report_id + 1 JOIN levels a ON a.report_id = x.report_id JOIN levels b ON b.report_id = y.report_id),
        t AS (SELECT *, {_days("elapsed_days")} AS time FROM j)
        SELECT report_id, round(place, 5) AS place, place_method, CAST(elapsed_days AS INT) AS elapsed_days, round(time, 5) AS time, round(CASE WHEN place IS NULL THEN time WHEN time IS NULL THEN place ELSE (0.65::DOUBLE * place + 0.35::DOUBLE * time) / (0.65::DOUBLE + 0.35::DOUBLE) END, 5) AS score FROM t""",
    "active_weights": f"WITH {POOL} SELECT request_id, round(max(w_image), 5) AS w_image, round(max(w_tags), 5) AS w_tags, 0.0::DOUBLE AS w_text, round(max(w_location), 5) AS w_location FROM weighted GROUP BY request_id",
    "rerank_full": f"WITH {POOL} SELECT request_id, record_id, image_rank, round(ranking, 5) AS ranking, rank FROM final",
    "wire_results": f"""WITH {POOL} SELECT request_id, rank, candidate_type AS "candidateType", CASE WHEN candidate_type = 'SHELTER' THEN record_id END AS "desertionNo", candidate_report_id AS "candidateReportId", round(visual, 5) AS "visualScore",
        round(ranking, 5) AS "finalScore", round(distance_km, 3) AS "distanceKm", CAST(phash_distance AS INT) AS "phashDistance", near_duplicate AS "nearDuplicate", gallery_id AS "galleryId" FROM final""",
    "behavior_radius": f"WITH {EVERY_REQUEST} SELECT request_id, behavior, radius, limited FROM requests",
    "event_hours": "SELECT event_id, round(CASE WHEN event_id % 4 <> 0 THEN date_diff('second', date_trunc('day', ts) + to_hours(event_id % 24), TIMESTAMP '2026-10-29 12:00:00') ELSE date_diff('second', date_trunc('day', ts) + to_hours(12), TIMESTAMP '2026-10-29 12:00:00') END / 3600.0, 3) AS hours FROM events",
    "grid_generate": f"WITH {EVERY_CELL} SELECT request_id, row, col, round(lat, 6) AS lat, round(lon, 6) AS lon, round(distance_m, 3) AS distance_m FROM cells",
    "osm_classify": """SELECT event_id, concat_ws('|', CASE WHEN event_id % 8 = 0 OR event_id % 5 = 2 THEN 'BUILDING_RESIDENTIAL' END, CASE WHEN event_id % 5 = 1 THEN 'COMMERCIAL' END, CASE WHEN event_id % 7 = 0 THEN 'FOOTPATH' END,
        CASE WHEN event_id % 5 = 0 OR event_id % 10 = 0 THEN 'GREEN_SPACE' END, CASE WHEN event_id % 7 = 1 THEN 'MAJOR_ROAD' END, CASE WHEN event_id % 9 = 0 THEN 'RAILWAY_BARRIER' END, CASE WHEN event_id % 7 = 2 THEN 'ROAD' END, CASE WHEN event_id % 6 = 0 THEN 'WATER' END) AS kinds FROM events""",
    "cell_feature_range_join": f"WITH {NEAR} SELECT request_id, row, col, count(*) AS n, round(min(away_m), 3) AS nearest_m FROM near GROUP BY ALL",
    "score_v1": f"WITH {V1} SELECT request_id, row, col, round(score, 5) AS score, kinds FROM v1",
    "score_v2": f"WITH {V2} SELECT request_id, row, col, round({_total}, 5) AS score, round(behavior_environment, 5) AS behavior_environment, round(accessibility, 5) AS accessibility FROM parts2",
    "eligible_cells": f"WITH {ELIGIBLE} SELECT request_id, row, col, round(score, 5) AS score FROM eligible",
    "cluster_components": f"WITH RECURSIVE {CLUSTERS} SELECT request_id, row, col, CAST(cluster_row AS INT) AS cluster_row, CAST(cluster_col AS INT) AS cluster_col FROM clustered",
    "cluster_candidates": f"WITH RECURSIVE {CANDIDATES} SELECT request_id, CAST(cluster_row AS INT) AS cluster_row, CAST(cluster_col AS INT) AS cluster_col, round(lat, 5) AS lat, round(lon, 5) AS lon, n_cells, radius_m, priority FROM candidates",
    "contributions_largest_remainder": f"""WITH RECURSIVE {CANDIDATES}, parts AS ({_all_parts}),
        r AS (SELECT *, floor(value) AS whole, row_number() OVER (PARTITION BY request_id, cluster_row, cluster_col ORDER BY round(value - floor(value), 9) DESC, place) AS n, priority - sum(floor(value)) OVER (PARTITION BY request_id, cluster_row, cluster_col) AS rest FROM parts)
        SELECT request_id, CAST(cluster_row AS INT) AS cluster_row, CAST(cluster_col AS INT) AS cluster_col, part, CAST(whole + CASE WHEN n <= rest THEN 1 ELSE 0 END AS INT) AS points FROM r""",
    "fallback_areas": f"""WITH {EVERY_REQUEST} SELECT request_id, 1 AS rank, {_core} AS radius_m, 50 AS priority, 'ENVIRONMENT_FALLBACK|LAST_SEEN_LOCATION' AS codes FROM requests
        UNION ALL SELECT request_id, 2, least({C.MOST_AREA}, greatest({_core} + 100, CAST(round_even(radius / 3, 0) AS INT))), 40, 'ENVIRONMENT_FALLBACK|EXPANDED_SEARCH_RADIUS' FROM requests""",
    "cache_reuse": f"WITH {GALLERY} SELECT gallery_id, vec_id % 3 <> 1 AND vec_id % 5 <> 0 AS hit FROM gallery",
    "incremental_since": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) - 30 FROM orders)",
    "missing_only": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)",
    "batch_assign": "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS BIGINT) AS batch FROM customer",
    "photo_rows": f"""WITH {GALLERY} SELECT vec_id, i AS photo, concat('https://img.example/', vec_id, '/', i) AS url, concat(species, ':', record_id, ':', i) AS gallery_id, i AS photo_index
        FROM gallery, (SELECT unnest([0, 2])::INT AS i) WHERE i <= vec_id % 5""",
    "ingest_summary": "SELECT count(*) AS seen, count(*) FILTER (vec_id % 5 <> 0) AS upserted, count(*) FILTER (vec_id % 5 = 0) AS skipped FROM embeddings",
    "quality_notes": """SELECT vec_id, concat_ws('|', CASE WHEN vec_id % 6 = 0 THEN '동물을 찾지 못해 원본 전체를 사용함' END, CASE WHEN vec_id % 6 <> 0 AND vec_id % 10 <= 3 THEN '동물 검출 신뢰도가 낮음' END,
        CASE WHEN vec_id % 6 <> 0 AND vec_id % 20 < 4 THEN '사진에서 동물이 너무 작음' END, CASE WHEN vec_id % 90 < 45 THEN '사진이 흐릴 가능성이 있음' END, CASE WHEN vec_id % 200 < 60 THEN '원본 해상도가 낮음' END) AS notes FROM embeddings""",
    "select_areas": f"{_sources}, {selection(1)} SELECT {_picks}n_cells, {', '.join(C.PARTS)}, array_to_string(kinds, '|') AS kinds, array_to_string(codes, '|') AS codes, reason FROM chosen1",
    "explain_topevidence": f"{_sources}, {selection(2)} SELECT {_picks}{', '.join(C.PARTS)}, array_to_string(codes, '|') AS codes, reason FROM chosen2",
    "recommend_areas": f"{_sources}, {selection(1)}, {_answer(1)} SELECT request_id, fallback_used, rank, round(lat, 5) AS lat, round(lon, 5) AS lon, radius_m, priority, array_to_string(codes, '|') AS codes, reason FROM answer1",
    "compare_rank_diff": f"{_both}, {_changes} SELECT request_id, rank, status, shift_m, score_delta, before_radius_m, after_radius_m, before_priority, after_priority, round(before_lat, 5) AS before_lat, round(after_lon, 5) AS after_lon, added, removed FROM changes",
    "compare_summaries": f"""{_both}, {_changes}, sums AS (SELECT request_id, bool_or(fb1 OR fb2) AS fallback_used, CAST(count(before_radius_m) AS INT) AS areas_before, CAST(count(after_radius_m) AS INT) AS areas_after, coalesce(max(shift_m), 0) AS most_shift_m,
        coalesce(min(score_delta), 0) AS least_delta, coalesce(max(score_delta), 0) AS most_delta FROM changes GROUP BY request_id)
        SELECT request_id, fallback_used, areas_before, areas_after, most_shift_m, least_delta, most_delta, CASE WHEN fallback_used THEN '{areas.LIMITED_COMPARISON}' ELSE printf('{_summary}', CAST(areas_before AS VARCHAR), CAST(areas_after AS VARCHAR), CAST(round_even(most_shift_m, 1) AS VARCHAR), {_signed("least_delta")}, {_signed("most_delta")}) END AS summary FROM sums""",
    "metadata_query": f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'FOUND' ELSE 'LOST' END AS report_type, {_sexes} AS sex, {_colors} AS colors, CASE WHEN p_partkey % 3 = 0 THEN 37.5::DOUBLE WHEN p_partkey % 3 = 1 THEN 37.25::DOUBLE END AS latitude,
        CASE WHEN p_partkey % 3 = 0 THEN 127.125::DOUBLE WHEN p_partkey % 3 = 1 THEN 127.5::DOUBLE END AS longitude, CASE WHEN p_partkey % 3 = 0 THEN '서울특별시 강남구' WHEN p_partkey % 3 = 1 THEN '경기도 수원시' ELSE '' END AS address,
        CASE WHEN p_partkey % 2 = 0 THEN '2024.01.05' ELSE '2024-02-06' END AS lost_at, '성별 ' || {_sexes} || CASE WHEN {_colors} = '' THEN '' ELSE '; 색상 ' || replace({_colors}, '|', ' ') END || '; ' || p_name AS metadata_text FROM part""",
    "metadata_candidate": f"""SELECT p_partkey, 'FOUND' AS report_type, CASE WHEN p_partkey % 3 = 0 THEN 'male' ELSE 'female' END AS sex, {_colors} AS colors, CASE WHEN p_partkey % 2 = 0 THEN '20240105' ELSE '20240206' END AS found_at, '' AS lost_at,
        CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS description, CASE WHEN p_partkey % 3 = 0 THEN 37.5::DOUBLE END AS latitude FROM part""",
    "tag_nfkc": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'white' ELSE lower(p_brand[1:5]) || '12' END AS tag FROM part",
    "osm_features": f"""SELECT event_id // 5 AS request_id, event_id % 100 / 4.0 AS latitude, CASE WHEN event_id % 3 = 0 THEN 127.25::DOUBLE ELSE 127.5::DOUBLE END AS longitude, CASE event_id % 4 WHEN 0 THEN 'BUILDING_RESIDENTIAL' WHEN 1 THEN 'FOOTPATH' ELSE 'WATER' END AS kinds
        FROM events WHERE event_id // 5 % 11 <> 0 AND event_id % 4 <> 3 AND event_id % 7 <> 0""",
    "osm_failed": "SELECT DISTINCT event_id // 5 AS request_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id // 5 = e.event_id // 5 AND f.event_id // 5 % 11 <> 0 AND f.event_id % 4 <> 3 AND f.event_id % 7 <> 0)",
    "osm_question": "SELECT event_id, '[out:json][timeout:10][maxsize:10000000];(' || " + " || ".join(f"'nwr[{k}](around:' || CAST(least(event_id % 5000, 3000) AS INT) || ',37.5,127.25);'" for k in ['"building"', '"landuse"', '"leisure"', f'"highway"~"^({"|".join(C.MAP_HIGHWAYS)})$"', '"natural"="water"', '"waterway"', '"railway"', '"barrier"']) + " || ');out center tags;' AS question FROM events",
    "request_problems": """SELECT event_id AS report_id, concat_ws('|', CASE WHEN event_id = 0 THEN 'reportId' END, CASE WHEN event_id % 6 = 1 THEN 'species' END, CASE WHEN event_id % 10 = 3 THEN 'size' END, CASE WHEN event_id % 13 = 0 THEN 'eventHour' END,
        CASE WHEN event_id % 17 = 0 THEN 'latitude' END, CASE WHEN event_id % 19 = 0 THEN 'mobility' END, CASE WHEN event_id % 23 = 0 AND event_id % 13 <> 0 THEN 'future' END) AS problems FROM events""",
    "request_prepared": f"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE CAST(event_id % 24 AS INT) END AS h, date_trunc('day', ts) AS d FROM events WHERE event_id > 0 AND event_id % 6 <> 1 AND event_id % 10 <> 3 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0)
        SELECT event_id AS request_id, CASE WHEN h IS NULL THEN '{areas.HOUR_ASSUMPTION}' ELSE '' END AS assumptions, event_id % 2 = 0 AS limited,
        CAST(least(3000, greatest(300, round_even(CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 1000 ELSE 1500 END * (1.8::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END), 0))) AS INT) AS radius FROM r""",
    "photo_requests": "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 1 END AS n_urls, CASE WHEN vec_id % 4 = 0 THEN 'photoUrls' WHEN vec_id % 3 = 0 THEN 'species' END AS problem FROM embeddings",
    "resolve_species": "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'dog' WHEN 1 THEN 'cat' END AS species FROM embeddings",
    "image_only_top": f"WITH {PAIRS} SELECT request_id, record_id, image_rank AS rank FROM ranked WHERE image_rank <= {C.TOP_K}",
    "top1_changed": f"WITH {POOL} SELECT a.request_id, a.record_id AS before, b.record_id AS after, a.record_id <> b.record_id AS changed FROM final b JOIN ranked a ON a.request_id = b.request_id AND a.image_rank = 1 WHERE b.rank = 1",
    "diagnose_records": f"WITH {GALLERY}, asked AS (SELECT CAST(i AS VARCHAR) AS record_id FROM (SELECT unnest(range(0, 2000, 7)) AS i)) SELECT record_id, gallery_id, gallery_id IS NOT NULL AS in_gallery FROM asked LEFT JOIN gallery USING (record_id)",
    "mock_match": """SELECT c_custkey AS request_id, m.rank, m.d AS "desertionNo", m.v AS "visualScore", CASE WHEN m.rank = 1 AND c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END END AS color
        FROM customer, (SELECT unnest([{'rank': 1, 'd': '445467202601598', 'v': 0.91234::DOUBLE}, {'rank': 2, 'd': '445467202601599', 'v': 0.84102::DOUBLE}, {'rank': 3, 'd': '445467202601600', 'v': 0.76543::DOUBLE}]) AS m)""",
    "conflicting_tags": f"WITH {TAGS}, m AS (SELECT a.p_partkey, {_has('sex')} AND len({_common('sex')}) = 0 AS sex, {_has('size')} AND len({_common('size')}) = 0 AS size FROM tags a JOIN tags b ON b.p_partkey = a.p_partkey + 7) SELECT p_partkey, CASE WHEN sex THEN 'conflict' END AS sex, CASE WHEN size THEN 'conflict' END AS size FROM m",
    "backend_results": f"""WITH {POOL} SELECT request_id, rank, image_rank AS "imageRank", record_id AS "animalId", round_even(visual, 6) AS "visualSimilarity", round_even(ranking, 6) AS "rankingScore", round_even(100 * greatest(visual, 0), 1) AS "visualDisplayScore" FROM final""",
    "console_report": f"WITH {POOL} SELECT request_id, rank, printf('%02d. ID=%s image_rank=%d', rank, record_id, image_rank) AS line FROM final",
    "text_scores": f"WITH {GALLERY} SELECT a.vec_id, round((greatest(-1, least(1, list_dot_product(a.embedding, b.embedding))) + 1) / 2, 5) AS score FROM gallery a JOIN gallery b ON b.vec_id = a.vec_id + 1",
    "gallery_scan": f"WITH {GALLERY} SELECT gallery_id FROM gallery WHERE species = 'dog' AND vec_id % 5 <> 0 AND candidate_type = 'SHELTER'",
    "gallery_manifest": f"WITH {GALLERY} SELECT count(*) AS gallery_size, string_agg(DISTINCT species, '|' ORDER BY species) AS species FROM gallery",
    "cache_compatible": "SELECT n_nationkey, n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0 AS compatible FROM nation",
    "import_rows": f"WITH {GALLERY} SELECT gallery_id, vec_id % 6 <> 0 AND vec_id % 7 <> 0 AS ok, CAST(CASE WHEN vec_id % 7 <> 0 AND vec_id % 2 = 0 THEN 9 ELSE vec_id % 4 END AS INT) AS photo_index FROM gallery",
    "sync_candidates": "SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS updated FROM orders WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) - 60 FROM orders) GROUP BY ALL",
    "sync_dry_run": "SELECT count(*) AS candidates, sum(vec_id % 5 + 1) AS prepared, 0 AS skipped, 0 AS upserted, 0 AS batches, true AS dry_run FROM embeddings",
    "sync_summary": "SELECT (SELECT count(*) FROM embeddings) AS candidates, count(*) FILTER (vec_id % 6 <> 0) AS prepared, count(*) FILTER (vec_id % 6 = 0) AS skipped, count(*) FILTER (vec_id % 6 <> 0) AS upserted, CAST(ceil(count(*) FILTER (vec_id % 6 <> 0) / 50) AS BIGINT) AS batches, false AS dry_run FROM embeddings",
    "upsert_newest": "SELECT o_custkey AS k, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey",
    "text_batches": "SELECT role, text, CAST((row_number() OVER (ORDER BY role, text) - 1) // 32 AS BIGINT) AS batch FROM (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'query' ELSE 'passage' END AS role, trim(c_name) AS text FROM customer)",
    "best_detection": "SELECT o_custkey AS k, arg_max(o_orderkey, (round(sqrt(CAST(o_totalprice AS DOUBLE) / 1000000), 12), -o_orderkey)) AS place FROM orders GROUP BY o_custkey",
    "sharpness": "WITH p AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i)), l AS (SELECT a.vec_id, -4 * a.x + sum(b.x) AS v FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.r BETWEEN 1 AND 6 AND a.c BETWEEN 1 AND 6 GROUP BY a.vec_id, a.r, a.c, a.x) SELECT vec_id, round(var_pop(v), 5) AS sharpness FROM l GROUP BY vec_id",
    "photo_counts": "SELECT sum(least(vec_id % 5 + 1, 3)) AS photos FROM embeddings",
}
