"""Constants of matching and of search areas."""

# Ranking of matches.
NEAR_DUPLICATE_BITS = 6
FAR_PHASH = -65
POOL, TOP_K = 100, 12
RERANK_WEIGHTS = {"image": 0.75, "tags": 0.15, "text": 0.00, "location": 0.10}
LOCATION_SHARE, TIME_SHARE = 0.65, 0.35
LOCATION_DECAY_KM = 30.0
EARTH_KM = 6371.0088
EARTH_M = 6_371_008.8
SPECIES = {"강아지": "dog", "고양이": "cat"}
TEXT_RERANK_WEIGHTS = {"image": 0.70, "tags": 0.15, "text": 0.05, "location": 0.10}
TEXT_BATCH = 32

# Tag fields in order, with their weights.
TAG_WEIGHTS = {
    "sex": 0.7,
    "colors": 1.0,
    "patterns": 1.3,
    "coat_length": 0.6,
    "ear_shape": 0.8,
    "tail_shape": 0.8,
    "size": 0.5,
    "distinctive_features": 1.5,
    "accessories": 1.2,
    "body_condition": 0.7,
    "behavior": 0.4,
}
#: Fields that conflict where both sides have values and share none.
EXCLUSIVE_TAGS = ("sex", "coat_length", "ear_shape", "tail_shape", "size")
#: Fields that gather all keywords; in the others the last one counts.
LIST_TAGS = ("colors", "patterns", "distinctive_features", "accessories", "body_condition", "behavior")

# The canonical name of each alias of a tag (without blanks and signs, upper case).
TAG_ALIASES = {
    "M": "male",
    "MALE": "male",
    "수": "male",
    "수컷": "male",
    "남아": "male",
    "F": "female",
    "FEMALE": "female",
    "암": "female",
    "암컷": "female",
    "여아": "female",
    "Q": "unknown",
    "U": "unknown",
    "UNKNOWN": "unknown",
    "미상": "unknown",
    "모름": "unknown",
    "흰": "white",
    "흰색": "white",
    "백색": "white",
    "화이트": "white",
    "검": "black",
    "검정": "black",
    "검정색": "black",
    "검은색": "black",
    "흑색": "black",
    "블랙": "black",
    "갈": "brown",
    "갈색": "brown",
    "밤색": "brown",
    "브라운": "brown",
    "황색": "tan",
    "연갈색": "tan",
    "베이지": "tan",
    "황갈색": "tan",
    "크림": "cream",
    "크림색": "cream",
    "회색": "gray",
    "회": "gray",
    "그레이": "gray",
    "노랑": "yellow",
    "노란색": "yellow",
    "주황": "orange",
    "주황색": "orange",
    "치즈": "orange",
    "삼색": "tricolor",
    "삼색이": "tricolor",
    "고등어": "tabby",
    "줄무늬": "tabby",
    "태비": "tabby",
    "턱시도": "tuxedo",
    "점박이": "spotted",
    "얼룩": "spotted",
    "얼룩무늬": "spotted",
    "단모": "short_coat",
    "짧은털": "short_coat",
    "장모": "long_coat",
    "긴털": "long_coat",
    "중모": "medium_coat",
    "직립": "upright_ears",
    "쫑긋귀": "upright_ears",
    "선귀": "upright_ears",
    "처진귀": "floppy_ears",
    "접힌귀": "folded_ears",
    "말린꼬리": "curled_tail",
    "짧은꼬리": "short_tail",
    "긴꼬리": "long_tail",
    "소형": "small",
    "중형": "medium",
    "대형": "large",
}
# Report categories and the tag field of each; fields and the category shown.
CATEGORY_FIELDS = {
    "성별": "sex",
    "털색": "colors",
    "색상": "colors",
    "색": "colors",
    "무늬": "patterns",
    "털길이": "coat_length",
    "귀": "ear_shape",
    "꼬리": "tail_shape",
    "크기": "size",
    "특징": "distinctive_features",
    "눈/얼굴": "distinctive_features",
    "착용 중": "accessories",
    "몸 상태": "body_condition",
    "행동": "behavior",
}
FIELD_CATEGORIES = {
    "sex": "성별",
    "colors": "털색",
    "patterns": "무늬",
    "coat_length": "털길이",
    "ear_shape": "귀",
    "tail_shape": "꼬리",
    "size": "크기",
    "distinctive_features": "특징",
    "accessories": "착용 중",
    "body_condition": "몸 상태",
    "behavior": "행동",
}

# Search areas.
GRID_M, INFLUENCE_M, BUCKET_M, TILE_M = 200, 300, 300, 2400
LEAST_RADIUS, MOST_RADIUS = 300, 3000
LEAST_AREA, MOST_AREA, LEAST_AREAS, MOST_AREAS = 150, 500, 2, 3
SCORE_FLOOR, SCORE_BAND, CLUSTER_BASE_M, OVERLAP = 50, 12, 100, 0.6
SIZE_RADIUS = {"소형": 500, "중형": 1000, "대형": 1500}
HOUR_FACTORS = [(6, 0.6), (24, 1.0), (72, 1.4), (None, 1.8)]
ACTIVITY_FACTORS = {"LOW": 0.8, "MEDIUM": 1.0, "HIGH": 1.25, "UNKNOWN": 1.0}
LIMITED_FACTOR, NOISE_FACTOR, CHASE_FACTOR = 0.5, 1.1, 1.2
PARTS = {"distance": 0.30, "behavior_environment": 0.30, "corridor": 0.20, "accessibility": 0.10, "event_context": 0.10}
KINDS = ["BUILDING_RESIDENTIAL", "COMMERCIAL", "FOOTPATH", "GREEN_SPACE", "MAJOR_ROAD", "RAILWAY_BARRIER", "ROAD", "WATER"]
PREFERENCES = {
    "HUMAN_SEEKING": {"COMMERCIAL": 1.0, "BUILDING_RESIDENTIAL": 0.8, "FOOTPATH": 0.7},
    "FEARFUL": {"GREEN_SPACE": 1.0, "BUILDING_RESIDENTIAL": 0.8, "COMMERCIAL": 0.2},
    "CHASE_DRIVEN": {"GREEN_SPACE": 0.9, "FOOTPATH": 1.0, "WATER": 0.7},
    "ALOOF": {"GREEN_SPACE": 0.8, "BUILDING_RESIDENTIAL": 0.6, "FOOTPATH": 0.5},
}
CORRIDORS = {"FOOTPATH": 1.0, "GREEN_SPACE": 0.7, "WATER": 0.7, "ROAD": 0.3}
PENALTIES = {"MAJOR_ROAD": 0.7, "RAILWAY_BARRIER": 0.8, "ROAD": 0.2}
#: Days up to which (inclusive) a time score holds, beginning with gaps before the event.
DAY_SCORES = [(-2, 0.05), (-1, 0.5), (3, 1.0), (14, 0.9), (30, 0.75), (90, 0.55), (180, 0.35), (None, 0.2)]

# Keys under which metadata has a field, the first that is not empty counts.
TAG_KEYS = {
    "sex": ["sex", "sexCd", "gender"],
    "colors": ["colors", "color", "colorCd"],
    "patterns": ["patterns", "pattern", "markings"],
    "coat_length": ["coat_length", "coatLength"],
    "ear_shape": ["ear_shape", "earShape"],
    "tail_shape": ["tail_shape", "tailShape"],
    "size": ["size", "body_size", "bodySize"],
    "distinctive_features": ["distinctive_features", "features", "feature_tags"],
    "accessories": ["accessories", "wearing", "착용중"],
    "body_condition": ["body_condition", "bodyCondition", "몸상태"],
    "behavior": ["behavior", "behaviour", "행동"],
}
#: Of candidates, where other keys come first.
CANDIDATE_TAG_KEYS = TAG_KEYS | {"sex": ["sexCd", "sex", "gender"], "colors": ["colorCd", "colors", "color"]}
QUERY_KEYS = {
    "report_type": ["report_type", "reportType", "type"],
    "description": ["description", "free_text", "memo"],
    "lost_at": ["lost_at", "lostAt", "eventDate", "missingAt"],
    "place": ["lost_location", "lostLocation", "location"],
    "latitude": (["latitude", "lat"], ["latitude", "lat"]),
    "longitude": (["longitude", "lng", "lon"], ["longitude", "lng", "lon"]),
    "address": (["address", "roadAddress", "place"], ["happenPlace", "address", "lostAddress"]),
}
CANDIDATE_KEYS = {
    "report_type": ["report_type", "reportType", "candidateReportType"],
    "description": ["specialMark", "special_mark", "noticeComment", "notice_comment", "description", "etcBigo"],
    "found_at": ["found_at", "foundAt", "eventDate", "happenDt", "noticeSdt"],
    "place": ["found_location", "foundLocation", "location"],
    "latitude": (["latitude", "lat", "foundLat"], ["latitude", "lat", "foundLat", "happenLat"]),
    "longitude": (["longitude", "lng", "lon", "foundLng"], ["longitude", "lng", "lon", "foundLng", "happenLng"]),
    "address": (["address", "roadAddress", "place"], ["happenPlace", "foundAddress", "address"]),
}
#: What a description calls each field.
FIELD_LABELS = {
    "sex": "성별",
    "colors": "색상",
    "patterns": "무늬",
    "coat_length": "털길이",
    "ear_shape": "귀",
    "tail_shape": "꼬리",
    "size": "크기",
    "distinctive_features": "특징",
    "accessories": "착용",
    "body_condition": "몸상태",
    "behavior": "행동",
}
# What a map is asked for.
MAP_HIGHWAYS = ["footway", "path", "pedestrian", "track", "motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street", "unclassified", "service", "road"]
MAP_MAX_BYTES = 10_000_000
# What a profile may say.
PROFILE_VALUES = {
    "activityLevel": ["LOW", "MEDIUM", "HIGH", "UNKNOWN"],
    "strangerResponse": ["APPROACH", "NEUTRAL", "AVOID", "UNKNOWN"],
    "noiseSensitivity": ["LOW", "MEDIUM", "HIGH", "UNKNOWN"],
    "chaseTendency": ["LOW", "MEDIUM", "HIGH", "UNKNOWN"],
    "mobility": ["NORMAL", "LIMITED", "UNKNOWN"],
    "escapeCause": ["DOOR_OPEN", "NOISE", "CHASE", "UNKNOWN"],
}
