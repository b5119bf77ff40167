"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into full pieces, the first one shorter. All that
packing needs to know of a piece is its length, so the plan is made on the counts of lengths (at
most one number per length up to the capacity, whatever the input's size) and then dealt out:
the n-th piece of a length gets the n-th place that the plan has for this length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import Scratch, giving_back, slices
from homeward.llm.ranks import numbered
from homeward.llm.tokens import codec

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: all full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, its length and its ids' crc32."""
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "t"):
                flat, ends = c.batch([t or "" for t in part.column("t").to_pylist()])
                rows: list[tuple] = []
                at = 0
                for k, stop in zip(part.column("k").to_pylist(), ends.tolist(), strict=True):
                    ids = np.append(flat[at:stop], np.uint32(end_id)).astype("<u4")
                    at = stop
                    for i, (s, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[s : s + n].tobytes()
                        rows.append((k, i, s, n, zlib.crc32(own), own))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[2:5])]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return src.mapInArrow(giving_back(run), PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on counts of lengths: (lengths in a bin, number of such bins), in order.

    A bin takes the longest piece left, then again and again the longest that fits. Then its
    smallest piece makes way for two others that together fill the widened gap more closely,
    if there are any; of equally close pairs the one with the longest piece goes in. The next
    bin would be filled alike until a length it uses runs out, so all of these are made at once.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} ids does not fit a sequence of {capacity}")
        left[n] = c
    out = []
    while left.any():
        spare = left.copy()
        room, filled = capacity, []
        while room and (fits := np.flatnonzero(spare[: room + 1])).size:
            n = int(fits[-1])
            filled.append(n)
            spare[n] -= 1
            room -= n
        if room and len(filled) > 1:
            small = filled[-1]
            gap = room + small  # the small one's own place counts, it itself does not
            if pair := best_pair(spare, gap, small):
                spare[list(pair)] -= 1 if pair[0] != pair[1] else 2
                filled[-1:] = pair
        lengths, uses = np.unique(filled, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        out.append((filled, times))
    return out


def best_pair(spare: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """Two lengths left whose sum is over ``least``, at most ``gap``, and as large as can be."""
    have = np.flatnonzero(spare[: gap + 1])
    best = (least, 0, 0)
    for a in have[::-1].tolist():
        if 2 * a < best[0]:
            break  # a is the longer one
        most = min(a, gap - a)
        own = have[: np.searchsorted(have, most, "right")]
        if own.size and own[-1] == a and spare[a] < 2:
            own = own[:-1]
        if own.size and a + int(own[-1]) > best[0]:
            best = (a + int(own[-1]), a, int(own[-1]))
            if best[0] == gap:
                break
    return best[1:] if best[1] else None


def places(made: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, uses, sequence, offset): the piece of this length with number
    r in first..last, being the j-th of ``uses`` in its bin, goes to the bin ``sequence`` + j.

    A length used u times in a bin has u rows for each run of bins, one for each offset."""
    rows, seen, base = [], {}, 0
    for filled, times in made:
        at = 0
        for n in filled:
            first = seen.get(n, 0)
            rows.append((n, first, first + times - 1, base, at))
            seen[n] = first + times
            at += n
        base += times
    return rows


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Every document's pieces with the sequence and the offset where they stand.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null text is an
    empty one: one piece that holds the end id alone. Repeated rows are packed each on its own,
    null ids too; other columns are ignored; an empty table gives no rows. The longest text
    gives many pieces, each a row.
    """
    scratch = scratch or Scratch(spark, "pack")
    found = scratch.written(tokenised(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows = places(plan(counts, capacity))
    # a length's places, first to last; few rows, but not few enough for an unchecked broadcast
    spots = spark.createDataFrame(rows or [(0, 0, -1, 0, 0)], "at_length bigint, first bigint, last bigint, base bigint, offset bigint")
    spots = spots.groupBy("at_length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "base", "offset"))).alias("spots"))
    ranked = numbered(found, "length", ["doc_id", "piece", "ids_crc32"], sum(counts.values()), "r")
    joined = ranked.join(F.broadcast(spots), F.col("length") == F.col("at_length"))
    spot = F.element_at("spots", search("spots", "r"))
    return joined.withColumn("spot", spot).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("spot.base") + F.col("r") - F.col("spot.first")).alias("sequence_id"), F.col("spot.offset").alias("offset")
    )


def search(spots: str, r: str):
    """The 1-based place of the last of the sorted ``spots`` whose first is at most ``r``."""
    step = f"CASE WHEN s.hi - s.lo > 1 THEN CASE WHEN {spots}[div(s.lo + s.hi, 2)].first <= {r} THEN named_struct('lo', div(s.lo + s.hi, 2), 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', div(s.lo + s.hi, 2)) END ELSE s END"
    step = step.replace("div(s.lo + s.hi, 2)", "CAST(FLOOR((s.lo + s.hi) / 2) AS INT)")
    return F.expr(f"aggregate(sequence(1, CAST(CEIL(LOG2(size({spots}) + 1)) AS INT) + 1), named_struct('lo', 0, 'hi', size({spots})), (s, i) -> {step}, s -> s.lo + 1)")
