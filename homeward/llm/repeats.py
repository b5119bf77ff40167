"""Repeated passages, found with a Burrows-Wheeler transform, and texts without them.

Every stretch of ``least`` bytes that begins at more than one place is a repeat. To search a
corpus in parallel, each window of that length is assigned to the run of windows around it that
share an anchor, the 32 bytes of least hash within the window; equal windows have equal anchors,
so a run needs to be compared with the runs of its anchor only. Runs of equal bytes are taken
once, with their number: one that occurs twice is a repeat throughout. An anchor with many
different runs (a line in a third of all documents) is dealt finer: its windows by 16s, keyed by
the bytes that all 16 share, and where that is not enough one by one.

The different runs of an anchor are cut into 8-byte symbols, counted from the anchor, so that
equal windows have equal symbols; but for up to 7 bytes before and 8 bytes behind, a window is
``least`` / 8 - 1 symbols. Many runs are concatenated, sorted and transformed, and threshold-
bounded interval expansion (breadth first, backwards) sets the common prefixes of neighbouring
suffixes by increasing value until that many symbols: where none is set, the prefix is longer.
What remains is to compare the bytes before and behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import Scratch, giving_back, marked, marks, slices
from homeward.llm.hashing import ODD, mixed, rolling

LEAST = 400
GRAM = 32
CELL = 16
#: Bytes of text that are hashed at once; the places within fit in PLACE_BITS.
CHUNK, PLACE_BITS = 1 << 19, 21
#: Different runs of one anchor that are compared at once: a few, or so small a part of all.
FEW, PART = 64, 1_000_000
#: Bytes that one transform holds, but for a larger group.
BLOCK_BYTES = 1 << 19

def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` numbers in a row, by running minima within blocks."""
    n = len(x) - width + 1
    full = np.concatenate([x, np.full(-len(x) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, hot: np.ndarray | None = None, hotter: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """First window, number of windows, key and phase of each run, for texts at ``starts``.

    The phase is where, modulo 8, the anchor (or what stands for it) is from the first window.
    With ``hot`` only the windows of these anchors are given, in cells; with ``hotter`` too, only
    those of these cells, one by one."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    own = np.maximum(sizes - least + 1, 0)
    if not own.any():
        return none
    size = min(GRAM, least // 2)
    total, _, down = rolling(data)
    hashed = mixed((total[size:] - total[:-size]) * down[: len(data) - size + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (window_least((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), least - size + 1) & low).astype(np.int64)
    # windows that lie within one text; a text's last places have none, so runs of two never touch
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([own, sizes - own], axis=1).ravel())[: len(anchor)]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    which = np.searchsorted(starts, first, "right") - 1
    count = np.minimum(np.append(first[1:], len(anchor)), (starts + own)[which]) - first
    ref = anchor[first]
    key = hashed[ref]
    if hot is None:
        return first, count, key, (ref - first) % 8
    pick = np.isin(key, hot)
    if not pick.any():
        return none
    window, which = ranges(first[pick], count[pick]), np.repeat(which[pick], count[pick])
    anchor = anchor[window]
    cell = (anchor - window) // CELL + 1
    # the bytes that all windows of a cell share: from its last possible window on
    ref = anchor - (cell - 1) * CELL
    shared = np.minimum(ref, len(data) - (least - CELL + 1))
    gram = lambda at, n: (total[at + n] - total[at]) * down[at]
    key = mixed(gram(shared, least - CELL + 1) + ODD * cell.astype(np.uint64))
    if hotter is not None:
        at = np.flatnonzero(np.isin(key, hotter))
        return window[at], np.ones(len(at), np.int64), mixed(gram(window[at], least) + np.uint64(5)), np.zeros(len(at), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1]) | (np.diff(window) != 1)]))
    return window[first], np.diff(np.append(first, len(window))), key[first], (ref - window)[first] % 8


def chunks(texts: list[bytes], least: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, long ones in overlapping parts that share no window, in lots of about CHUNK bytes:
    the text's number, the part's place in it, and the part."""
    which, places, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - least + 1, 0), CHUNK):
            part = t[at : at + CHUNK + least - 1]
            which.append(i)
            places.append(at)
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield which, places, parts
                which, places, parts, held = [], [], [], 0
    if parts:
        yield which, places, parts


ROWS = "key bigint, c1 bigint, c2 bigint, doc_id bigint, th bigint, n int, phase int, m bigint, ats array<int>"


def segments(docs: DataFrame, least: int, hot: list[int] | None = None, hotter: list[int] | None = None, only: np.ndarray | None = None) -> DataFrame:
    """A row for each distinct run of a part of a text: its key, the hash of its bytes (128
    bits), its windows and phase, how often it occurs there and where. ``only``: see ``marks``."""
    hot_, hotter_ = (None if x is None else np.array(x, np.int64).view(np.uint64) for x in (hot, hotter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch if only is None else marked(batch, only), "text"):
                texts = part.column("text").to_pylist()
                for which, places, parts in chunks([t or b"" for t in texts], least):
                    sizes = np.array([len(p) for p in parts], np.int64)
                    starts = np.cumsum(sizes) - sizes
                    whole = b"".join(parts)
                    first, n, key, phase = runs(np.frombuffer(whole, np.uint8), starts, sizes, least, hot_, hotter_)
                    if not len(first):
                        continue
                    made = b"".join([xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(first.tolist(), (first + n + least - 1).tolist(), strict=True)])
                    c = np.frombuffer(made, "<i8").reshape(-1, 2)
                    of = np.searchsorted(starts, first, "right") - 1
                    at = first - starts[of] + np.array(places)[of]
                    order = np.lexsort((at, c[:, 1], c[:, 0], of))
                    same = (np.diff(of[order]) == 0) & (np.diff(c[order, 0]) == 0) & (np.diff(c[order, 1]) == 0)
                    head = np.flatnonzero(np.concatenate([[True], ~same]))
                    ends = np.append(head, len(order))
                    pick = order[head]
                    row = pa.array(np.array(which)[of[pick]])
                    cols = [key[pick].view(np.int64), c[pick, 0], c[pick, 1], part.column("doc_id").take(row), part.column("th").take(row), n[pick].astype(np.int32), phase[pick].astype(np.int32), np.diff(ends)]
                    ats = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) if isinstance(x, np.ndarray) else x for x in cols), ats], [f.split()[0] for f in ROWS.split(", ")])

    return docs.where(F.octet_length("text") >= least).mapInArrow(giving_back(run), ROWS)


def met_again(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs more than once."""
    keys = rows.groupBy("key").agg(F.sum("m").alias("all")).where("all > 1")
    return rows.join(keys.select("key"), "key", "left_semi").select(*(f.split()[0] for f in ROWS.split(", ")))


def distinct(rows: DataFrame) -> DataFrame:
    """The different runs, with their number and one place of each."""
    place = F.struct("doc_id", "th", F.element_at("ats", 1).alias("at"))
    return rows.groupBy("key", "c1", "c2").agg(F.sum("m").alias("m"), F.min("n").alias("n"), F.min("phase").alias("phase"), F.min(place).alias("rep"))


def crowded(rows: DataFrame) -> list[int]:
    """Keys of too many different runs; at most PART of them, or one for each FEW runs where that
    is fewer, so the list is small enough for every task."""
    most = max(FEW, rows.count() // PART)
    found = rows.select("key", "c1", "c2").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return [r["key"] for r in found.select("key").collect()]


def sorted_suffixes(x: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in the order of their first ``depth`` symbols or more (doubling)."""
    n = len(x)
    rank, h = x.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1 if h < n else 0
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        step = np.diff(both[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(step)])
        if step.all():
            break
        h *= 2
    return order


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def short_prefixes(bwt: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, whether it shares fewer than ``depth`` symbols with the one before.

    Intervals of suffixes that begin alike are extended backwards by each symbol before them; the
    first interval to end at a place sets the common prefix there, and only such ones go on. The
    queue is one array for each length; it ends at ``depth``, with longer prefixes never set."""
    n = len(bwt)
    by = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)  # where a suffix goes when its symbol before is put in front
    to[by] = np.arange(n)
    same = bwt[by][1:] == bwt[by][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    is_set = np.zeros(n + 1, bool)
    is_set[0] = is_set[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(depth):
        sizes = high - low + 1
        at, own = ranges(low, sizes), np.repeat(np.arange(len(low)), sizes)
        last = after[at] > high[own]
        ends, owner = to[at[last]], own[last]
        first = before[at] < low[own]
        begins = to[at[first]]
        # of one interval, both are in the order of their symbols once sorted
        key = owner * n
        order, order_b = np.argsort(key + ends), np.argsort(own[first] * n + begins)
        ends, begins = ends[order], begins[order_b]
        fresh = ~is_set[ends + 1]
        ends, begins = ends[fresh], begins[fresh]
        _, once = np.unique(ends, return_index=True)
        low, high = begins[once], ends[once]
        if not len(low):
            break
        is_set[high + 1] = True
    return is_set[:n]


def repeated(texts: list[bytes], phases: np.ndarray, least: int) -> list[np.ndarray]:
    """For each run the windows whose bytes are those of another run's window (same anchor)."""
    depth = least // 8 - 1
    pad = bytes(8)
    whole = np.frombuffer(pad + b"".join([t + pad for t in texts]) + pad, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = 8 + np.cumsum(sizes + 8) - sizes - 8
    count = (sizes - phases) // 8
    place = np.repeat(starts + phases, count) + 8 * ranges(np.zeros(len(texts), np.int64), count)
    word = lambda at: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, 8)[at]).view("<u8").ravel()
    _, symbols = np.unique(word(place), return_inverse=True)
    # behind each run a symbol of its own, so that no prefix runs on into the next one
    x = np.empty(len(place) + len(texts), np.int64)
    own = np.repeat(np.arange(len(texts)), count)
    ends = np.cumsum(count + 1) - 1
    x[ends] = np.arange(len(texts))
    spot = np.arange(len(place)) + own
    x[spot] = symbols + len(texts)
    order = sorted_suffixes(x, depth)
    short = short_prefixes(x[order - 1], depth)
    group = np.cumsum(short)
    many = np.bincount(group)[group] > 1
    back = np.full(len(x), -1, np.int64)
    back[spot] = np.arange(len(place))
    at = back[order[many]]
    found = group[many][at >= 0].astype(np.uint64)
    at = at[at >= 0]
    out: list[list[np.ndarray]] = [[] for _ in texts]
    before, behind = word(place[at] - 8), word(np.minimum(place[at] + 8 * depth, len(whole) - 8))
    for j in range(8):
        window = place[at] - j - starts[own[at]]
        valid = (window >= 0) & (window + least <= sizes[own[at]])
        left = before[valid] >> np.uint64(64 - 8 * j) if j else np.zeros(int(valid.sum()), np.uint64)
        right = behind[valid] & np.uint64((1 << 8 * (8 - j)) - 1)
        key = mixed(mixed(found[valid] * ODD + left) * ODD + right)
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        for i, w in zip(own[at[valid][again]].tolist(), window[valid][again].tolist(), strict=True):
            out[i].append(w)
    return [np.unique(np.array(w, np.int64)) for w in out]


def stretches(windows: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive numbers."""
    if not len(windows):
        return [], []
    cut = np.flatnonzero(np.diff(windows) > 1)
    return windows[np.concatenate([[0], cut + 1])].tolist(), windows[np.append(cut, len(windows) - 1)].tolist()


FOUND = "key bigint, c1 bigint, c2 bigint, froms array<int>, tos array<int>"
CUT = "key bigint, c1 bigint, c2 bigint, m bigint, phase int, body binary"


def compared(reps: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """For each run of ``reps`` that occurs once, the windows that another run has as well.

    Rows that are repeated give their runs more than once; those occur more than once anyway."""
    wanted = reps.groupBy(F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t")).agg(F.collect_list(F.struct("key", "c1", "c2", "m", "phase", F.col("rep.at").alias("at"), "n")).alias("wanted"))
    with_text = docs.select("doc_id", "th", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    one = with_text.select("text", F.explode("wanted").alias("w"))
    body = F.expr(f"substring(text, w.at + 1, w.n + {least - 1})").alias("body")
    cut = one.select("w.key", "w.c1", "w.c2", "w.m", "w.phase", body)
    cut = cut.repartition("key").sortWithinPartitions("key")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[5] for r in rows], np.array([r[4] for r in rows], np.int64), least)
        out = [(r[0], r[1], r[2], *stretches(w)) for r, w in zip(rows, found, strict=True) if r[3] == 1 and len(w)]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [f.split()[0] for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
        if rows:
            yield solve(rows)

    return cut.mapInArrow(giving_back(run), FOUND)


def found_windows(spark: SparkSession, src: DataFrame, least: int, scratch: Scratch, name: str, only: np.ndarray | None = None) -> DataFrame:
    """(d, t, hits) of each text that has windows which begin elsewhere too."""
    rows, hot, hotter = None, None, None
    for level in range(3):
        every, met = f"{name}all{level}", f"{name}rows{level}"
        scratch.written(segments(src, least, *([hot] if level else [None]), hotter if level == 2 else None, only), every)
        new = scratch.written(met_again(spark.read.parquet(scratch.path(every))), met)
        scratch.drop(every)
        crowd = crowded(new) if level < 2 else []
        scratch.release()
        if crowd:
            out = F.broadcast(spark.createDataFrame([(k,) for k in crowd], "key bigint"))  # see ``crowded``
            only = marks(new.join(out, "key", "left_semi"))
            new = new.join(out, "key", "left_anti").select(new.columns)
        rows = new if rows is None else rows.unionByName(new)
        if not crowd:
            break
        hot, hotter = (crowd, None) if level == 0 else (hot, crowd)
    runs_ = scratch.written(distinct(rows), f"{name}runs")
    keys = runs_.groupBy("key").agg(F.sum("m").alias("all"), F.count("*").alias("kinds"))
    several = keys.where("kinds > 1").select(F.col("key").alias("k"))
    found = compared(runs_.join(several, F.col("key") == F.col("k")).drop("k"), src, least)
    twice = runs_.where("m > 1").select("key", "c1", "c2", F.array(F.lit(0)).alias("froms"), F.array(F.col("n") - 1).alias("tos"))
    found = scratch.written(found.unionByName(twice), f"{name}found")
    scratch.drop(f"{name}runs")
    f = found.select(F.col("key").alias("k"), F.col("c1").alias("a"), F.col("c2").alias("b"), "froms", "tos")
    hits = rows.join(f, (F.col("key") == F.col("k")) & (F.col("c1") == F.col("a")) & (F.col("c2") == F.col("b")))
    return hits.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("ats", "froms", "tos")).alias("hits"))


SPANS = "d bigint, t bigint, n_passages bigint, n_passage_bytes bigint, longest bigint"


def spans(found: DataFrame, least: int) -> DataFrame:
    """Of each text the stretches that its windows make up: how many, their bytes, the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column("hits").to_pylist():
                begin, end = covered(hits, least)
                out.append((len(begin), int((end - begin).sum()), int((end - begin).max())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))], [f.split()[0] for f in SPANS.split(", ")])

    return found.select("d", "t", "hits").mapInArrow(giving_back(run), SPANS)


def covered(hits: list[dict], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch that the windows of ``hits`` cover."""
    begin, end = [], []
    for h in hits:
        ats = np.array(h["ats"], np.int64)[:, None]
        begin.append((ats + np.array(h["froms"], np.int64)).ravel())
        end.append((ats + np.array(h["tos"], np.int64) + least).ravel())
    begin, end = np.concatenate(begin), np.concatenate(end)
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > upto[:-1]])
    return begin[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)]


KEPT = "n_bytes bigint, n_removed bigint, n_spans bigint, starts array<int>, ends array<int>, kept binary, n_passages bigint, n_passage_bytes bigint"


def without_repeats(
    spark: SparkSession, docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), passage: int | None = None, characters: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """The columns ``carry``, doc_id, n_bytes, n_removed, n_spans, starts and ends of what is removed,
    ``kept``, n_passages and n_passage_bytes.

    Every byte in a stretch of ``least`` bytes (a multiple of 8) that begins at another place too
    goes, in all copies; texts are judged as they came. With ``characters`` a character of which a
    byte goes, goes as a whole, so what is kept is UTF-8. ``passage``, a shorter length, counts the
    stretches of that many bytes that stand elsewhere too (0 without it), and ``least`` is then
    looked for in texts that have such a stretch of its length only.

    A null text is an empty one. Repeated rows are copies of each other, each with a row; ids may be
    null. Empty table: no rows; other columns are ignored, and may have any names.
    """
    if any(n % 8 or n < 16 for n in (least, passage or least)) or (passage or 0) > least:
        raise ValueError("lengths must be multiples of 8, at least 16; a passage no longer than the stretches that go")
    scratch = scratch or Scratch(spark, "repeats")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    kinds_ = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    slim = src.select("doc_id", "th", "text")
    if passage:
        told = scratch.written(spans(found_windows(spark, slim, passage, scratch, "passages-"), passage), "spans")
        for step in ("rows0", "rows1", "rows2", "found"):
            scratch.drop(f"passages-{step}")
        only = marks(told.where(F.col("longest") >= least).select(F.col("t").alias("th")))
        per = found_windows(spark, slim, least, scratch, "", only).withColumnsRenamed({"d": "d2", "t": "t2"})
        per = told.join(per, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left").select("d", "t", "hits", "n_passages", "n_passage_bytes")
    else:
        per = found_windows(spark, slim, least, scratch, "").withColumns({c: F.lit(0).cast("bigint") for c in ("n_passages", "n_passage_bytes")})
    joined = src.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    joined = joined.select("doc_id", "text", "hits", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_passages", "n_passage_bytes")), *(f"_{i}" for i in range(len(carry))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for t, hits in zip(part.column("text").to_pylist(), part.column("hits").to_pylist(), strict=True):
                    out.append(removed(t, hits or [], least, characters))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)), *part.columns[3:]], ["doc_id", *(f.split()[0] for f in KEPT.split(", ")), *(f"_{i}" for i in range(len(carry)))])

    return joined.mapInArrow(giving_back(cut), "doc_id bigint, " + KEPT + kinds_).withColumnsRenamed({f"_{i}": c for i, c in enumerate(carry)})


def removed(text: bytes, hits: list[dict], least: int, characters: bool = False) -> tuple:
    """Counts, spans and what is left of a text without the windows of its hits."""
    if not hits:
        return len(text), 0, 0, [], [], text
    begin, end = (x.tolist() for x in covered(hits, least))
    if characters:
        inner = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
        wide: list[list[int]] = []
        for a, b in zip(begin, end, strict=True):
            while inner(a) and a:
                a -= 1
            while inner(b):
                b += 1
            if wide and a <= wide[-1][1]:
                wide[-1][1] = max(b, wide[-1][1])
            else:
                wide.append([a, b])
        begin, end = [a for a, _ in wide], [b for _, b in wide]
    kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
    return len(text), len(text) - len(kept), len(begin), begin, end, kept
