"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within ``radius`` differing bits are linked. Of m blocks of bits, two such
fingerprints agree in at least m - radius whole blocks, so the top nodes of the index are the
patterns under every choice of m - radius blocks: a link lies within one of them at least, and
each is searched by itself. Below, a node's fingerprints stand in the order of their Gray rank;
runs of them form nodes that hold the bits all their members share, runs of nodes form higher
ones. Two nodes are compared on the bits that both share and the nodes above them did not, the
differences add up on the way down, and a pair of groups is dropped as a whole once they pass the
radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import Scratch, fresh, giving_back, marked, marks, slices
from homeward.llm.components import components

SEED = 42
FAN = 16
#: Pairs of fingerprints compared at once.
CHUNK = 1 << 20
#: After the first text of a bucket, so many are held against all others; so many times more in each
#: further round.
HEADS = 8
#: A fingerprint is hot if more than one row in so many has it.
HOT = 1000
#: Frequent shingles are looked for in one text of so many, and in so many bytes at least.
SAMPLE_EVERY, SAMPLE_BYTES = 4, 1 << 24
#: So many of them are held by each task at most, eight bytes each.
COMMON = 1 << 19


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of ``size`` words of the lower-cased (A-Z) text, blank-joined; fewer words: one run."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]])
    return [whole[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes, size: int) -> int:
    """64 bits; a bit is set if over half the shingles' hashes have it. No words: zero."""
    hashed = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)], "<u8")
    if not len(hashed):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        ones += np.unpackbits(hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row; fp holds the 64 bits as a signed number."""
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found = np.array([fingerprint(t or b"", size) for t in part.column("t").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(giving_back(run), "doc_id bigint, fp bigint")


def top_masks(radius: int, n: int) -> list[int]:
    """Masks of all choices of blocks; more and longer ones for more fingerprints."""
    extra = 2 + sum(n > limit for limit in (1 << 23, 1 << 29, 1 << 35))
    blocks = radius + extra
    ends = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in itertools.pairwise(ends)]
    return [sum(c) for c in itertools.combinations(each, extra)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def rooted(labels: np.ndarray) -> np.ndarray:
    while (up := labels[labels]).tobytes() != labels.tobytes():
        labels = up
    return labels


def united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels with the ends of each pair under one root, the lesser."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        labels = rooted(labels)
    return labels


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def crossed(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of nodes the pairs of their children (of n), each once; and whose they are."""
    na, nb = np.minimum(FAN, n - a * FAN), np.minimum(FAN, n - b * FAN)
    which = np.repeat(np.arange(len(a)), na * nb)
    at = ranges(np.zeros(len(a), np.int64), na * nb)
    x, y = a[which] * FAN + at // nb[which], b[which] * FAN + at % nb[which]
    once = x <= y
    return x[once], y[once], which[once]


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints in Gray order, the least place each is connected to."""
    n = len(fps)
    labels = np.arange(n)
    # from the leaves up: the bits that all members have, as ones and as zeros
    levels = [(fps, ~fps)]
    while len(levels[-1][0]) > 1:
        ones, zeros = levels[-1]
        at = np.arange(0, len(ones), FAN)
        levels.append((np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)))
    # pairs of nodes, with the bits compared so far and the differences found in them
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
    while stack:
        level, a, b, seen, found = stack.pop()
        if level == 0:
            labels = united(labels, a[a != b], b[a != b])
            continue
        if level == 1 and len(a) > 1:
            # pairs of groups that are already one need no comparison
            at = np.arange(0, n, FAN)
            low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
            todo = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, seen, found = a[todo], b[todo], seen[todo], found[todo]
        each = max(1, CHUNK // (FAN * FAN))
        if len(a) > each:
            stack += [(level, a[i : i + each], b[i : i + each], seen[i : i + each], found[i : i + each]) for i in range(0, len(a), each)]
            continue
        ones, zeros = levels[level - 1]
        x, y, which = crossed(a, b, len(ones))
        shared = (ones[x] | zeros[x]) & (ones[y] | zeros[y])
        differ = found[which] + np.bitwise_count((ones[x] ^ ones[y]) & shared & ~seen[which])
        near = differ <= radius
        if near.any():
            stack.append((level - 1, x[near], y[near], shared[near], differ[near]))
    return rooted(labels)


def whole_groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut where the first ``n`` change, so that no group is parted.

    What is held is put together once, when a batch ends the group that it belongs to."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy() for c in batch.columns]
        last = np.ones(batch.num_rows, bool)  # rows of the last group, which may go on
        for c in new[:n]:
            last &= c == c[-1]
        start = int(np.argmax(last))
        goes_on = not held or all(h[-1] == c[0] for h, c in zip(held[-1][:n], new[:n], strict=True))
        if start or not goes_on:
            held.append([c[:start] for c in new])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([c[start:] for c in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(fps: DataFrame, radius: int, n: int) -> DataFrame:
    """(t, a, b): links that connect whatever distinct fingerprints ``fp`` of one ``t`` are connected.

    Within a top node only a spanning forest of its links is given, so their number follows that
    of the fingerprints, not its square."""
    masks = top_masks(radius, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tops = F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("m"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed))))
    dealt = fps.select("t", tops.alias("top"), "fp")
    dealt = dealt.select((F.col("t") * len(masks) + F.col("top.m")).cast("int").alias("m"), "top.key", "fp")
    dealt = dealt.repartition("m", "key").sortWithinPartitions("m", "key")

    def search(m: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (key[1:] != key[:-1]), [True]]))
        sizes = np.diff(edge)
        two = edge[:-1][sizes == 2]  # the commonest case, all at once
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out = [np.stack([m[two].astype(np.uint64), fp[two], fp[two + 1]])]
        for at, s in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fp[at : at + s]
            own = own[np.argsort(gray_rank(own))]
            root = linked(own, radius)
            moved = np.flatnonzero(root != np.arange(s))
            out.append(np.stack([np.full(len(moved), m[at], np.uint64), own[moved], own[root[moved]]]))
        of, a, b = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array((of // np.uint64(len(masks))).astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["t", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, key, fp in whole_groups(batches, 2):
            yield search(m.astype(np.int64), key, fp.view(np.uint64))

    return dealt.mapInArrow(giving_back(run), "t int, a bigint, b bigint")


def classes(found: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, component_id, n) of the distinct fingerprints of ``found`` (doc_id, fp); n rows have it."""
    own = scratch.written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    n = own.count()
    cc = components(scratch.written(links(own.select(F.lit(0).alias("t"), "fp"), radius, n).select("a", "b"), "links"), scratch)
    named = cc.join(own, F.col("node") == F.col("fp"))
    roots = named.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    named = named.join(roots, F.col("root") == F.col("r")).select(F.col("node"), "component")
    return own.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A null text is an empty one; texts without words have fingerprint zero and are linked like
    any other. Repeated rows each give a row. Rows with a null id take part, and a component
    that has no other id has a null one. Empty table: no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "simhash")
    found = scratch.written(fingerprints(docs, shingle, key, text), "fps")
    named = scratch.written(classes(found, radius, scratch).withColumnRenamed("fp", "f"), "named")
    # a fingerprint that very many rows have (copies, texts without words) is no key of the join:
    # there are at most HOT such, and every task may hold them
    total = found.count()
    hot = F.broadcast(named.where(F.col("n") * HOT > total).select(F.col("f").alias("h"), F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    rows = found.join(hot, F.col("fp") == F.col("h"), "left")
    shown = lambda c: ("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col(c).alias("component_id"))
    rest = rows.where("is_hot IS NULL").select("doc_id", "fp").join(named, F.col("fp") == F.col("f"))
    return rest.select(*shown("component_id")).unionByName(rows.where("is_hot").select(*shown("hot_id")))


def sketches(docs: DataFrame, shingle: int, tables: int, verify: int, key: str, text: str) -> DataFrame:
    """(id, th, size, fps): the text's hash and length, and ``tables`` fingerprints of it, of
    which each has hashes of its own."""
    salts = np.random.default_rng(11).integers(1, 1 << 64, tables, dtype=np.uint64) | np.uint64(1)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    src = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(body).alias("th"), F.octet_length(body).cast("long").alias("size"), body.alias("t"))

    def several(text: bytes) -> list[int]:
        hashed = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, shingle)], "<u8")
        if not len(hashed):
            return [0] * tables
        out = []
        for salt in salts:
            own = (hashed ^ (hashed >> np.uint64(31))) * salt
            own ^= own >> np.uint64(29)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(own), 1 << 14):
                ones += np.unpackbits(own[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found = [several(t) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["id", "th", "size", "fps"])

    return src.mapInArrow(giving_back(run), "id bigint, th bigint, size bigint, fps array<bigint>")


def shingle_sets(docs: DataFrame, size: int, only: np.ndarray) -> DataFrame:
    """(th, own): the distinct hashes of the shingles of ``t``, for texts that have their bit in ``only``
    (see ``marks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(marked(batch, only), "t"):
                found = [sorted({xxhash.xxh64_intdigest(s, SEED) - (1 << 63) for s in shingles(t, size)}) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("th"), pa.array(found, pa.list_(pa.int64()))], ["th", "own"])

    return docs.select("th", "t").mapInArrow(giving_back(run), "th bigint, own array<bigint>")


def least_shared(n: np.ndarray, share: float) -> np.ndarray:
    """The least whole numbers that are ``share`` of ``n`` or more."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def hashed_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, in order; a text without words has one, 0."""
    return [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(t, size)] or [0], np.uint64).view(np.int64)) for t in texts]


def common_shingles(rows: DataFrame, size: int, scratch: Scratch) -> np.ndarray:
    """Hashes of frequent shingles, the most frequent last, judged by a sample of ``rows`` (th, t).

    They only decide in which order shingles are taken, so any sample will do. It grows with ``rows``:
    in one of a fixed size a shingle that a fixed part of all texts has is met as often however many
    texts there are, and a bucket of texts would grow with their number before it is known."""
    every = min(SAMPLE_EVERY, max(1, (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SAMPLE_BYTES))
    sample = rows.where(F.pmod("th", F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashed_sets(part.column("t").to_pylist(), size)))], ["h"])

    counted = sample.select("t").mapInArrow(giving_back(run), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    counted = scratch.written(counted, "common")
    # as many as may be held, from the most frequent on: numbers of texts, not the shingles, are put in order
    numbers = counted.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("shingles")).orderBy(F.desc("n")).collect()
    held = np.cumsum([r.shingles for r in numbers]) if numbers else np.zeros(0, np.int64)
    least = next((r.n for r, all_ in zip(reversed(numbers), held[::-1].tolist(), strict=True) if all_ <= COMMON), 1 << 62)
    found = counted.where(F.col("n") >= least).toArrow()
    scratch.drop("common")
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    return h[np.lexsort((h, n))]


def prefixes(rows: DataFrame, size: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(token, th, n, pos): of each text's n shingles, rare ones first, as many as two texts of
    ``similarity`` cannot differ in all of; and the place of each."""
    by_hash = np.argsort(common)
    ordered = common[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows of equal text are one
        for batch in batches:
            for part in slices(batch, "t"):
                own = {h: t for h, t in zip(part.column("th").to_pylist(), part.column("t").to_pylist(), strict=True) if h not in seen}
                seen |= own.keys()
                tokens = []
                sets = hashed_sets(list(own.values()), size)
                for s in sets:
                    if len(ordered):
                        at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                        s = s[np.argsort(np.where(ordered[at] == s, by_hash[at] + 1, 0), kind="stable")]
                    tokens.append(s[: len(s) - int(least_shared(np.int64(len(s)), similarity)) + 1])
                if not tokens:
                    continue
                counts = np.array([len(x) for x in tokens])
                of = np.repeat(np.fromiter(own.keys(), np.int64, len(own)), counts)
                n = np.repeat(np.array([len(s) for s in sets], np.int32), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(of), pa.array(n), pa.array(ranges(np.zeros(len(counts), np.int64), counts).astype(np.int32))], ["token", "th", "n", "pos"])

    return rows.select("th", "t").mapInArrow(giving_back(run), "token bigint, th bigint, n int, pos int")


BUCKET = "token bigint, ths array<bigint>, ns array<int>, poss array<int>, roots array<bigint>"


def buckets(dealt: DataFrame, over: int = 1) -> DataFrame:
    """One row for each token of ``dealt`` (token, th, n, pos, root) with more than ``over``
    texts and more than one root."""
    dealt = dealt.repartition("token").sortWithinPartitions("token", "th")

    def gathered(token: np.ndarray, th: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (th[1:] != th[:-1])])
        token, th, n, pos, root = (x[once] for x in (token, th, n, pos, root))
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        starts, sizes = edge[:-1], np.diff(edge)
        take = (sizes > over) & (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts))
        starts, sizes = starts[take], sizes[take]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        at = ranges(starts, sizes)
        return pa.RecordBatch.from_arrays([pa.array(token[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x[at])) for x in (th, n, pos, root))], ["token", "ths", "ns", "poss", "roots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, 1):
            yield gathered(*columns)

    return dealt.select("token", "th", "n", "pos", "root").mapInArrow(giving_back(run), BUCKET)


def of_other_texts(found: DataFrame) -> DataFrame:
    """Of all buckets that hold the same texts, the one of the token that comes first.

    No pair is lost: shingles have one order in all texts, so the token that comes first in one of
    these texts does in each, and where it stands allows for most."""
    same = found.groupBy("ths").agg(F.min_by(F.struct("token", "ns", "poss", "roots"), F.get("poss", F.lit(0))).alias("x"))
    return same.select("x.token", "ths", "x.ns", "x.poss", "x.roots")


def rooted_buckets(found: DataFrame, roots: DataFrame, over: int) -> DataFrame:
    """``buckets`` of the texts of ``found`` under their ``roots`` (node, root)."""
    each = found.select("token", F.explode(F.arrays_zip("ths", "ns", "poss")).alias("x"))
    each = each.select("token", F.col("x.ths").alias("th"), F.col("x.ns").alias("n"), F.col("x.poss").alias("pos"))
    each = each.join(roots, F.col("th") == F.col("node"), "left").withColumn("root", F.coalesce("root", "th"))
    return buckets(each, over)


def close_pairs(found: DataFrame, similarity: float, low: int, high: int) -> DataFrame:
    """(a, b): in each bucket, the texts at the places from ``low`` to ``high`` with all behind
    them, if they have different roots, and their numbers of shingles and the token's places
    allow for ``similarity``."""

    def pairs(th: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, head: np.ndarray, behind: np.ndarray) -> pa.RecordBatch:
        x, y = np.repeat(head, behind), ranges(head + 1, behind)
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        shared = np.minimum(n[x] - pos[x], n[y] - pos[y])
        near = (root[x] != root[y]) & (small >= least_shared(large, similarity)) & (shared >= least_shared(small + large, similarity / (1 + similarity)))
        a, b = th[x[near]], th[y[near]]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64)
            th, n, pos, root = (c.flatten().to_numpy() for c in batch.columns)
            place = ranges(np.zeros(len(sizes), np.int64), sizes)
            behind = np.repeat(sizes, sizes) - place - 1
            head = np.flatnonzero((place >= low) & (place < high) & (behind > 0))
            ends = np.cumsum(behind[head])
            at = 0
            while at < len(head):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                yield pairs(th, n.astype(np.int64), pos.astype(np.int64), root, head[at:end], behind[head[at:end]])
                at = end

    return found.select("ths", "ns", "poss", "roots").mapInArrow(giving_back(run), "a bigint, b bigint").distinct()


def bitmaps(rows: DataFrame, size: int) -> DataFrame:
    """(th, n, bits): of each different text of ``rows`` (th, t) its number of shingles, and a bitmap
    of 0.6 to 1.2 times as many bits, at least 64; a bit tells whether the number of shingles on it is odd."""

    def bits(own: np.ndarray) -> bytes:
        width = max(64, 1 << int(np.ceil(np.log2(0.6 * len(own)))))
        odd = np.bincount((own & np.int64(width - 1)).astype(np.int64), minlength=width) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = hashed_sets(part.column("t").to_pylist(), size)
                yield pa.RecordBatch.from_arrays([part.column("th"), pa.array([len(x) for x in sets], pa.int32()), pa.array([bits(x) for x in sets], pa.binary())], ["th", "n", "bits"])

    return rows.select("th", "t").mapInArrow(giving_back(run), "th bigint, n int, bits binary").dropDuplicates(["th"])


def differing(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ; the longer one is folded to the shorter."""
    widths = np.array([[len(x), len(y)] for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(one), np.int64)
    for w in np.unique(widths, axis=0):
        at = np.flatnonzero((widths == w).all(axis=1))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1, w.min() // 8) for side in (one, two))
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1, dtype=np.int64)
    return out


def likely(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) without those that ``bitmaps`` show to be less alike than ``similarity``.

    No pair that is alike is lost: two bitmaps differ in no more bits than two sets in shingles. A
    bitmap of 30 shingles or more has at most a thirtieth of the bytes of their set, so pairs that
    it rejects end before sets are moved."""
    held = pairs
    for c in "ab":
        held = held.join(maps.select(F.col("th").alias(f"h{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")), F.col(c) == F.col(f"h{c}"))
    held = held.where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9).select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            near = differing(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist()) <= n * ((1 - similarity) / (1 + similarity)) + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return held.mapInArrow(run, "a bigint, b bigint")


def alike(rows: DataFrame, pairs: DataFrame, maps: DataFrame, size: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) of texts whose shingles have a Jaccard similarity of ``similarity``.

    ``maps``: the texts' ``bitmaps``."""
    pairs = scratch.written(likely(pairs, maps, similarity), f"{name}_likely")
    ends = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct(), f"{name}_ends")
    # texts are picked where they are read, by a bit each, and only their sets are shuffled
    sets = shingle_sets(rows, size, marks(ends)).join(ends, "th", "left_semi").dropDuplicates(["th"])
    sets = scratch.written(sets, f"{name}_sets")
    one, two = (sets.select(F.col("th").alias(f"h{c}"), F.col("own").alias(f"own{c}")) for c in "ab")
    both = F.size(F.array_intersect("owna", "ownb"))
    every = F.size("owna") + F.size("ownb") - both
    held = pairs.join(one, F.col("a") == F.col("ha")).join(two, F.col("b") == F.col("hb"))
    out = scratch.written(held.where(both >= F.lit(similarity) * every).select("a", "b"), name)
    for step in ("likely", "ends", "sets"):
        scratch.drop(f"{name}_{step}")
    return out


def rooted_pairs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` without those under one root of ``roots`` (node, root)."""
    out = pairs
    for c in "ab":
        out = out.join(roots.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")), F.col(c) == F.col(f"n{c}"), "left")
    return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def similar(rows: DataFrame, seeds: DataFrame, size: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): links between texts of ``rows`` (th, t) that are alike, connecting all that are.

    ``seeds`` are pairs to try first, each ``a`` once and no ``b`` an ``a``. Then all texts that
    share one of their rarest shingles meet in that shingle's bucket, which pairs of
    ``similarity`` cannot avoid; of buckets of the same texts there is one. In each, one text is held against all others, then a few, then
    eight times as many and so on; buckets all of whose texts are connected by then are left out,
    so a large group of copies costs little more than one pair for each of them.
    """
    maps = scratch.written(bitmaps(rows, size), "bitmaps")
    found = alike(rows, seeds, maps, size, similarity, scratch, "alike0")
    roots = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    dealt = prefixes(rows, size, similarity, common_shingles(rows, size, scratch)).withColumn("root", F.col("th"))
    each = scratch.written(of_other_texts(buckets(dealt)), "sets0")
    open_ = scratch.written(rooted_buckets(each, roots, 1), "buckets0")
    scratch.drop("sets0")
    low, high, step = 0, 1, 0
    while not open_.isEmpty():
        step += 1
        near = scratch.written(rooted_pairs(close_pairs(open_, similarity, low, high), roots), f"pairs{step}")
        found = found.unionByName(alike(rows, near, maps, size, similarity, scratch, f"alike{step}"))
        large = open_.where(F.size("ths") > high)
        if large.isEmpty():
            break
        roots = scratch.written(components(found, scratch, f"joined{step}-"), f"roots{step}")
        open_ = scratch.written(rooted_buckets(large, roots, high), f"buckets{step}")
        low, high = high, high * max(HEADS, 2)  # 1, 8, 64 ...
    return found


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seek: int = 2, radius: int = 4, tables: int = 6, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without near copies: of each group, the document with the least id stays.

    A group is all that is connected by pairs of texts whose runs of ``shingle`` words have a
    Jaccard similarity of ``similarity`` or more. Candidates are connected by fingerprints within
    ``radius`` bits, of runs of ``seek`` words in any of ``tables`` independent hashings; an exact
    join on the texts' rarest runs of ``shingle`` words finds the pairs that these miss. Equal
    texts are one document. Null texts are empty ones; texts without words are alike. Rows without
    an id are never dropped but for rows of equal text; repeated rows become one. All columns stay.
    """
    scratch = scratch or Scratch(spark, "near")
    found = scratch.written(sketches(docs, seek, tables, shingle, key, text), "sketches")
    texts = scratch.written(found.groupBy("th").agg(F.min("id").alias("least_id"), F.first("fps").alias("fps")).where("least_id IS NOT NULL").withColumnRenamed("th", "node"), "texts")
    each = texts.select("node", F.posexplode("fps").alias("t", "fp"))
    named = scratch.written(each.groupBy("t", "fp").agg(F.min("node").alias("least")), "named")
    n = named.count() // max(tables, 1)
    near = scratch.written(links(named.select("t", "fp"), radius, n).distinct(), "near")
    ends = [named.select(F.col("t").alias(f"t{c}"), F.col("fp").alias(f"f{c}"), F.col("least").alias(f"n{c}")) for c in "ab"]
    over = near.join(ends[0], (F.col("t") == F.col("ta")) & (F.col("a") == F.col("fa"))).join(ends[1], (F.col("t") == F.col("tb")) & (F.col("b") == F.col("fb")))
    same = each.join(named.withColumnsRenamed({"t": "u", "fp": "f"}), (F.col("t") == F.col("u")) & (F.col("fp") == F.col("f"))).where("node <> least")
    cc = components(over.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(same.select(F.col("node").alias("a"), F.col("least").alias("b"))), scratch)
    seeds = scratch.written(cc.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "seeds")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.where(F.col(key).cast("long").isNotNull()).select(F.xxhash64(body).alias("th"), body.alias("t"))
    groups = scratch.written(components(similar(rows, seeds, shingle, similarity, scratch), scratch, "groups"), "groups")
    # of each group the text with the least id stays; by the hash where texts share that id
    member = texts.select("node", "least_id").join(groups.withColumnRenamed("node", "k"), F.col("node") == F.col("k")).select("node", "root", "least_id")
    first = member.groupBy("root").agg(F.min(F.struct("least_id", "node")).alias("first")).withColumnRenamed("root", "r")
    lost = member.join(first, F.col("root") == F.col("r")).where(F.col("node") != F.col("first.node")).select(F.col("node").alias("l"))
    rows = found.select("id", "th").join(texts.select(F.col("node").alias("h"), "least_id"), F.col("th") == F.col("h")).join(lost, F.col("th") == F.col("l"), "left")
    out = rows.where(F.col("id").isNull() | (F.col("id") != F.col("least_id")) | F.col("l").isNotNull()).select(F.col("id").alias("_i"), F.col("th").alias("_h")).distinct()
    th, i, h = (fresh(c, docs.columns) for c in ("_th", "_i", "_h"))
    kept = docs.withColumn(th, F.xxhash64(body))
    out = out.withColumnsRenamed({"_i": i, "_h": h})
    kept = kept.join(out, F.col(key).cast("long").eqNullSafe(F.col(i)) & (F.col(th) == F.col(h)), "left_anti")
    return kept.dropDuplicates([key, th]).drop(th)
