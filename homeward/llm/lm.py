"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams of all orders up to ``order`` are mixed, with weights
that depend on how often the context was seen (a bucket for each power of two). Part of the
training documents is deleted from the counts while the weights are learned: expectation-
maximisation raises the likelihood of that part under the counts of the others. The model then
uses the counts of all training documents.

How the counts get to where they are needed: documents are dealt into blocks of a few MB. A block
sends each of its distinct n-grams once, as a 64-bit hash with its own count, to one of as many
parts; a part adds up what the blocks sent and answers each block in the order it asked. So a
frequent word costs a number per block, not per occurrence, no part knows more than its share of
the n-grams, and nothing is gathered on the driver but the mixture weights. Beyond FAN parts a block
sends to groups of parts, where what some blocks sent is added up before it goes on to the parts,
and answers come back the same way: so a block makes FAN rows at most, however large the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import Scratch, fold, giving_back, input_bytes, pieces, then_back
from homeward.llm.hashing import mixed, words

FOLDS = 10
#: Of the folds: scored only, and deleted while the weights are learned. The others are counted.
HELD_OUT, DELETED = 0, 1
BLOCK_BYTES = 4 << 20
PART_BYTES = 8 << 20
#: Parts, or groups of parts, that a block sends to at most.
FAN = 1024
STATS = -(1 << 31)
LAST_BUCKET = 40
LEAST_WEIGHT = 1e-6
#: The bits of an n-gram's hash that its part does not tell.
LOW = np.uint64((1 << 40) - 1)
#: White space is 0, all else is part of a word.
WORDS = np.array([0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256)], np.uint8)
#: What stands before a text and behind it; no word has the hash of either by more than chance.
BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


class Block:
    """The n-grams of a block's documents: the hash of those that end at each token."""

    def __init__(self, texts: list[bytes | None], order: int):
        data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]).lower(), np.uint8)
        ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
        starts, found = words(data, WORDS)
        of = np.searchsorted(ends, starts, "right")
        pad = order - 1
        self.sizes = np.bincount(of, minlength=len(texts)) + 1
        n = len(found) + (pad + 1) * len(texts)
        stream = np.full(n, BEGIN, np.uint64)
        stream[np.arange(len(found)) + of * (pad + 1) + pad] = found
        self.tokens = np.ones(n, bool)
        first = np.cumsum(self.sizes + pad) - self.sizes
        for i in range(1, pad + 1):
            self.tokens[first - i] = False
        stream[first + self.sizes - 1] = END
        self.keys = [mixed(stream)]
        for k in range(1, order):  # the n-gram of k + 1 that ends here: the one of k before, and this token
            longer = np.empty(n, np.uint64)
            longer[0] = 0
            longer[1:] = mixed(self.keys[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + self.keys[0][1:])
            self.keys.append(longer)

    def grams(self, k: int) -> np.ndarray:
        return self.keys[k - 1][self.tokens]

    def first(self) -> np.ndarray:
        """The place of each document's first token among all."""
        return np.cumsum(self.sizes) - self.sizes


def blocked(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """(block, id, fold, text): a third of all rows may have one text, but not one id. Deleted
    documents have blocks of their own, those below 0, so that learning weights reads no others."""
    body = F.col(text).cast("string").cast("binary")
    own = F.xxhash64(F.col(key), F.length(body))
    few = max(16, blocks // FOLDS)
    of = fold(key, FOLDS).cast("int")
    block = F.when(of == DELETED, -1 - F.pmod(own, F.lit(few))).otherwise(F.pmod(own, F.lit(blocks))).cast("int")
    return docs.select(block.alias("block"), F.col(key).cast("long").alias("id"), of.alias("fold"), body.alias("text"))


class Routes:
    """Which part each n-gram belongs to, and which group of neighbouring parts; a group is one part
    while there are few."""

    def __init__(self, parts: int, fan: int):
        self.parts, self.each = parts, 1
        if parts > fan:
            self.each = -(-parts // fan)
        self.groups = -(-parts // self.each)

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(40)).astype(np.int64) % self.parts

    def dealt(self, keys: np.ndarray, each: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in the order of their part and, in it, of their low bits; where each of the
        ``n`` groups of ``each`` parts from ``first`` on begins."""
        own = self.part(keys)
        order = np.argsort((own.astype(np.uint64) << np.uint64(40)) | (keys & LOW))
        return order, np.searchsorted(own[order] // each, np.arange(first, first + n + 1))

    def by_group(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.dealt(keys, self.each, 0, self.groups)

    def by_part(self, keys: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        """Of keys of one group, by its parts."""
        return self.dealt(keys, 1, group * self.each, self.each)


def shortened(keys: np.ndarray, k: int, whole: bool = False) -> bytes:
    """Sorted keys in few bytes: words in full, longer n-grams by their low 40 bits (the part says
    more about the others; keys of a group of parts are ``whole``), as steps of 4 bytes where all
    steps fit."""
    if k == 1 or whole:
        return b"\0" + keys.tobytes()
    steps = np.diff(keys & LOW, prepend=np.uint64(0))
    return b"\1" + steps.astype("<u4").tobytes() if int(steps.max()) < 1 << 32 else b"\0" + (keys & LOW).tobytes()


def lengthened(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8", offset=1) if b[0] == 0 else np.cumsum(np.frombuffer(b, "<u4", offset=1).astype(np.uint64), dtype=np.uint64)


ASKED = "part int, ord int, block int, keys binary, kept binary, deleted binary"
ANSWERED = "part int, ord int, block int, kept binary, deleted binary"


def asked(docs: DataFrame, order: int, routes: Routes) -> DataFrame:
    """What each block sends to each group: its distinct n-grams and how often it trains on them."""

    def ask(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        own = group.sort_by([("id", "ascending")])
        folds = np.array([HELD_OUT if x is None else x for x in own.column("fold").to_pylist()], np.int64)
        found = Block(own.column("text").to_pylist(), order)
        of = np.repeat(folds, found.sizes)
        rows = []
        for k in range(1, order + 1):
            keys, inverse = np.unique(found.grams(k), return_inverse=True)
            deleted = np.bincount(inverse[of == DELETED], minlength=len(keys))
            kept = np.bincount(inverse[(of != HELD_OUT) & (of != DELETED)], minlength=len(keys))
            by, edge = routes.by_group(keys)
            for p in range(routes.groups):
                at = by[edge[p] : edge[p + 1]]
                if len(at):
                    rows.append((p, k, block, shortened(keys[at], k, routes.each > 1), narrowed(kept[at]), narrowed(deleted[at])))
        return table_of(rows, ASKED)

    return docs.groupBy("block").applyInArrow(then_back(ask), ASKED)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def narrowed(x: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes that hold them all."""
    most = int(x.max()) if len(x) else 0
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def widened(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def answered(sent: DataFrame) -> DataFrame:
    """The counts over all blocks, for each block in the order of what it sent. For single words
    a row with block STATS has how many there are in all, and how many distinct ones."""

    def answer(group: pa.Table) -> pa.Table:
        part, k = group.column("part")[0].as_py(), group.column("ord")[0].as_py()
        keys = [lengthened(x) for x in group.column("keys").to_pylist()]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("kept", "deleted"):
            own = np.concatenate([widened(x, len(ks)) for x, ks in zip(group.column(name).to_pylist(), keys, strict=True)])
            sums.append(np.bincount(inverse, own, len(every)).astype(np.int64))  # exact below 2 ** 53
        rows, at = [], 0
        for block, ks in zip(group.column("block").to_pylist(), keys, strict=True):
            own = inverse[at : at + len(ks)]
            rows.append((part, k, block, narrowed(sums[0][own]), narrowed(sums[1][own])))
            at += len(ks)
        if k == 1:
            both = sums[0] + sums[1]
            stats = np.array([sums[0].sum(), both.sum(), (sums[0] > 0).sum(), (both > 0).sum()], "<i8")
            rows.append((part, k, STATS, stats.tobytes(), b""))
        return table_of(rows, ANSWERED)

    return sent.groupBy("ord", "part").applyInArrow(then_back(answer), ANSWERED)


def together(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some rows (whole ones), the place of each row's keys among them, and
    their sums."""
    keys = [lengthened(x) for x in group.column("keys").to_pylist()]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("kept", "deleted"):
        own = np.concatenate([widened(x, len(ks)) for x, ks in zip(group.column(name).to_pylist(), keys, strict=True)])
        sums.append(np.bincount(inverse, own, len(every)).astype(np.int64))  # exact below 2 ** 53
    return every, inverse, sums


def by_way_of_groups(sent: DataFrame, routes: Routes, chunks: int, scratch: Scratch) -> DataFrame:
    """``answered`` for blocks that send to groups of parts. In a group the rows of some blocks (a
    chunk) are added up, ask the group's parts as one, and are answered from that."""
    of = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    sent = scratch.written(sent.withColumn("chunk", of), "sent")

    def ask(rows: pa.Table) -> pa.Table:
        group, k, chunk = (rows.column(c)[0].as_py() for c in ("part", "ord", "chunk"))
        every, _, (kept, deleted) = together(rows)
        by, edge = routes.by_part(every, group)
        out = []
        for i in range(routes.each):
            at = by[edge[i] : edge[i + 1]]
            if len(at):
                out.append((group * routes.each + i, k, chunk, shortened(every[at], k), narrowed(kept[at]), narrowed(deleted[at])))
        return table_of(out, ASKED)

    found = scratch.written(answered(sent.groupBy("ord", "part", "chunk").applyInArrow(then_back(ask), ASKED)), "found")

    def back(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of([], ANSWERED)
        group, k = rows.column("part")[0].as_py(), rows.column("ord")[0].as_py()
        every, inverse, _ = together(rows)
        by, edge = routes.by_part(every, group)
        sums = np.zeros((2, len(every)), np.int64)
        for p, kept, deleted in zip(*(answers.column(c).to_pylist() for c in ("part", "kept", "deleted")), strict=True):
            at = by[edge[p - group * routes.each] : edge[p - group * routes.each + 1]]
            sums[0, at], sums[1, at] = widened(kept, len(at)), widened(deleted, len(at))
        out, at = [], 0
        for block, ks in zip(rows.column("block").to_pylist(), rows.column("keys").to_pylist(), strict=True):
            own = inverse[at : at + (n := len(lengthened(ks)))]
            out.append((group, k, block, narrowed(sums[0][own]), narrowed(sums[1][own])))
            at += n
        return table_of(out, ANSWERED)

    to = found.where(f"block <> {STATS}").withColumns({"chunk": F.col("block"), "part_group": F.floor(F.col("part") / routes.each).cast("int")})
    answers = sent.groupBy("ord", "part", "chunk").cogroup(to.groupBy("ord", "part_group", "chunk")).applyInArrow(then_back(back), ANSWERED)
    return answers.unionByName(found.where(f"block = {STATS}"))


def counted(found: Block, order: int, routes: Routes, answers: pa.Table, total: bool) -> list[np.ndarray]:
    """By order, how often the n-gram that ends at each token was counted, from the answers to a block."""
    by_part = {(k, p): (a, b) for k, p, a, b in zip(*(answers.column(c).to_pylist() for c in ("ord", "part", "kept", "deleted")), strict=True)}
    out = []
    for k in range(1, order + 1):
        keys, inverse = np.unique(found.grams(k), return_inverse=True)
        by, edge = routes.by_group(keys)
        sums = np.zeros(len(keys), np.int64)
        for p in range(routes.groups):
            at = by[edge[p] : edge[p + 1]]
            if len(at):
                kept, deleted = by_part[k, p]
                sums[at] = widened(kept, len(at))
                if total:
                    sums[at] += widened(deleted, len(at))
        out.append(sums[inverse])
    return out


def estimates(found: Block, grams: list[np.ndarray], n: int, v: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the bucket of its contexts (the longest seen decides), and the estimate of
    each order from none (all words and an unknown one alike) to the highest.

    A context is the shorter n-gram that ends at the token before; one that is all beginning is
    seen as often as there are documents."""
    first = found.first()
    out = np.zeros((len(grams[0]), len(grams) + 1))
    out[:, 0] = 1 / (v + 1)
    out[:, 1] = grams[0] / max(n, 1)
    bucket = np.zeros(len(grams[0]), np.int64)
    for k in range(2, len(grams) + 1):
        seen = np.roll(grams[k - 2], 1)
        seen[first] = docs
        out[:, k] = np.where(seen > 0, grams[k - 1] / np.maximum(seen, 1), 0)
        size = np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64) + 1, LAST_BUCKET)
        bucket = np.where(seen > 0, (k - 2) * LAST_BUCKET + size, bucket)
    return bucket, out


def usable(order: int) -> np.ndarray:
    """Which orders a bucket can mix: those of contexts longer than its own were never seen."""
    n = (order - 1) * LAST_BUCKET + 1
    bucket = np.arange(n)
    highest = np.where(bucket == 0, 1, 2 + (bucket - 1) // LAST_BUCKET)
    return np.arange(order + 1)[None, :] <= highest[:, None]


def maximised(points: DataFrame, order: int, rounds: int, enough: float) -> np.ndarray:
    """The weights, by bucket. Each round is one pass over the deleted documents' estimates;
    what comes to the driver is one sum for each bucket and order."""
    allowed = usable(order)
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    last = None
    for _ in range(rounds):
        now = weights

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, likely, size = np.zeros(now.shape), 0.0, 0
            for batch in batches:
                for blob in batch.column("points").to_pylist():
                    rows = np.frombuffer(blob, "<f4").reshape(-1, order + 2)
                    bucket = rows[:, 0].astype(np.int64)
                    share = now[bucket] * rows[:, 1:]
                    p = share.sum(axis=1)
                    share /= p[:, None]
                    likely += float(np.log(p).sum())
                    size += len(p)
                    for k in range(order + 1):
                        sums[:, k] += np.bincount(bucket, share[:, k], len(now))
            b, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(k), pa.array(sums[b, k])], ["b", "k", "s"])
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([0, 0]), pa.array([likely, float(size)])], ["b", "k", "s"])

        sums, told = np.zeros(now.shape), {}
        for b, k, s in points.mapInArrow(giving_back(expect), "b bigint, k bigint, s double").groupBy("b", "k").agg(F.sum("s")).collect():
            if b < 0:
                told[b] = s
            else:
                sums[b, k] = s
        size = told.get(-2, 0.0)
        if not size:
            return now
        fresh = np.where(sums.sum(axis=1, keepdims=True) > 0, sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300), now)
        fresh = np.where(allowed, np.maximum(fresh, LEAST_WEIGHT), 0)
        weights = fresh / fresh.sum(axis=1, keepdims=True)
        likely = told[-1] / size
        if last is not None and likely - last < enough:
            break
        last = likely
    return weights


def scores(spark: SparkSession, docs: DataFrame, order: int = 2, rounds: int = 12, enough: float = 1e-4, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text is an empty one: its only token is the end. A null id counts as an empty one
    when folds are dealt, and stays null. Repeated rows are each scored, and all counted. With
    no training document every word is unknown and alike. Hashes of words have 64 bits, those of
    longer n-grams 40 and what their part tells; two that meet share their counts, which a few in
    a million do. Empty table: no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(spark, "lm")
    size = input_bytes(docs, text)
    blocks, routes = pieces(size, BLOCK_BYTES, 48), Routes(pieces(size, PART_BYTES, 64), FAN)
    src = blocked(docs, key, text, blocks)
    sent = asked(src, order, routes)
    chunks = pieces(size // routes.groups, PART_BYTES, 1)
    answers = scratch.written(answered(sent) if routes.each == 1 else by_way_of_groups(sent, routes, chunks, scratch), "answers")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, np.int64)
        for batch in batches:
            for b in batch.column("kept").to_pylist():
                total += np.frombuffer(b, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], list("abcd"))

    stats = answers.where(f"block = {STATS}").select("kept").mapInArrow(giving_back(added), "a bigint, b bigint, c bigint, d bigint").agg(*(F.sum(c) for c in "abcd")).first()
    n_kept, n_all, v_kept, v_all = (int(x or 0) for x in stats)
    ends = src.where(f"fold <> {HELD_OUT}").agg(F.count("*"), F.sum((F.col("fold") != DELETED).cast("int"))).first()
    docs_all, docs_kept = int(ends[0] or 0), int(ends[1] or 0)
    answers = answers.where(f"block <> {STATS}")

    def block_of(group: pa.Table) -> tuple[pa.Table, Block, np.ndarray]:
        own = group.sort_by([("id", "ascending")])
        found = Block(own.column("text").to_pylist(), order)
        folds = np.array([HELD_OUT if x is None else x for x in own.column("fold").to_pylist()], np.int64)
        return own, found, folds

    def points(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table_of([], "points binary")
        own, found, folds = block_of(left)
        bucket, est = estimates(found, counted(found, order, routes, right, False), n_kept, v_kept, docs_kept)
        use = np.repeat(folds, found.sizes) == DELETED
        rows = np.concatenate([bucket[use, None], est[use]], axis=1).astype("<f4")
        return table_of([(rows.tobytes(),)] if len(rows) else [], "points binary")

    of_deleted = [df.where("block < 0").groupBy("block") for df in (src, answers)]
    held = scratch.written(of_deleted[0].cogroup(of_deleted[1]).applyInArrow(then_back(points), "points binary"), "points")
    weights = maximised(held, order, rounds, enough)
    scratch.drop("points")
    RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table_of([], RESULT)
        own, found, folds = block_of(left)
        grams = counted(found, order, routes, right, True)
        bucket, est = estimates(found, grams, n_all, v_all, docs_all)
        c, at = grams[0], found.first()
        base = np.add.reduceat(np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1))), at)
        full = np.add.reduceat(np.log10((weights[bucket] * est).sum(axis=1)), at)
        known = np.add.reduceat((c > 0).astype(np.int64), at)
        cols = [own.column("id").combine_chunks(), pa.array(folds == HELD_OUT), pa.array(found.sizes), pa.array(known), pa.array(np.full(len(at), n_all)), pa.array(base), pa.array(full)]
        return pa.table(dict(zip([f.split()[0] for f in RESULT.split(", ")], cols, strict=True)))

    return src.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(then_back(final), RESULT)
