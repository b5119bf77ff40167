"""Shards of near-equal bytes by a minimax contiguous partition of atomic groups.

Rows of equal text are never parted: a hash of the text places each in one of a fixed number of
cells, and the cells, in order, are the atoms. Their sizes (one number per cell, whatever the
input) decide the cuts. Built-in functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.llm.common import Scratch
from homeward.llm.ranks import numbered

CELLS = 1 << 16


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """The atoms at which shards end if each takes all that fits; None if that takes too many.

    ``ends``: running totals of the atoms' sizes."""
    cuts, held = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, held + capacity, "right"))
        cuts.append(at)
        if at == len(ends):
            return cuts
        held = int(ends[at - 1]) if at else 0
    return None


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity at which greedy shards suffice, and where they end then."""
    if not sizes:
        return 0, []
    ends = np.cumsum(np.array(sizes, np.int64))
    low, high = max(max(sizes), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy(ends, low, shards) or []


def layout(sizes: dict[int, int], shards: int) -> tuple[dict[int, int], list[int]]:
    """Cells that fill a shard of their own, with its number; the last cell of each other shard.

    A cell over the mean of what is left raises the least capacity to its own size. It gets a
    shard alone, and the search goes on over the others, else they would fill up to that size
    and leave later shards empty."""
    rest, alone = dict(sizes), {}
    while rest and len(alone) < shards - 1:
        mean = sum(rest.values()) / (shards - len(alone))
        over = [c for c in rest if rest[c] > mean]
        if not over:
            break
        big = max(over, key=lambda c: (rest[c], -c))
        alone[big] = len(alone)
        del rest[big]
    cells = sorted(rest)
    _, cuts = minimax([rest[c] for c in cells], shards - len(alone))
    return alone, [cells[c - 1] for c in cuts if c]


def shard_of(cell: Column, alone: dict[int, int], lasts: list[int]) -> Column:
    out = F.lit(len(alone))
    for last in lasts[:-1]:
        out = out + (cell > last).cast("int")
    for big, own in alone.items():
        out = F.when(cell == big, F.lit(own)).otherwise(out)
    return out.cast("int")


def assign(spark: SparkSession, docs: DataFrame, shards: int = 24, overhead: int = 8, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    A null text counts as empty, and so belongs with empty texts. Repeated rows each get a slot.
    Null ids are placed like others. An empty table gives no rows. Other columns are ignored.
    ``slot`` is gapless from 0 in each shard. If cells of equal texts outweigh a mean shard,
    sizes differ by that much, as equal texts stay together.
    """
    scratch = scratch or Scratch(spark, "shards")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(CELLS)).cast("int").alias("cell"),
    )
    slim = scratch.written(slim, "slim")
    found = slim.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # at most CELLS rows
    alone, lasts = layout({r["cell"]: r["size"] for r in found}, shards)
    dealt = slim.withColumn("shard", shard_of(F.col("cell"), alone, lasts)).drop("cell")
    out = numbered(dealt, "shard", ["doc_id", "text_crc32", "size"], sum(r["n"] for r in found), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
