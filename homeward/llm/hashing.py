"""Hashes of many stretches of bytes at once."""

from __future__ import annotations

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
SIGNS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Numbers of which powers are kept at least.
LEAST = 1 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64. Of long texts they are not kept."""
    if not _powers or len(_powers[0]) < n:
        back = np.uint64(pow(int(ODD), -1, 1 << 64))
        made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, LEAST), x, np.uint64)])) for x in (ODD, back)]
        if n > 8 * LEAST:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running totals and the powers: (total[b] - total[a]) * down[a] tells bytes a to b, wherever
    they stand."""
    up, down = powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(SIGNS[data] * up[:-1])]), up, down


#: Bytes of words that are hashed at once; a longer word is hashed by itself.
LOT = 1 << 19


def words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, and their hashes. A word is a run of bytes of one kind
    (a number for each byte value); those of kind 0 part words."""
    of = kind[data]
    edge = np.empty(len(of) + 1, bool)
    np.not_equal(of[1:], of[:-1], out=edge[1:-1])
    edge[0] = edge[-1] = True
    edges = np.flatnonzero(edge)
    inner = of[edges[:-1]] != 0 if len(of) else np.zeros(0, bool)
    starts, stops = edges[:-1][inner], edges[1:][inner]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + LOT, "right")))
        first, last = int(starts[at]), int(stops[end - 1])
        if last - first > LOT:
            out[at] = xxhash.xxh64_intdigest(data[first:last].tobytes())
        else:
            total, _, down = rolling(data[first:last])
            a = starts[at:end] - first
            out[at:end] = mixed((total[stops[at:end] - first] - total[a]) * down[a])
        at = end
    return starts, out
