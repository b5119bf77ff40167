"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary is a public file that is opened where it is used, by a path given as a
parameter; it must exist on every node. Ids come from the tokenizers library. Since no match of
the splitting pattern crosses from a word into the white space behind it, the different words of a
few MB of text are encoded once each, and the ids are put together again. Offsets come from the
bytes of the ids: which character a byte belongs to is counted in the text.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import giving_back, slices

#: Unicode's White_Space, as the pattern's \s has it (Python's own \s has four more).
WHITE = "\t-\r \x85\xa0  -     　"
#: The end of a word; no match of the pattern runs from a word into the white space behind it.
TURN = re.compile(f"[^{WHITE}][{WHITE}]")
#: White space that the quick way does not handle, alone or in pairs.
RARE = [*"\t\x0b\x0c\r", "  ", " \n", "\n ", "\n\n"]
RARE_WIDE = [*"\x85\xa0 ", *map(chr, range(0x2000, 0x200B)), *"    　"]
#: Characters whose words are looked at together, and those of words that are encoded as one text.
LOT_CHARS, JOINED_CHARS = 5 << 20, 1 << 18
#: Words that a worker remembers at most, and ids of the longest.
KNOWN_WORDS, KNOWN_IDS = 1 << 17, 32


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else 256 and up."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair that joins into a token, in the order of the joined token's rank."""
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        out += [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Known:
    """Words and their ids, in arrays: some MB, which is all a worker keeps besides the vocabulary."""

    def __init__(self, words: pa.Array, sizes: np.ndarray, flat: np.ndarray):
        self.words, self.sizes, self.flat = words, sizes, flat
        self.firsts = np.append(np.cumsum(sizes) - sizes, 0)  # the last is for words that are not there
        self.sizes = np.append(sizes, 0)

    def joined(self, words: pa.Array, firsts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, again: np.ndarray, known: np.ndarray) -> Known:
        """With those of ``words`` that are met ``again``; the others go when it becomes too many."""
        pick = np.flatnonzero(again & (known < 0) & (sizes <= KNOWN_IDS))
        old = len(self.words)
        if old + len(pick) > KNOWN_WORDS:
            pick, old = np.flatnonzero(again & (sizes <= KNOWN_IDS))[:KNOWN_WORDS], 0
        n = sizes[pick]
        ends = np.cumsum(n)
        own = flat[np.repeat(firsts[pick] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return Known(pa.concat_arrays([self.words[:old], words.take(pa.array(pick))]), np.concatenate([self.sizes[:old], n]), np.concatenate([self.flat[: int(self.sizes[:old].sum())], own]))


class Codec:
    """A byte-level vocabulary: text to ids, with offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        self.specials: list[str] = []
        if path.endswith(".json"):
            self.model = Tokenizer.from_file(path)
            self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        else:
            ranks = load_ranks(path)
            seen = lambda b: "".join(chars[x] for x in b)
            self.model = Tokenizer(models.BPE({seen(t): i for t, i in ranks.items()}, [(seen(a), seen(b)) for a, b in merges_of(ranks)], ignore_merges=True))
            self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        vocabulary = self.model.get_vocab()
        self.known = Known(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4"))
        #: Of each id the number of bytes, and whether it begins with a blank or a line end.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int32)
        self.begins = {mark: np.zeros(len(self.n_bytes), bool) for mark in " \n"}
        for t, i in vocabulary.items():
            self.n_bytes[i] = len(t.encode()) if t in self.specials else len(t)
            for mark, own in self.begins.items():
                own[i] = t[:1] == chars[ord(mark)] and t not in self.specials

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.batch([text])[0].tobytes()

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's ids end."""
        sizes, found = np.zeros(len(texts), np.int64), [np.zeros(0, "<u4")]
        lot: list[str] = []
        of: list[int] = []
        held = 0

        def done() -> None:
            flat, ends = self._lot(lot)
            found.append(flat)
            np.add.at(sizes, of, np.diff(ends, prepend=0))

        for i, t in enumerate(texts):
            for part in parted(t):
                if held + len(part) > LOT_CHARS and lot:
                    done()
                    lot, of, held = [], [], 0
                lot.append(part)
                of.append(i)
                held += len(part)
        if lot:
            done()
        return np.concatenate(found), np.cumsum(sizes)

    def _lot(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """In a plain text every white space is one blank or one line end between two words, so
        its ids are those of its words, of which each is encoded once."""
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        flat, ends = self._words([texts[i] for i in plain])
        if len(plain) == len(texts):
            return flat, ends
        out = dict(zip(plain, np.split(flat, ends)[: len(plain)], strict=True))
        for i in set(range(len(texts))) - set(plain):
            out[i] = self._encoded(texts[i])
        every = [out[i] for i in range(len(texts))]
        return np.concatenate(every), np.cumsum([len(x) for x in every])

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        # a line end before the first word, so that each word has a sign before it
        split = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        at = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        known = pc.index_in(words, self.known.words).fill_null(-1).to_numpy()
        new = np.flatnonzero(known < 0)
        firsts, sizes = self.known.firsts[known], self.known.sizes[known]
        on_line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)[new]
        flat, total = [self.known.flat], len(self.known.flat)
        for mark, own in ((" ", new[~on_line]), ("\n", new[on_line])):
            ids, n = self._joined(mark, [w.removeprefix("\n") for w in words.take(pa.array(own)).to_pylist()])
            sizes[own], firsts[own] = n, total + np.cumsum(n) - n
            flat.append(ids)
            total += len(ids)
        flat_ids = np.concatenate(flat)
        again = np.bincount(codes, minlength=len(words)) > 1
        self.known = self.known.joined(words, firsts, sizes, flat_ids, again, known)
        first, count = firsts[codes], sizes[codes]
        heads = at[:-1]
        first[heads] += 1  # the line end before the first word is not the text's own
        count[heads] -= 1
        ends = np.cumsum(count)
        return flat_ids[np.repeat(first - ends + count, count) + np.arange(int(ends[-1]))], ends[at[1:] - 1]

    def _joined(self, mark: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that have ``mark`` before them, and how many each has. They are encoded
        as one text; where a word begins, its first id tells."""
        flat, sizes, start, held = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0, 0
        for i, w in enumerate(words):
            held += len(w) + 1
            if held >= JOINED_CHARS or i + 1 == len(words):
                ids = self._encoded(mark + mark.join(words[start : i + 1]))
                at = np.flatnonzero(self.begins[mark][ids])
                if len(at) != i + 1 - start:
                    raise ValueError("the vocabulary joins words over white space")
                flat.append(ids)
                sizes.append(np.diff(np.append(at, len(ids))))
                start, held = i + 1, 0
        return np.concatenate(flat), np.concatenate(sizes)

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, text: str) -> bytes:
        return packed(self.model.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in RARE) or any(s in text for s in self.specials):
            return False
        return text.isascii() or not any(x in text for x in RARE_WIDE)

    def offsets(self, texts: list[str], flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each of the ids in characters of its text; those of a split character
        share it. From the ids' bytes: the characters before each byte are counted."""
        whole = np.frombuffer("".join(texts).encode(), np.uint8)
        upto = np.cumsum((whole & 0xC0) != 0x80, dtype=np.int32)  # the character that holds the byte, from 1
        stops = np.cumsum(self.n_bytes[flat], dtype=np.int64)
        if len(flat) and stops[-1] != len(whole):
            raise ValueError("the ids are not those of the texts")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        before = np.repeat(np.cumsum(sizes) - sizes, np.diff(ends, prepend=0))
        return (upto[stops - self.n_bytes[flat]] - 1 - before).astype(np.int32), (upto[stops - 1] - before).astype(np.int32)


def parted(text: str) -> Iterator[str]:
    """A long text in parts, cut before white space behind a word, where no match runs on."""
    at = 0
    while len(text) - at > LOT_CHARS and (m := TURN.search(text, at + LOT_CHARS // 2)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:] if at else text


@functools.lru_cache(maxsize=4)
def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of each id, without the parts that only encoding needs."""
    if not path.endswith(".json"):
        return {i: t for t, i in load_ranks(path).items()}
    back = {c: b for b, c in enumerate(byte_chars())}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    table = {i: bytes(back[c] for c in t) for t, i in found["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in found["added_tokens"]}


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


def joined_bytes(ids: np.ndarray, table: dict[int, bytes]) -> bytes:
    """What the ids stand for. Characters split over ids are whole again, as bytes are joined
    before anything is read as UTF-8."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode(df: DataFrame, key: str, text: str, path: str, with_offsets: bool = False, with_decoded: bool = False) -> DataFrame:
    """One row per row of ``df``: the key and ``ids`` (array of int).

    with_offsets adds ``starts`` and ``ends``, in characters; with_decoded adds ``packed``, the ids
    as little-endian unsigned 32-bit integers, and ``decoded``, the bytes that the ids stand for (as
    ``decode`` finds them, but in the same task). A null text has no ids, as an empty one; a null key
    stays null; repeated rows are each encoded; an empty table gives an empty table; further columns
    of ``df`` are left behind. Long texts are not cut.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        table = byte_table(path) if with_decoded else {}
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [t or "" for t in part.column("t").to_pylist()]
                flat, ends = c.batch(texts)
                cols = [part.column("k"), lists(flat, ends)]
                if with_offsets:
                    cols += [lists(x, ends) for x in c.offsets(texts, flat, ends)]
                if with_decoded:
                    own = np.split(flat, ends)[: len(ends)]
                    cols += [pa.array([x.tobytes() for x in own], pa.binary()), pa.array([joined_bytes(x, table) for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["k", "ids", *(["starts", "ends"] if with_offsets else []), *(["packed", "decoded"] if with_decoded else [])]
    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(giving_back(run), f"k {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets + ", packed binary, decoded binary" * with_decoded)
    return out.withColumnRenamed("k", key)


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids as ``out``, and ``ids`` packed as ``out``_ids.

    Packed: little-endian unsigned 32-bit integers. A null list decodes as an empty one. An id
    that the vocabulary lacks is an error. All columns of ``df`` stay; those named like the new
    ones are replaced.
    """
    own = [c for c in df.columns if c.lower() not in (out.lower(), f"{out}_ids".lower())]
    src = df.select(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(own.index(ids))
                flat = col.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                sizes = np.array([0 if n is None else n for n in col.value_lengths().to_pylist()], np.int64)
                each = np.split(flat, np.cumsum(sizes))[: len(sizes)]
                new = [pa.array([joined_bytes(x, table) for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*own, out, f"{out}_ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(giving_back(run), f"{kinds}, `{out}` binary, `{out}_ids` binary")
