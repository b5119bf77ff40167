"""Each operator against brute force, on rows with all that may be odd about them."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from homeward.llm import common, components, hashing, lm, packing, pii, quality, ranks, repeats, sharding, simhash, tokens, warc, winnow
from homeward.llm.common import Scratch, trimmed

WHITE = re.compile(rb"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def by_id(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- op1


def test_lm_base_is_exact(spark, docs, rows):
    got = lm.scores(spark, docs).collect()
    assert len(got) == len(rows)
    part = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i, _ in rows}
    words = [(i, [*WHITE.findall((t or "").encode().lower()), b"\0end"]) for i, t in rows]
    counts = Counter(w for i, ws in words if part[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in words)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == expected
    assert all(r.train_tokens == n and r.held_out == (part[r.doc_id] == 0) for r in got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_is_a_distribution(spark, order):
    """Over all known words and one unknown one, what may follow a context adds up to 1."""
    vocabulary = ["a", "b", "c", "d"]
    rnd = random.Random(1)
    texts = [(i, " ".join(rnd.choice(vocabulary) for _ in range(9))) for i in range(1, 200)]
    probes = [(1000 + j, f"a b {w}") for j, w in enumerate([*vocabulary, "unseen"])] + [(2000, "a b")]
    held = [(i, t) for i, t in texts if zlib.crc32(str(i).encode()) % 10] + [(next(k for k in itertools.count(i * 1000) if zlib.crc32(str(k).encode()) % 10 == 0), t) for i, t in probes]
    got = {r.doc_id: r for r in lm.scores(spark, spark.createDataFrame(held, "doc_id long, text string"), order).collect()}
    assert {r.held_out for i, r in got.items() if i >= 100_000} == {True}
    if order == 1:
        p = {t: got[i].score for i, t in held if i >= 100_000}
        end = p["a b"] - sum(p[f"a b {w}"] - p["a b"] for w in "ab")
        assert sum(10 ** (p[f"a b {w}"] - p["a b"]) for w in [*vocabulary, "unseen"]) + 10**end == pytest.approx(1)


def plain_model(texts, order, rounds=12, enough=1e-4):
    """The model in plain numbers: scores of all texts, and what may follow each seen context."""
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in texts}
    streams = {i: ["<"] * (order - 1) + t.lower().split() + [">"] for i, t in texts}
    grams = lambda s, k: [tuple(s[j - k + 1 : j + 1]) for j in range(order - 1, len(s))]

    def counts(folds):
        own = [s for i, s in streams.items() if fold[i] in folds]
        made = [Counter(g for s in own for g in grams(s, k)) for k in range(1, order + 1)]
        return made, sum(made[0].values()), len(made[0]), len(own)

    def estimate(context, word, model):
        made, n, v, docs = model
        out, bucket = [1 / (v + 1), made[0][(word,)] / max(n, 1)], 0
        for k in range(2, order + 1):
            before = tuple(context[-(k - 1) :])
            seen = docs if set(before) == {"<"} else made[k - 2][before]
            out.append(made[k - 1][(*before, word)] / seen if seen else 0.0)
            if seen:
                bucket = (k - 2) * lm.LAST_BUCKET + min(int(math.log2(seen)) + 1, lm.LAST_BUCKET)
        return bucket, out

    allowed = lm.usable(order)
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    kept = counts(set(range(2, 10)))
    points = [estimate(s[:j], s[j], kept) for i, s in streams.items() if fold[i] == 1 for j in range(order - 1, len(s))]
    last = None
    for _ in range(rounds if points else 0):
        sums, likely = np.zeros(weights.shape), 0.0
        for b, e in points:
            share = weights[b] * np.array(e)
            likely += math.log(share.sum())
            sums[b] += share / share.sum()
        fresh = np.where(sums.sum(axis=1, keepdims=True) > 0, sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300), weights)
        fresh = np.where(allowed, np.maximum(fresh, lm.LEAST_WEIGHT), 0)
        weights = fresh / fresh.sum(axis=1, keepdims=True)
        likely /= len(points)
        if last is not None and likely - last < enough:
            break
        last = likely
    model = counts(set(range(1, 10)))

    def p(context, word):
        bucket, e = estimate(context, word, model)
        return float(weights[bucket] @ np.array(e))

    scores = {i: sum(math.log10(p(s[:j], s[j])) for j in range(order - 1, len(s))) for i, s in streams.items()}
    words = [w for (w,) in model[0][0]]
    sums = [sum(p(c, w) for w in [*words, "never seen"]) for c in {tuple(s[j - order + 1 : j]) for s in streams.values() for j in range(order - 1, len(s))}]
    return scores, sums


@pytest.mark.parametrize(("order", "fan", "part_bytes"), [(2, 1024, 8 << 20), (3, 1024, 8 << 20), (3, 8, 100)])
def test_lm_scores_by_hand(spark, order, fan, part_bytes, monkeypatch):
    """Also where blocks send to groups of parts, in chunks."""
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "PART_BYTES", part_bytes)
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice("a bb ccc dd e f".split()) if rnd.random() < 0.9 else f"rare{rnd.randint(0, 30)}" for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    scores, sums = plain_model(texts, order)
    assert sums == pytest.approx([1.0] * len(sums))  # what ships is a distribution, whatever came before
    got = {r.doc_id: r.score for r in lm.scores(spark, spark.createDataFrame(texts, "doc_id long, text string"), order).collect()}
    assert got == pytest.approx(scores, rel=1e-4)


def test_lm_learns(spark):
    texts = [(i, " ".join(["the cat sat", "on the mat"][(i + j) % 2] for j in range(20))) for i in range(300)]
    got = lm.scores(spark, spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.7 * got[1]


def test_lm_empty(spark, empty):
    assert lm.scores(spark, empty).count() == 0


# --- op2


def repeated_bytes(texts, least):
    where = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if where[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("few", [1, 64])
@pytest.mark.parametrize("least", [16, 64, 400])
def test_repeats(spark, docs, rows, least, few, monkeypatch):
    monkeypatch.setattr(repeats, "FEW", few)
    got = repeats.without_repeats(spark, docs, least, carry=("lang", "kept")).select("doc_id", "n_bytes", "n_removed", "n_spans", "lang")
    texts = [(t or "").encode() for _, t in rows]
    expected = [(i, *r[:3], "en") for (i, _), r in zip(rows, repeated_bytes(texts, least), strict=True)]
    assert by_id(got) == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_repeats_of_random_texts(spark, monkeypatch):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 90))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    for few in (1, 64):
        monkeypatch.setattr(repeats, "FEW", few)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 48).collect()}
        assert got == dict(enumerate(repeated_bytes([t.encode() for _, t in rows], 48)))


@pytest.mark.parametrize("few", [1, 64])
def test_passages_and_repeats_in_one(spark, monkeypatch, few):
    """The longer length is looked for in fewer texts, and nothing of it is lost."""
    monkeypatch.setattr(repeats, "FEW", few)
    rnd = random.Random(15)
    parts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(20, 120))) for _ in range(14)]
    texts = ["".join(rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choice("efgh") for _ in range(60)) for _ in range(rnd.randint(0, 5))) for _ in range(80)]
    got = {r.doc_id: r for r in repeats.without_repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64, passage=32).collect()}
    raw = [t.encode() for t in texts]
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == dict(enumerate(repeated_bytes(raw, 64)))
    assert {i: (r.n_passage_bytes, r.n_passages) for i, r in got.items()} == {i: r[1:3] for i, r in enumerate(repeated_bytes(raw, 32))}
    assert any(r.n_passages > r.n_spans for r in got.values())


def test_characters_go_whole(spark):
    rnd = random.Random(3)
    signs = "日本語é😀a\ufffd"
    shared = "".join(rnd.choice(signs) for _ in range(40))
    texts = ["".join(rnd.choice(signs) for _ in range(30)) + shared[k : 40 - k] + "".join(rnd.choice(signs) for _ in range(30)) for k in range(4)]
    for r in repeats.without_repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 32, characters=True).collect():
        own = texts[r.doc_id].encode()
        exact = repeated_bytes([t.encode() for t in texts], 32)[r.doc_id]
        assert exact[1] <= r.n_removed <= exact[1] + 6 * exact[2] and r.n_removed > 0
        kept = bytes(r.kept).decode()  # whole characters only
        assert kept.encode() == b"".join(own[a:b] for a, b in zip([0, *r.ends], [*r.starts, len(own)], strict=True))


def test_prefixes_by_increasing_value():
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.integers(1, 4, 200), [0]])
    order = repeats.sorted_suffixes(x, 8)
    lcp = [0] + [next((k for k in range(201) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]), 0) for a, b in itertools.pairwise(order.tolist())]
    for depth in (1, 2, 5, 8):
        assert repeats.short_prefixes(x[order - 1], depth).tolist() == [v < depth for v in lcp]


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 12)
    rnd = random.Random(9)
    one = "".join(rnd.choice("abcdefgh") for _ in range(30_000))
    text = one + "-" + one[7000:9000]
    got = repeats.without_repeats(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_removed, got.n_spans) == (4000, 2) and list(got.starts) == [7000, 30_001]


def test_repeats_empty(spark, empty):
    assert repeats.without_repeats(spark, empty).count() == 0


# --- op3


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0


def changed(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_pseudonyms(spark):
    a, b, c = changed(spark, "card 4111 1111 1111 1111, or 4111111111111111.", "not 4111111111111112", "born 2020-02-29; 29.02.2020 02/29/2020, not 2021-02-29")
    one, two = re.findall(r"\d[\d ]{14,}\d", a)
    assert one.replace(" ", "") == two and two != "4111111111111111" and luhn(two) and re.fullmatch(r"\d{4}( \d{4}){3}", one)
    assert b == "not 4111111111111112"
    y, m, d = re.search(r"born (\d{4})-(\d\d)-(\d\d)", c).groups()
    assert f"{d}.{m}.{y} {m}/{d}/{y}, not 2021-02-29" in c and (y, m, d) != ("2020", "02", "29")


def test_pseudonyms_are_a_permutation(spark):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(1024)]
    got = changed(spark, " ".join(ips))[0].split()
    assert len(set(got)) == 1024 and all(all(0 <= int(x) < 256 for x in ip.split(".")) for ip in got)
    days = [f"19{y}-{m:02}-{d:02}" for y in range(10, 13) for m in range(1, 13) for d in range(1, 29)]
    got = changed(spark, " ".join(days))[0].split()
    assert len(set(got)) == len(days) and all("1901-01-01" <= x <= "2000-12-31" for x in got)


def test_other_kinds(spark):
    text = 'mail an.na9@mail.example.com +1 (168) 555-5254 DE89 3704 0044 0532 0130 00 token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" 123-45-6789'
    got = changed(spark, text)[0]
    assert re.fullmatch(r'mail [a-z]{2}\.[a-z]{2}\d@mail\.example\.com \+1 \(\d{3}\) \d{3}-\d{4} DE\d\d( \d{4}){4} \d\d token = "[0-9A-F]{40}" \d{3}-\d\d-\d{4}', got)
    new = re.search(r"DE[\d ]+\d", got)[0].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in new[4:] + new[:4])) % 97 == 1
    assert not set(text.split()) & set(got.split()) - {"mail", "token", "=", "+1"}
    assert changed(spark, text, key="other")[0] != got


def plain_feistel(symbols, sizes, key, kind):
    n, left = len(symbols), len(symbols) // 2

    def moved(half, of, other, step):
        hexed = hashlib.sha512("|".join([key, kind, str(step), str(n), ",".join(map(str, other))]).encode()).hexdigest()
        return [(x + int(hexed[i % 32 * 4 : i % 32 * 4 + 4], 16)) % max(size, 1) for i, (x, size) in enumerate(zip(half, of, strict=True))]

    a, b = symbols[:left], symbols[left:]
    for step in range(10):
        if step % 2 == 0:
            a = moved(a, sizes[:left], b, step)
        else:
            b = moved(b, sizes[left:], a, step)
    return a + b


def plain_permuted(text, key, kind, classes):
    own = [next((k for k in classes if c in k), None) for c in text]
    moved = plain_feistel([k.index(c) if k else 0 for c, k in zip(text, own, strict=True)], [len(k) if k else 1 for k in own], key, kind)
    return "".join(k[m] if k else c for c, k, m in zip(text, own, moved, strict=True))


def test_pseudonyms_by_hand(spark):
    """Every kind as its rules have it, in plain numbers."""
    rnd, key = random.Random(21), "a key"
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    check = lambda body: next(c for c in "0123456789" if luhn(body + c))
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    before, expected = [], []
    for _ in range(12):
        body = "4" + digits(14)
        new = plain_permuted(body, key, "card", pii.CLASSES[:1])
        before.append(body + check(body))
        expected.append(new + check(new))
        body = digits(18)
        land = f"DE{98 - number(body + 'DE00') % 97:02}"
        new = plain_permuted(body, key, "iban", [pii.CLASSES[0], pii.CLASSES[2]])
        before.append(land + body)
        expected.append(f"DE{98 - number(new + 'DE00') % 97:02}{new}")
        parts = [rnd.randint(0, 255) for _ in range(4)]
        before.append(".".join(map(str, parts)))
        expected.append(".".join(map(str, plain_feistel(parts, [256] * 4, key, "ip"))))
        name = "".join(rnd.choice("abcXYZ019._é") for _ in range(7))
        before.append(f"m{name}@mail.example")
        expected.append(f"{plain_permuted('m' + name, key, 'email', pii.CLASSES)}@mail.example")
        phone = digits(10)
        new = plain_permuted(phone, key, "phone", pii.CLASSES[:1])
        before.append(f"({phone[:3]}) {phone[3:6]}-{phone[6:]}")
        expected.append(f"({new[:3]}) {new[3:6]}-{new[6:]}")
        area = rnd.choice([x for x in range(1, 900) if x != 666])
        group, serial = rnd.randint(1, 99), rnd.randint(1, 9999)
        x = plain_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
        before.append(f"{area:03}-{group:02}-{serial:04}")
        expected.append(f"{x[0] + (2 if x[0] >= 665 else 1):03}-{x[1] + 1:02}-{x[2] + 1:04}")
        start, a, b = rnd.choice(pii.CENTURIES)
        n = rnd.randrange(a * b)
        x = plain_feistel([n // b, n % b], [a, b], key, f"date{start}")
        day = lambda k: (date.fromisoformat(start) + timedelta(days=k)).isoformat()  # noqa: B023, E731
        before.append(day(n))
        expected.append(day(x[0] * b + x[1]))
        secret = "".join(rnd.choice("0123456789abcdef") for _ in range(31)) + "f"
        before.append(secret.upper())
        expected.append(plain_permuted(secret, key, "secret", [pii.HEX_LOW]).upper())
    got = changed(spark, *(f"x {v} y" for v in before), key=key)
    assert got == [f"x {v} y" for v in expected]


def test_values_with_more_behind_or_before(spark):
    """Numbers and words beside a card or an IBAN do not hide it, and equal values stay linked."""
    card, bank = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = [card, f"{card} 12/26", "4111111111111111 123", f"12 {card}", f"{card} 123-45-6789", bank, f"{bank} 2024", f"{bank} ABCD 12", "4111 1111 1111 1112 12/26"]
    got = changed(spark, *texts)
    new, account = got[0], got[5]
    assert new != card and luhn(new.replace(" ", "")) and account != bank
    assert got[1:4] == [f"{new} 12/26", f"{new.replace(' ', '')} 123", f"12 {new}"]
    assert got[4].startswith(f"{new} ") and re.fullmatch(r"\d{3}-\d\d-\d{4}", got[4][20:]) and got[4][20:] != "123-45-6789"
    assert got[6:] == [f"{account} 2024", f"{account} ABCD 12", texts[8]]


def test_pseudonyms_leave_the_rest(spark, docs, empty):
    got = pii.pseudonymise(docs, "k")
    assert got.columns == [*docs.columns, "n_values"]
    assert by_id(got.select("doc_id", "text", "lang")) == by_id(docs.select("doc_id", "text", "lang"))
    assert got.agg(F.sum("n_values")).first()[0] == 0 and pii.pseudonymise(empty, "k").count() == 0


# --- op4




def test_edited_texts(spark, docs, rows):
    got = winnow.edited_fingerprints(docs, Scratch(spark, "t")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    expected = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        expected[i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {}
    for r in got:
        t = dict(rows)[r.doc_id]
        assert same.setdefault(t or "", r.fingerprint) == r.fingerprint


def test_winnowing_rules(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "b", "c", "dd"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 12, 13, 200)]
    df = winnow.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t", "fp").withColumn("s", winnow.shown("fp"))
    for r in df.collect():
        words = texts[r.i].split()
        found = [x.split(":") for x in r.s.split()]
        found = [(int(p), h) for p, h in found]
        places = [p for p, _ in found]
        grams = max(len(words) - winnow.K + 1, min(len(words), 1))
        assert places == sorted(places) and all(p < grams for p in places)
        hashed = {}
        for p, h in found:  # equal words, equal hashes
            assert hashed.setdefault(tuple(words[p if len(words) >= winnow.K else 0 :][: winnow.K]), h) == h
        gaps = [b - a for a, b in itertools.pairwise([-1, *places, grams])]
        assert not places and not words or max(gaps) <= winnow.WINDOW


def plain_winnowing(text, k=5, window=8):
    """place:hash of each chosen run of words, and the chosen hashes, by the rules alone."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return signed(seed)

    words = [signed(xxhash.xxh64_intdigest(w, 42)) for w in WHITE.findall(text.encode())]
    grams = [chained(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [chained(words)] if words else []
    chosen = []
    for at in range(max(1, len(grams) - window + 1) if grams else 0):
        least = min(h >> 28 for h in grams[at : at + window])
        place = max(i for i in range(at, min(at + window, len(grams))) if grams[i] >> 28 == least)  # the rightmost of equals
        if (place, least) not in chosen:
            chosen.append((place, least))
    return " ".join(f"{i}:{(h & (1 << 36) - 1):x}" for i, h in chosen), {h for _, h in chosen}


def test_winnowing_by_hand(spark, docs, rows):
    rnd = random.Random(12)
    more = [(100 + i, " ".join(rnd.choice("a b c".split()) for _ in range(rnd.randint(0, 40)))) for i in range(30)]
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    got = winnow.edited_fingerprints(df, Scratch(spark, "t")).collect()
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ordered = sorted([*rows, *more], key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = {i: t or "" for i, t in ordered if i is not None and i != 6}  # two rows have the id 6, in the order of their hashes
    by_id_ = {r.doc_id: r for r in got if r.doc_id in texts}
    for (i, t), (j, u) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        if i not in texts or i == 1 or j == 1:  # the very long one is too long for the plain way
            continue
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        own, changed, following = plain_winnowing(t), plain_winnowing(edited), plain_winnowing(u)
        r = by_id_[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own[0], changed[0])
        assert (r.near_edited, r.near_next) == pytest.approx((alike(own[1], changed[1]), alike(own[1], following[1])))


def test_a_shared_run_shares_a_fingerprint(spark):
    run = " ".join(f"s{i}" for i in range(winnow.K + winnow.WINDOW - 1))
    rows = [(1, f"{' '.join(f'x{i}' for i in range(50))} {run} tail"), (2, f"other words {run} {' '.join(f'y{i}' for i in range(70))}")]
    a, b = (set(r.h) for r in winnow.with_fingerprint(spark.createDataFrame(rows, "i long, t string"), "t", "fp").select(winnow.hashes("fp").alias("h")).collect())
    assert a & b


def test_followers_across_runs(spark):
    """Ids far apart, each in a run of its own, still follow each other."""
    ids = [0, 255, 256, 5000, 10**12, 10**12 + 1, -7]
    got = winnow.edited_fingerprints(spark.createDataFrame([(i, f"{i:>20}") for i in ids], "doc_id long, text string"), Scratch(spark, "t"))
    order = sorted(ids, reverse=True)
    expected = {a: hashlib.sha256((f"{a:>20}"[:10] + f"{b:>20}"[:10]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.edited_sha256 for r in got.collect()} == expected


def test_edited_empty(spark, empty):
    assert winnow.edited_fingerprints(empty, Scratch(spark, "t")).count() == 0


# --- op5


def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(RANKS), special_tokens={})


def test_ids_are_those_of_the_ranks(spark, docs, rows, empty):
    enc = reference()
    got = tokens.decode(tokens.encode(docs, "doc_id", "text", RANKS, with_offsets=True, with_decoded=True), "ids", RANKS, "again")
    assert got.where("again <> decoded OR again_ids <> packed").count() == 0
    expected = [(i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got.collect()) == sorted((str(i), a, b) for i, a, b in expected)
    for r in got.where("doc_id = 12").collect():
        text = dict(rows)[12]
        assert "".join(text[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == text
    assert tokens.encode(empty, "doc_id", "text", RANKS).count() == 0


def test_odd_texts_have_the_same_ids():
    enc, own = reference(), tokens.codec(RANKS)
    rnd = random.Random(5)
    signs = [*"aab  \n\t'sé日😀1!.\x85\xa0\x1c", "　", "​", "'ll", "é", "ß", "--", "00"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 5000, "ab" * 999, "<|endoftext|>"]
    flat, ends = own.batch(texts)
    for t, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert flat[a:b].tolist() == enc.encode_ordinary(t), repr(t)


def odd_texts(n, most=40):
    rnd = random.Random(8)
    signs = [*"aab  \n\t'sé日😀1!.\x85\xa0\x1c", " word", " le", "\nline", " été", "--", "00"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("path", [RANKS, JSON])
def test_offsets_are_those_of_the_library(path):
    own, texts = tokens.codec(path), [*odd_texts(400), "", "x <|endoftext|> 日本"]
    own.model.no_truncation()
    flat, ends = own.batch(texts)
    starts, stops = own.offsets(texts, flat, ends)
    for t, a, b in zip(texts, [0, *ends], ends, strict=False):
        plain = own.model.encode(t, add_special_tokens=False)
        assert flat[a:b].tolist() == plain.ids
        # the library may leave blanks out of a span; ends agree, and starts but for these
        assert [y for _, y in plain.offsets] == stops[a:b].tolist(), repr(t)
        assert all(x == s or t[s:x].isspace() for (x, _), s in zip(plain.offsets, starts[a:b].tolist(), strict=True)), repr(t)


def test_long_texts_in_parts_have_the_same_ids(monkeypatch):
    enc, own = reference(), tokens.codec(RANKS)
    texts = [" ".join(odd_texts(60)), "x" * 700, " ".join(f"word{i}" for i in range(400)), ""]
    monkeypatch.setattr(tokens, "LOT_CHARS", 64)
    monkeypatch.setattr(tokens, "JOINED_CHARS", 32)
    assert max(map(len, tokens.parted(texts[2]))) < 80
    flat, ends = own.batch(texts)
    for t, a, b in zip(texts, [0, *ends], ends, strict=False):
        assert flat[a:b].tolist() == enc.encode_ordinary(t)


def test_bytes_have_characters():
    chars = tokens.byte_chars()
    assert len(set(chars)) == 256 and chars[65] == "A" and chars[32] == "Ġ"


def test_cuts_agree_with_whole_texts():
    own = tokens.codec(JSON)
    for t in ["a  b\n\n c", "x <|endoftext|> y", " lead", "trail ", "café's 12\t3"]:
        assert own.ids(t) == own._whole(t)


# --- op6


def plain_counts(text):
    b = text.encode()
    words = WHITE.findall(b)
    lines = [x for x in b.split(b"\n") if WHITE.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    again = Counter(windows)
    covered = {j for i, w in enumerate(windows) if again[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(spark, docs, labels)
    assert {"lang", "block", "key"} <= set(got.columns)
    expected = sorted((str(i), *plain_counts(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept <= (not r.base_failed) for r in got.collect())
    assert quality.judge(spark, empty, labels).count() == 0
    assert quality.judge(spark, docs, labels.limit(0)).agg(F.max(F.abs("llr"))).first()[0] == 0


def plain_ngrams(text):
    """Words, pairs and runs of three bytes, as they are."""
    low = text.encode().lower()
    words = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+", low)
    plain = re.sub(rb"[\x20\x09-\x0d]", b" ", low)
    return words, list(zip(words, words[1:], strict=False)), [plain[i : i + 3] for i in range(len(plain) - 2)]


@pytest.mark.parametrize("lot", [16, 1 << 19])
def test_quality_ngrams(rows, lot, monkeypatch):
    texts = ["Aa bb, 12", "", "$$ aa | Bb", "x", "aa bb", *(t or "" for _, t in rows)]
    monkeypatch.setattr(quality, "LOT", lot)
    monkeypatch.setattr(hashing, "LOT", lot)
    portions = list(quality.ngrams([t.encode() for t in texts], (1 << 40,) * 3))
    for kind in range(3):
        of, hashed = (np.concatenate([p[i] for p in portions if p[0] == kind]) for i in (1, 2))
        names = {}
        for i, t in enumerate(texts):
            own = hashed[of == i].tolist()
            expected = plain_ngrams(t)[kind]
            assert len(own) == len(expected)
            for h, g in zip(own, expected, strict=True):
                assert names.setdefault(h, g) == g
        assert len(set(names.values())) == len(names)


def test_quality_score_by_hand(spark):
    rows = [(1, "Aa bb, 12"), (2, "$$ aa | bb"), (3, None), (4, "aa 12 12")]
    raw, own = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for i, t in rows:
        for kind, found in enumerate(plain_ngrams(t or "")):
            raw[kind].update(found)
            own[kind].update(found if i == 1 else [])

    def ratio(kind, g):
        n, m = sum(raw[kind].values()), sum(own[kind].values())
        if kind < 2:
            return math.log((own[kind][g] + 5) / (m * raw[kind][g] / n + 5))
        return math.log(0.9999 * own[kind][g] / m + 1e-4 / quality.BUCKETS[2]) - math.log(0.99 * raw[kind][g] / n + 1e-2 / quality.BUCKETS[2])

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.llr for r in quality.score(df, quality.fit(df, [1])).collect()}
    for i, t in rows:
        expected = sum(sum(ratio(k, g) for g in found) / max(len(found), 1) for k, found in enumerate(plain_ngrams(t or "")))
        assert got[i] == pytest.approx(expected)


def test_quality_on_held_out_labels(spark):
    """Learned from half of the labelled documents; measured on the others, and on such texts with
    letters drawn at random or out of order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ratio = quality.fit(docs, quality.trusted_ids(labels.where("doc_id % 2 = 0")))
    odd = docs.join(labels.where("doc_id % 2 = 1"), "doc_id")
    judged = quality.score(odd, ratio).where("n_words >= 50")
    got = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got[1, True] / (got[1, True] + got.get((1, False), 0)) > 0.97
    assert got[0, False] / (got[0, False] + got.get((0, True), 0)) > 0.97
    good = [r.text for r in judged.where("quality = 1 AND kept").select("text").limit(60).collect()]
    rnd = random.Random(2)
    odd_letters = ["".join(rnd.choice("qxzjvk") if "a" <= c <= "z" else c for c in t) for t in good]
    shuffled = [" ".join("".join(rnd.sample(w, len(w))) for w in t.split(" ")) for t in good]
    bad = spark.createDataFrame(list(enumerate(odd_letters + shuffled)), "doc_id long, text string")
    assert quality.score(bad, ratio).where("NOT base_failed AND kept").count() <= 1


def test_quality_trusted_bound(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality", "CAST(NULL AS INT) AS toxic")
    assert 150 < len(quality.trusted_ids(labels, 200)) < 250 and len(quality.trusted_ids(labels, 4000)) == 4000


# --- op7


def plain_fingerprint(text, size):
    words = WHITE.findall((text or "").encode().lower())
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(runs))


def test_simhash(spark, docs, rows, empty):
    got = simhash.near_duplicates(spark, docs).collect()
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            label = [label[a] if x == label[b] else x for x in label]
    least = {x: min((i for (i, _), y in zip(rows, label, strict=True) if y == x and i is not None), default=None) for x in set(label)}
    expected = Counter((i, f"{p:016x}", least[x]) for (i, _), p, x in zip(rows, prints, label, strict=True))
    assert Counter(tuple(r) for r in got) == expected
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_fingerprint_hash_is_that_of_sql(spark):
    text = "one two three four"
    h = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64)
    assert simhash.fingerprint(text.encode(), 4) == h


@pytest.mark.parametrize("n", [3, 40, 900])
def test_index_finds_what_pairs_find(n):
    rnd = np.random.default_rng(n)
    base = rnd.integers(0, 1 << 64, 9, dtype=np.uint64)
    fps = base[rnd.integers(0, 9, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64))
    fps = np.unique(fps)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    expected = simhash.rooted(simhash.united(np.arange(len(fps)), *np.nonzero(near)))
    assert (simhash.linked(fps, 4) == expected).all()


@pytest.mark.parametrize("n", [10, 1 << 24, 1 << 30])
def test_every_link_lies_under_a_top_node(n):
    masks = simhash.top_masks(4, n)
    rnd = random.Random(n)
    for _ in range(300):
        differ = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(not differ & m for m in masks)


def test_groups_are_never_parted():
    rnd = random.Random(7)
    for _ in range(200):
        rows = sorted((rnd.randint(0, 2), rnd.randint(0, 2), rnd.randint(0, 99)) for _ in range(rnd.randint(0, 25)))
        cuts = sorted(rnd.randint(0, len(rows)) for _ in range(rnd.randint(0, 8)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], pa.int64()) for i in range(3)], list("abc")) for p in parts]
        got = [list(zip(*(c.tolist() for c in g), strict=True)) for g in simhash.whole_groups(iter(batches), 2)]
        assert [r for g in got for r in g] == rows
        seen = [{r[:2] for r in g} for g in got if g]
        assert sum(map(len, seen)) == len({r[:2] for r in rows})


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.root for r in got.collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}


def test_components_rounds_stay_small(spark, monkeypatch):
    """A round's plan reads the edges four times; the driver holds the plans, and their stages, of all rounds."""
    written, scans = Scratch.written, []
    monkeypatch.setattr(Scratch, "written", lambda self, df, step: (scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan")), written(self, df, step))[1])
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(999, i) for i in range(900, 960)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.root for r in got.collect()} == least
    assert len(scans) > 2 and max(scans) <= 4


def test_driver_gives_native_memory_back(spark, monkeypatch):
    if not trimmed(spark):
        pytest.skip("this JVM has no System.trim_native_heap")
    said = []
    monkeypatch.setattr(common, "trimmed", lambda spark: said.append(trimmed(spark)))
    Scratch(spark, "t").written(spark.range(3), "x")
    assert said and all(x.startswith("Trim native heap:") for x in said)


def test_one_of_each(spark, docs, rows, empty):
    rows_ = rows
    rnd = random.Random(4)
    words = [f"w{rnd.randint(0, 9999)}" for _ in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    other = [f"v{rnd.randint(0, 9999)}" for _ in range(400)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(other)), (6, " ".join([*words[:150], *other[:250]]))]
    got = simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [3, 4, 6]
    kept = simhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    # of the rows with an id one of each text and of each group stays; those without an id stay
    some = sorted({(i, t or "") for i, t in rows_ if i is not None})
    pairs, root = alike_pairs([t for _, t in some]), list(range(len(some)))
    for _ in some:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    expected = sorted(str(some[i][0]) for i in set(root)) + ["None"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(expected) and "9" not in expected
    assert simhash.one_of_each(spark, empty).count() == 0


def alike_pairs(texts, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    return {(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(sets), 2) if len(x & y) >= least * len(x | y)}


def test_truncated_and_appended_copies_go(spark):
    """Edits in one block, of texts that also share frequent passages."""
    rnd = random.Random(11)
    lines = [" ".join(f"l{rnd.randint(0, 99)}" for _ in range(12)) for _ in range(3)]
    rows = []
    for i in range(60):
        w = [f"w{rnd.randint(0, 2000)}" for _ in range(rnd.randint(60, 200))] + rnd.choice(lines).split()
        rnd.shuffle(lines)
        n = int(0.16 * len(w))
        rows += [(10 * i, " ".join(w)), (10 * i + 1 + i % 2, " ".join(w[:-n] if i % 2 else [*w, *(f"v{rnd.randint(0, 2000)}" for _ in range(n))]))]
    pairs = alike_pairs([t for _, t in rows])
    assert len(pairs) >= 60
    got = {r.doc_id for r in simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * i for i in range(60)}


def test_bitmaps_lose_no_pair_that_is_alike(spark):
    rnd = random.Random(31)
    texts = [""]
    for n in (1, 4, 6, 40, 130, 430, 900):
        words = [f"w{rnd.randrange(1000)}" for _ in range(n)]
        texts += [" ".join(words[: max(1, int(n * share))]) for share in (1, 0.95, 0.85, 0.75, 0.4)]
        texts.append(" ".join(f"v{rnd.randrange(1000)}" for _ in range(n)))
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "th long, t binary")
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i)], "a long, b long")
    left = {tuple(r) for r in simhash.likely(pairs, simhash.bitmaps(rows, 5), 0.8).collect()}
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    share = lambda x, y: len(x & y) / max(1, len(x | y))
    near = {(i, j) for i in range(len(texts)) for j in range(i) if share(sets[i], sets[j]) >= 0.8}
    assert near and near <= left
    # of the others those go that have little in common
    assert not [p for p in left - near if share(*(sets[i] for i in p)) < 0.4 and max(len(sets[i]) for i in p) > 20]


def met(spark, monkeypatch, texts):
    """The texts of each bucket of the first round of ``similar``."""
    seen, pairs = [], simhash.close_pairs

    def seeing(found, similarity, low, high):
        if low == 0:
            seen.extend(tuple(r.ths) for r in found.collect())
        return pairs(found, similarity, low, high)

    monkeypatch.setattr(simhash, "close_pairs", seeing)
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "th long, t binary")
    simhash.similar(rows, spark.createDataFrame([], "a long, b long"), 5, 0.8, Scratch(spark, "t")).collect()
    return seen


def test_texts_that_share_many_shingles_meet_in_one_bucket(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"t{k}x{i}" for i in range(10)) for k in range(6)]
    seen = met(spark, monkeypatch, texts)
    assert tuple(range(6)) in seen and len(seen) == len(set(seen))


def test_frequent_shingles_are_known_however_many_texts_there_are(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE_BYTES", 1)  # as if there were very many texts
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"t{k}x{i}" for i in range(60)) for k in range(60)]
    assert met(spark, monkeypatch, texts) == []  # there are enough rare ones of each


@pytest.mark.parametrize("heads", [1, 8])
def test_exact_join_connects_all_pairs(spark, monkeypatch, heads):
    monkeypatch.setattr(simhash, "HEADS", heads)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rnd = random.Random(12)
    texts = ["", " ", "\n"]
    for _ in range(12):
        w = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.randint(1, 12)):
            texts.append(" ".join(rnd.choice(["x", "y", c]) if rnd.random() < 0.02 else c for c in w))
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "th long, s string").select("th", F.col("s").cast("binary").alias("t"))
    got = {tuple(sorted(r)) for r in simhash.similar(rows, spark.createDataFrame([], "a long, b long"), 5, 0.8, Scratch(spark, "t")).collect()}
    expected = alike_pairs(texts)
    assert got <= expected
    assert [root_of(got, i) for i in range(len(texts))] == [root_of(expected, i) for i in range(len(texts))]


def test_one_of_a_group_stays(spark):
    """Copies of one original that are alike to it, but not to each other; the original's id is the largest."""
    rnd = random.Random(13)
    rows = []
    for g in range(4):
        w = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
        rows.append((100 * g + 99, " ".join(w)))
        for c in range(6):
            rows.append((100 * g + c, " ".join("x" if i in (20 * c + 3, 20 * c + 9, 20 * c + 15) else x for i, x in enumerate(w))))
    pairs = alike_pairs([t for _, t in rows])
    assert len(pairs) == 24  # each copy and its original
    got = simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 100, 200, 300]


def test_texts_that_share_an_id_are_compared_each(spark):
    words = [f"w{i}" for i in range(100)]
    near, other = " ".join([*words[:99], "x"]), " ".join(f"v{i}" for i in range(100))
    rows = [(1, " ".join(words)), (2, near), (2, other)]
    got = simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([rows[0], rows[2]])


def root_of(pairs, i):
    seen, todo = {i}, [i]
    while todo:
        x = todo.pop()
        new = {b if a == x else a for a, b in pairs if x in (a, b)} - seen
        seen |= new
        todo += new
    return min(seen)


# --- op8


def test_shards(spark, docs, rows, empty):
    got = sharding.assign(spark, docs, shards=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    shard = {}
    for r in got:
        assert shard.setdefault(dict(rows).get(r.doc_id) or "", r.shard) == r.shard and 0 <= r.shard < 4 and r.law == "bytes"
    for s, own in itertools.groupby(sorted((r.shard, r.slot) for r in got), key=lambda x: x[0]):
        own = [x[1] for x in own]
        assert own == list(range(len(own))), s
    assert sharding.assign(spark, empty).count() == 0


def least_capacity(sizes, shards):
    best = math.inf
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        best = min(best, max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, len(sizes)])))
    return best


def test_capacity_is_the_least(spark):
    rnd = random.Random(8)
    for _ in range(60):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        k = rnd.randint(1, 4)
        capacity, cuts = sharding.minimax(sizes, k)
        assert capacity == least_capacity(sizes, k) and cuts[-1] == len(sizes) and len(cuts) <= k
        assert all(sum(sizes[a:b]) <= capacity for a, b in itertools.pairwise([0, *cuts]))


def test_a_heavy_cell_leaves_the_others_even():
    alone, lasts = sharding.layout({0: 10, 1: 1000, 2: 10, 3: 10, 4: 10}, 3)
    assert alone == {1: 0} and lasts == [2, 4]


def test_numbers_are_gapless(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 3 + 2))
    got = ranks.numbered(df, "g", ["id"], 1000, "n", each=40).groupBy("g").agg(F.count("*"), F.countDistinct("n"), F.max("n"), F.min("n"))
    assert all(a == b == c + 1 and d == 0 for _, a, b, c, d in got.collect())


# --- op9


def test_round_trip(spark):
    rows = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "", ""), (None, "http://n", "alone"), (9, "http://z", "a\r\n\r\nWARC/1.1\r\n" * 50), (5, "http://a", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, r[0]) for r in rows], "page_id long, url string, html string, digest long")
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("response", None), 9: ("response", None)}
    small = {r.page_id: r.record_type for r in warc.round_trip(spark, pages, least=1).collect()}
    assert small[3] == small[4] == "response"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    head = warc.arc_head(version, "20240102030405")
    one = warc.arc_record(version, "http://a", "20240102030405", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n", len(head))
    found = list(warc.read_arc(head + one + warc.arc_record(version, "http://b", "2024", b"", 0)))
    assert [(r["url"], r["block"]) for r in found] == [("http://a", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n"), ("http://b", b"")]
    assert warc.split_http(found[0]["block"])[1] == b"body\n\n"
    assert warc.iso("20240102030405") == "2024-01-02T03:04:05Z" and warc.iso("2024") == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize("cut", [10, 60, 150, 170])
def test_damaged_archives_say_where(cut):
    whole = warc.arc_head(1, "20240102030405") + warc.arc_record(1, "http://a", "20240102030405", b"x" * 100, 0)
    found = list(warc.read_arc(whole[:cut]))
    assert found[-1]["problem"] and all(r["problem"] is None for r in found[:-1])


def test_reading_goes_on_behind_damage(spark):
    one = warc.arc_record(1, "http://a", "20240102030405", b"x" * 50, 0)
    long = b"http://b 0.0.0.0 20240102030405 text/html 999999\nyy\n"
    whole = warc.arc_head(1, "20240102030405") + one + b"what is this\n" + one + long + warc.arc_record(1, "http://c", "20240102030405", b"z", 0)
    found = list(warc.read_arc(whole))
    assert [r.get("url") or r["problem"] for r in found] == ["http://a", "not a record line", "http://a", "cut short", "http://c"]
    arcs = spark.createDataFrame([(bytearray(zlib.compress(whole)),)], "arc binary")
    assert sorted(r.problem.rsplit(" at ")[0] for r in warc.problems(arcs).collect()) == ["cut short", "not a record line"]


def test_archives_are_warc_files(spark):
    """Any bytes, a gzip member for each record, a description first; long and short files alike."""
    rnd = random.Random(9)
    bodies = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 700, 5000)] + [b"\xff\xfe\x00", b"a" * (17 << 20)]
    blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % i + b for i, b in enumerate(bodies)]
    whole = warc.arc_head(2, "20240102030405") + b"".join(warc.arc_record(2, f"http://{i}", "20240102030405", b, 0) for i, b in enumerate(blocks))
    arcs = spark.createDataFrame([(bytearray(zlib.compress(whole)),)], "arc binary")
    for size in (1, 1 << 24):
        scratch = Scratch(spark, "t")
        warc.write_archives(warc.convert(arcs, archive_bytes=size), scratch.path("w"))
        names = sorted(Path(scratch.path("w").removeprefix("file://")).glob("part-*"))
        assert len(names) == (len(bodies) if size == 1 else 1) and all(n.name.endswith(".warc.gz") for n in names)
        payloads = {}
        for n in names:
            blob, members = n.read_bytes(), []
            while blob:
                z = zlib.decompressobj(31)
                members.append(z.decompress(blob))
                blob = z.unused_data
            members = [m for m in members if m]
            assert members[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
            for m in members[1:]:
                [(head, block)] = warc.read_warc(iter([m]))
                payloads[int(warc.header(block, "X-Page-Id"))] = block.split(b"\r\n\r\n", 1)[1]
        assert payloads == dict(enumerate(bodies))
        assert {r.page_id: r.payload_bytes for r in warc.read_archives(spark, scratch.path("w")).collect()} == {i: len(b) for i, b in enumerate(bodies)}


# --- op10


def test_packing(spark, docs, rows, empty):
    own = tokens.codec(JSON)
    got = packing.pack(spark, docs, JSON, capacity=64).collect()
    expected = Counter()
    for i, t in rows:
        ids = np.append(np.frombuffer(own._whole(t or ""), "<u4"), 2).astype("<u4")
        for j, (s, n) in enumerate(packing.cut(len(ids), 64)):
            expected[i, j, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own_ in held.values():
        at = 0
        for offset, length in sorted(own_):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(spark, empty, JSON).count() == 0


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1025, 1024) == [(0, 1), (1, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def one_by_one(counts, capacity):
    """The same rule, a bin at a time."""
    left, bins = Counter(counts), 0
    while +left:
        spare, room, own = Counter(left), capacity, []
        while fit := [n for n in spare if spare[n] and n <= room]:
            own.append(max(fit))
            spare[own[-1]] -= 1
            room -= own[-1]
        if room and len(own) > 1:
            gap, small = room + own[-1], own[-1]
            pairs = [(a + b, a, b) for a in spare for b in spare if a >= b and spare[a] and spare[b] and (a != b or spare[a] > 1) and small < a + b <= gap]
            if pairs:
                own[-1:] = max(pairs)[1:]
        for n in own:
            left[n] -= 1
        bins += 1
    return bins


def test_plan_is_that_of_single_bins():
    rnd = random.Random(6)
    for _ in range(25):
        counts = Counter(rnd.randint(1, 30) for _ in range(rnd.randint(1, 60)))
        made = packing.plan(counts, 30)
        assert sum(times for _, times in made) == one_by_one(counts, 30)
        used = Counter()
        for filled, times in made:
            assert sum(filled) <= 30
            used.update({n: times * c for n, c in Counter(filled).items()})
        assert used == counts
