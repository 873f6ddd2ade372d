"""Resampling, nearest neighbours and the divergence audit against brute force on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import divergence, neighbours, resampling
from quirefold.llm.common import ITEM_WORDS
from quirefold.llm.crc import joined, of_words
from quirefold.llm.spans import Spans

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8), st.integers(0, 3))
def test_checksums_of_words_and_joins(texts, times):
    texts = [t.encode("utf-8", "ignore") for t in [*texts, "y" * 70, "long " + "é" * 300 * times]]
    words = Spans(texts, ITEM_WORDS)
    one = of_words(words.bytes, words.start, words.end)
    raw = [bytes(words.bytes[a:z]) for a, z in zip(words.start, words.end, strict=True)]
    assert one.tolist() == [zlib.crc32(w) for w in raw]
    two = joined(one[:-1], one[1:], (words.end - words.start)[1:])
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(raw, raw[1:], strict=False)]
    assert [WORDS.findall(t.decode().translate(LOW)) for t in texts] == [[w.decode() for w in raw[a:z]] for a, z in zip(words.first[:-1], words.first[1:], strict=True)]


def resampled(docs, target, percent=5):
    def features(t):
        w = WORDS.findall((t or "").translate(LOW))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)

    s, t = (Counter(b for x in texts for b in features(x)[0]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        f, n = features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1:]))
    k = percent * len(drawn) // 100
    rank = {id(r): n for n, r in enumerate(drawn[:k], 1)}
    return sorted(([*r, rank.get(id(r))] for r in rows), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100, 0])
def test_resampling(spark, percent):
    long = " ".join(f"w{i % 50} the" for i in range(3000))
    texts = [" ".join(f"Word{(i * j) % 17} of é{i % 3}" for j in range(i % 40)) for i in range(60)]
    docs = [*enumerate(texts), (100, None), (101, ""), (102, "?!"), (103, long), (103, long), (103, long), (None, long), (None, texts[30]), (104, "a\x00b " * 30)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, n_words int").repartition(5)
    target = ["word3 of é1 word3 of", None, "", "the the"]
    got = resampling.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((list(r) for r in got.collect()), key=str) == resampled(docs, target, percent)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], none.schema)
    assert [r["rank"] for r in resampling.resample(one, none.select("text")).collect()] == [None]


def test_suffix_counts_are_exact(spark):
    """Equal scores, copies of one row, and scores far apart."""
    rng = np.random.default_rng(1)
    scores = [*rng.integers(-50, 50, 800).tolist(), *[10**12] * 5, *[-(10**12)] * 3]
    rows = [(int(i % 300), 25, 72, int(s), int(s)) for i, s in enumerate(scores)] + [(7, 25, 72, 3, 3)] * 400
    table = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = [r for r in resampling.draw(resampling.stored(table, "t"), 40).collect() if r["rank"]]
    want = sorted(rows, key=lambda r: (-r[4], r[0]))[: 40 * len(rows) // 100]
    assert [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(r[4], r[0]) for r in want]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(want) + 1))


def nearest(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = []
    for a, (i, q) in enumerate(good):
        if i % 20 == 0:
            own = sorted((-float((q * v).sum()), j) for b, (j, v) in enumerate(good) if a != b and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(own[:k], 1)]
    return sorted(out)


def near_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:400] = x[99]  # a third are copies
    x[500] *= 1e6
    x[501] *= 1e-6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 12), (1060, [float("nan")] * 12), (1080, [1.0] * 11 + [float("inf")]), (1100, [None] + [1.0] * 11), (None, [1.0] * 12)]
    rows += [(1120, [1.0, 2.0, 3.0]), (1121, [3.0, 2.0, 1.0]), (40, x[40].tolist()), (40, x[41].tolist()), (1140, [1.0] * 12)]
    return rows


@pytest.mark.parametrize(("block", "stripe"), [(8192, 64 << 20), (64, 4096)])
def test_neighbours(spark, monkeypatch, block, stripe):
    monkeypatch.setattr(neighbours, "STRIPE_BYTES", stripe)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rows = near_rows()
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(table, k=7).collect())
    want = nearest(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)
    few = table.where("vec_id < 5")
    assert len(neighbours.search(few).collect()) == 4
    assert neighbours.search(table.where("false")).count() == 0
    doubles = neighbours.search(few.withColumn("embedding", F.col("embedding").cast("array<double>")))
    assert [tuple(r) for r in doubles.orderBy("rank").collect()] == [tuple(r) for r in neighbours.search(few).orderBy("rank").collect()]


def test_bounds_hold_and_tiles_prune():
    """Every true product lies within its bound, and few pairs are recomputed."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    v = neighbours.Vectors([neighbours._write(np.arange(3000), np.arange(3000), x)])
    true = x[:300].astype(float) @ x.astype(float).T
    near = neighbours.products(v.code[:300], v.code) * (v.scale[:300, None] * v.scale)
    assert (np.abs(true - near) <= v.near[:300, None] * v.lost + v.lost[:300, None] * v.norm).all()
    best = neighbours.Best(3000, 20)
    assert neighbours.meet(v, v, best) < 0.03 * 3000 * 3000
    wide = rng.integers(-127, 128, (5, 5000)).astype(np.int8)
    assert (neighbours.products(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()


def audited(rows):
    docs = [(a or "", b or "", LETTERS.findall((t or "").translate(LOW))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w in df if df[w] >= 3}
        count = defaultdict(Counter)
        for _, s, w in own:
            count[s].update(x for x in w if x in kept)
            count[None].update(x for x in w if x in kept)
        p = {g: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for g, c in count.items()}
        for s in {d[1] for d in own}:
            f = lambda q: {w: math.floor(Fraction((p[s][w] - q[w]) ** 2, q[w])) for w in kept}  # noqa: E731, B023
            pairs = [(sum(f(p[o]).values()), o) for o in {d[1] for d in own} - {s}]
            terms = [(v, w) for w, v in f(p[None]).items() if count[s][w] and p[s][w] > p[None][w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, divergence.TOP)):
                out += [(lang, s, part, w, v, r) for r, (v, w) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # many chunks, many blocks of groups, counts passed on early
        for name, n in (("CHUNK_TERMS", 5), ("CHUNK_ROWS", 80), ("BLOCK_GROUPS", 2), ("HELD", 20), ("TOP", 4), ("PASS", 100)):
            monkeypatch.setattr(divergence, name, n)
    rng = np.random.default_rng(7)
    vocabulary = ["Haus", "élan", "Éa", "zo", "ab", "日本", "x" * 500, *(f"{a}{b}" for a in "abcdefg" for b in "klmnop")]
    rows = []
    for i in range(150):
        words = rng.choice(vocabulary, rng.integers(0, 30), p=None)
        rows.append((["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None, " 1_".join(words)))
    rows += [("en", "s1", "the " * 5000), ("en", "s1", None), ("fr", "a", "once"), ("fr", "b", None), ("fr", "c", ""), ("it", "only", "così così"), *[("en", "s9", "same text here")] * 4]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, item string").repartition(4)
    got = divergence.audit(table)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows)
    assert divergence.audit(table.where("false")).count() == 0


def test_shares_of_large_counts():
    count, of = np.array([9 * 10**14, 0, 8 * 10**14], np.int64), np.int64(8 * 10**15)
    assert divergence.shares(count, of).tolist() == [1 + 10**9 * (int(c) + 1) // int(of) for c in count]
    p, q = np.array([10**9 + 1, 5], np.int64), np.array([1, 10**9], np.int64)
    assert divergence.divergence(p, q).tolist() == [(10**9) ** 2, (10**9 - 5) ** 2 // 10**9]
