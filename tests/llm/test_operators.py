"""The operators against brute force on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import decontam, langid, lm, neardup, packing, quality, rangecoder, sharding, suffixes, tokenfiles, tokens, toxicity
from quirefold.llm.components import components
from quirefold.llm.common import BLANK_WORDS, ITEM_WORDS, Words
from quirefold.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, _raw string, n_words int, node string, bucket int, score string, shard string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed up many more jugs of liquid veneer and then went home"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [
    (1, SHARED), (2, "Intro. " + SHARED.upper() + "! End of it."), (3, ""), (4, None), (5, "  \n\t "), (6, "?!"), (7, "Ümlaut é\x01 ½ 日本 <|endoftext|> it's"),
    (8, SHARED), (9, "a b"), (10, "a b"), (11, LONG), (12, LONG + " tail"), (13, "la " * 120), (14, "x" * 99), (15, "x" * 250), (8, SHARED), (None, "no id " + SHARED), (None, None),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "r", 1, "n", 2, "s", "h") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_word_splits():
    for t in ("A b\tc", "", " x", "é É\nZ", "a\x00b c", "½1 x-y_z"):
        w = Words([b"pre fix", t.encode(), b"post"], BLANK_WORDS)
        got = [w.bytes[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)][w.first[1] : w.first[2]]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        w = Words([t.encode()], ITEM_WORDS)
        assert len(w) == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW)))


def test_sharding(docs, none):
    rows = sharding.shard(docs, 5, 64).collect()
    assert len(rows) == len(TEXTS)
    sizes = sorted(8 + len((t or "").encode()) for _, t in TEXTS)
    assert sorted(r["size"] for r in rows) == sizes
    for s in range(5):
        own = [r.slot for r in rows if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert len({(r.doc_id, r.shard) for r in rows if r.doc_id == 8}) == 1
    assert sharding.shard(none, 5, 64).count() == 0


def test_sharding_of_rows_without_id_and_of_one_id(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(7, "same")] * 300 + [(k, "x" * (k % 50)) for k in range(2000)]
    got = sharding.shard(table(spark, rows).repartition(4), 4).collect()
    crcs = lambda pairs: Counter((i, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == crcs(rows)
    assert len({r.virtual_slot for r in got if r.doc_id is None}) > 200
    assert len({r.virtual_slot for r in got if r.doc_id == 7}) == 1
    load = Counter()
    for s in range(4):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        load[s] = sum(r["size"] for r in own)
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 4


def test_columns_of_clashing_names(spark):
    """Names in any case, and those of the operators' own columns."""
    docs = spark.createDataFrame([(1, "the cat", "x", 5, "r", 3)], "doc_id long, text string, Lang_Pred string, SCORE int, _raw string, N_Words int")
    got = langid.predict(docs, {"en": np.arange(3)})
    assert got.columns == ["doc_id", "text", "_raw", "N_Words", "lang_pred", "score"]
    assert got.first()["_raw"] == "r"
    got = toxicity.score(docs, (np.zeros(1 << toxicity.BITS, np.float32), 0.0))
    assert got.columns == ["doc_id", "text", "Lang_Pred", "_raw", "N_Words", "score", "predicted"]
    assert (got.first().score, got.first()["_raw"]) == (0.5, "r")
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    for most in (1 << 20, 1):
        got = decontam.annotate(docs, items, most)
        assert got.columns == ["doc_id", "text", "Lang_Pred", "SCORE", "_raw", *decontam.NAMES]
        assert (got.first()["_raw"], got.first().n_hit) == ("r", 2)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([("a b c", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(rows, 3)


def test_rebalance_moves_few_and_evens_out():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1000, 2048)
    first = sharding.rebalance(sharding.even_map(2048, 8), size, 8)
    load = np.bincount(first, size, 8)
    assert load.max() - load.min() <= 0.002 * load.mean()
    grown = sharding.rebalance(first, size, 9)
    load = np.bincount(grown, size, 9)
    assert load.max() - load.min() <= 0.002 * load.mean()
    assert (grown != first).sum() < 600
    shrunk = sharding.rebalance(grown, size, 8)
    assert shrunk.max() == 7


def test_map_versions(spark, tmp_path):
    path, one = str(tmp_path / "map"), np.ones(4, np.int64)
    sharding.write_map(spark, path, 1, np.array([0, 1, 0, 1]), one, one)
    sharding.write_map(spark, path, 2, np.array([0, 1, 2, 1]), one, one)
    assert sorted(r.shard for r in sharding.read_map(spark, path).collect()) == [0, 1, 1, 2]
    assert sorted(r.shard for r in sharding.read_map(spark, path, 1).collect()) == [0, 0, 1, 1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(41, 50_000))
def test_coder_round_trip(ids, vocabulary):
    x = np.array(ids, np.uint32)
    block = rangecoder.write_block([None, 5], [0, len(x)], x, vocabulary)
    names, sizes, back = rangecoder.read_block(block)
    assert names == [None, 5]
    assert sizes.tolist() == [0, len(x)]
    assert np.array_equal(back, x)


def test_coder_compresses_and_notices_damage():
    x = np.tile(np.arange(100, dtype=np.uint32), 2000)
    block = rangecoder.write_block([1], [len(x)], x, 49_408)
    assert len(block) < len(x)
    for at in (40, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            rangecoder.read_block(bytes(bad))
    with pytest.raises(ValueError, match="vocabulary"):
        rangecoder.write_block([1], [1], np.array([9], np.uint32), 9)


def whole(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_words_encode_as_texts(texts):
    e = Encoder(TOKENIZER)
    assert [x.tolist() for x in e.ids([t.encode() for t in texts])] == whole(texts)


#: Marks that compose, contractions, added tokens, punctuation beside letters, odd blanks.
ODD = ["J", "\u030c", "I", "\u0307", "\u0130", "\u03a3", "'", "s", "'LL", "don", "!", ".", "\u2026", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|>", "\u0338", " ", "\n", "\x01", "1", "\u00c9", "\u65e5", "\x85", "\x00"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=12).map("".join), max_size=20))
def test_odd_words_encode_as_texts(texts):
    assert [x.tolist() for x in ODD_ENCODER.ids([t.encode() for t in texts])] == [e.ids for e in ODD_ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]


ODD_ENCODER = Encoder(TOKENIZER)


def test_kept_words_give_the_same_ids(monkeypatch):
    """Words new, met again, kept by the worker, merged and dropped at the bounds, and long ones."""
    monkeypatch.setattr(tokens, "RECENT", 3)
    monkeypatch.setattr(tokens, "KEPT", 6)
    monkeypatch.setattr(tokens, "LONGEST", 7)
    few = Encoder(TOKENIZER)
    rng = np.random.default_rng(7)
    words = ["the", "Éa", "ñu.", "straße!", "ÿ", "×", "l'été", "÷x", "à\u0301", "A.b", "", "longer-than-that", "longerthanthat", "日本", "œuvre", "ÀÖØÞ"]
    for _ in range(20):
        texts = [" ".join(rng.choice(words, 6)) for _ in range(3)]
        assert [x.tolist() for x in few.ids([t.encode() for t in texts])] == whole(texts)
    assert len(few.table.levels[0][0]) <= 6


def test_long_blocks_keep_sums_small(monkeypatch):
    """Counts are halved where their sum would grow too large; ids come back all the same."""
    monkeypatch.setattr(rangecoder, "FULL", 60_000)
    x = np.random.default_rng(8).zipf(1.3, 60_000).clip(0, 49_000).astype(np.uint32)
    assert np.array_equal(rangecoder.read_block(rangecoder.write_block([1], [len(x)], x, 49_408))[2], x)


def test_token_files(spark, docs, none, tmp_path):
    tokenfiles.write(docs, str(tmp_path / "f"), TOKENIZER, 2, block_tokens=5000)
    rows = tokenfiles.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    at, left = 0, Counter((i, t) for i, t in TEXTS)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(bytes(r.ids)))
        at += len(ids)
        mine = next(k for k in left if k[0] == r.doc_id and whole([k[1] or ""])[0] + [2] == ids.tolist() and left[k])
        left[mine] -= 1
    tokenfiles.write(none, str(tmp_path / "e"), TOKENIZER, 2)
    assert tokenfiles.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize(("shard_docs", "shard_tokens"), [(6, 1 << 22), (1024, 200)])
def test_packing(docs, none, monkeypatch, shard_docs, shard_tokens):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard_tokens)
    rows = packing.pack(docs, TOKENIZER, 1, window=512, shard_docs=shard_docs).collect()
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 512
    left = Counter((i, *x) for (i, _), x in zip(TEXTS, [tuple(x) + (1,) for x in whole([t or "" for _, t in TEXTS])], strict=True))
    pieces = Counter()
    for r in rows:
        mine = [k for k in left if k[0] == r.doc_id and len(k) - 1 == r.doc_tokens]
        crcs = {zlib.crc32(np.array(k[1 + r.start : 1 + r.start + r.length], "<u4").tobytes()): k for k in mine}
        assert r.length > 0
        assert r.ids_crc32 in crcs
        pieces[crcs[r.ids_crc32], r.start, r.length] += 1
    for k, n in left.items():  # the pieces of a document lie end to end, as often as its row stands
        ends = Counter()
        for (own, start, length), c in pieces.items():
            if own == k:
                ends[start] += c
                ends[start + length] -= c
        assert {p: c for p, c in ends.items() if c} == {0: n, len(k) - 1: -n}
    assert packing.pack(none, TOKENIZER, 1).count() == 0


def test_packing_pads_little_and_puts_like_documents_together(spark):
    """Three topics in turn: shards hold one topic each, windows but the last of a shard are full."""
    names = [("river", "boat"), ("music", "song"), ("stone", "wall")]
    rows = [(i, " ".join(f"{names[i % 3][0]} {(i * 7 + j) % 40} {names[i % 3][1]}" for j in range(30))) for i in range(42)]
    got = packing.pack(table(spark, rows).coalesce(1), TOKENIZER, 1, window=64, shard_docs=14).collect()
    per = Counter()
    for r in got:
        per[r.sequence_id] += r.length
    assert sum(v < 64 for v in per.values()) <= 8
    mixed = [s for s in per if len({r.doc_id % 3 for r in got if r.sequence_id == s}) > 1]
    assert len(mixed) <= 6


def test_scores_are_bm25():
    rng = np.random.default_rng(9)
    docs_ = [rng.integers(0, 30, n) for n in (40, 5, 17, 1, 60)] + [np.array([29])]
    idf = rng.random(30) * (rng.random(30) > 0.3)
    shard = packing.Shard(docs_, idf, 20.0)
    for q in range(len(docs_)):
        for d in range(len(docs_)):
            want = 0.0
            for t in set(docs_[q].tolist()):
                tf = (docs_[d] == t).sum()
                want += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs_[d]) / 20)) if tf else 0
            assert abs(shard.scores(q)[d] - want) < 1e-9


def test_statistics_count_all_documents(docs):
    by = packing.routers(docs, TOKENIZER, 1)
    tokens_ = packing.tokenized(docs, TOKENIZER, 1, by)
    ids, df, n, mean = packing.statistics(tokens_)
    every = [x + [1] for x in whole([t or "" for _, t in TEXTS])]
    want = Counter(i for x in every for i in set(x))
    assert dict(zip(ids.tolist(), df.tolist(), strict=True)) == want
    assert (n, round(mean, 9)) == (len(every), round(sum(map(len, every)) / len(every), 9))
    assert tokens_.where("df is null").count() == len(TEXTS)


def test_bm25_prefers_similar_documents():
    idf = np.full(60, 2.0)
    docs_ = [np.array(x) for x in ([1, 2, 3], [9, 8, 7], [1, 2, 4], [50, 51, 52])]
    score = packing.Shard(docs_, idf, 3.0).scores(0)
    assert score.argsort()[::-1].tolist()[:2] == [0, 2]
    assert score[1] == score[3] == 0
    order = [p[0] for p in packing.fill(docs_, packing.Shard(docs_, idf, 3.0), 6)]
    assert order[:2] == [0, 2]


def test_language(spark, docs, none):
    train = table(spark, [(i, "the cat and the dog " * 5, "en") [:2] for i in range(3)]).union(table(spark, [(9, None)]))
    train = train.selectExpr("text", "lang").union(spark.createDataFrame([("der hund und die katze " * 5, "de"), ("x", None)], "text string, lang string"))
    profiles = langid.train(train)
    assert list(profiles) == ["de", "en"]
    got = [(r.text, r.lang_pred, r.score) for r in langid.predict(docs, profiles).collect()]
    assert len(got) == len(TEXTS)
    for t, lang, score in got:
        letters = t is not None and any(c.isalpha() for c in t)
        assert (lang == "und") == (not letters)
        assert 0 <= score <= 1
    assert langid.predict(table(spark, [(1, "und der die")]), profiles).first().lang_pred == "de"
    assert langid.predict(docs, {}).first().lang_pred == "und"
    assert langid.predict(none, profiles).count() == 0
    assert langid.train(train.where("false")) == {}


def test_profile_distance_by_hand():
    r = langid.Ranker({"a": np.array([5, 6, 7])}, 3)
    r.size = 3
    top = langid.ranked(*langid.ngrams(b"ab"), 3)
    assert len(top) == 3
    assert r.predict(b"ab") == ("a", 0.0)


def decontam_brute(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        k = min(13, len(x))
        for a in range(len(x) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == x[a : a + k]:
                    hit |= set(range(p, p + k))
                    found.add(str(i))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, none, broadcast_bytes):
    items = [(1, SHARED), (20, "A B"), (3, None), (4, "!"), (5, SHARED[10:120]), (6, "zzz"), (7, "fox jumps over"), (20, "ümlaut É"), (8, "Ümlaut é")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    short = [(i, t) for i, t in TEXTS if t is None or len(t) < 5000]
    got = decontam.annotate(table(spark, short), frame, broadcast_bytes)
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").na.fill(-1).collect())
    assert rows == sorted((-1 if i is None else i, *decontam_brute(t, items)) for i, t in short)
    assert got.select("_raw").distinct().count() == 1  # a column of the input
    assert decontam.annotate(none, frame, broadcast_bytes).count() == 0
    assert decontam.annotate(docs, frame.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 5])
def test_rows_of_one_item_id_count_once(spark, broadcast_bytes):
    items = [(20, "red apple"), (20, "green pear"), (3, "blue plum")]
    text = "a red apple, a green pear and a blue plum"
    got = decontam.annotate(table(spark, [(1, text)]), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes)
    assert tuple(got.select("n_words", "n_hit", "n_items", "items_sha256", "contaminated").first()) == decontam_brute(text, items)
    assert got.first().n_items == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), max_size=60))
def test_winnowing_finds_every_window(doc, item):
    index = decontam.build([(1, " ".join(item).encode())])
    (n, spans, _), = decontam.hits([" ".join(doc).encode()], index)
    want = decontam_brute(" ".join(doc), [(1, " ".join(item))])
    assert (n, decontam.covered(spans)) == want[:2]


def test_quality_of_awkward_rows(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 5, 6, 13))
    assert next(r for r in rows if r.doc_id == 13).n_repeat_words == 120
    assert quality.judge(none).count() == 0


def brute_classes(rows, least=0.8):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for _, t in rows]
    df = Counter(x for w in words for x in set(w))
    idf = lambda x: math.log((len(rows) + 1) / (df[x] + 1)) + 1
    vecs = []
    for w in words:
        k = min(5, len(w))
        v = Counter()
        for j in range(len(w) - k + 1 if k else 0):
            v[tuple(w[j : j + k])] += sum(map(idf, w[j : j + k])) / k
        vecs.append(v)
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = sum(min(x, vecs[b][s]) for s, x in vecs[a].items() if s in vecs[b])
            both = sum(vecs[a].values()) + sum(vecs[b].values()) - common
            if (common / both if both else 1.0) >= least:
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return top


def test_near_duplicates(spark, docs, none, monkeypatch):
    words = [f"v{i}" for i in range(120)]
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(0, 120, 7)]
    rows = [(i, t) for i, t in TEXTS if i is not None] + [(100 + k, t) for k, t in enumerate(near)] + [(200, " ".join(words))]
    top = brute_classes(rows)
    want = {}
    for (i, _), t in zip(rows, top, strict=True):
        want[t] = min(want.get(t, i), i)
    expected = sorted((i, want[t]) for (i, _), t in zip(rows, top, strict=True))
    for small in (32, 1):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "TILE", 4)
        got = neardup.classes(table(spark, rows))
        assert sorted((r.doc_id, r.class_id) for r in got.collect()) == expected
    kept = neardup.keep_one(table(spark, rows))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.keep_one(docs).where("doc_id is null").count() == 0  # their classes have ids
    assert neardup.classes(none).count() == 0
    assert neardup.keep_one(none).count() == 0


def test_large_bucket_is_compared_whole(spark, monkeypatch):
    """Two groups of near copies meet in one bucket; no two nodes share another band."""
    rows = []
    for g in range(2):
        words = [f"g{g}v{i}" for i in range(120)]
        rows += [(10 * g + k, " ".join([*words[: 20 * k], f"new{k}", *words[20 * k + 1 :]])) for k in range(6)]
    docs = table(spark, rows).select("doc_id", "text")
    idf = neardup.idf_table(docs)
    own = [F.col("doc_id") * 100 + k for k in range(1, neardup.BANDS)]
    signatures = neardup.signed(docs, idf).withColumn("bands", F.array(F.lit(1).cast("long"), *own))
    name = {r.node: r.doc_id for r in signatures.collect()}
    top = brute_classes(rows)
    for small in (32, 1):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "TILE", 4)
        monkeypatch.setattr(neardup, "TILE_BYTES", 5000)
        classes = {i: {i} for i, _ in rows}
        for r in neardup.near_links(signatures, docs, idf).collect():
            both = classes[name[r.a]] | classes[name[r.b]]
            classes |= dict.fromkeys(both, both)
        assert [rows.index(next(x for x in rows if x[0] == min(classes[i]))) for i, _ in rows] == top


def test_rows_without_id_or_with_map_columns(spark):
    """Rows of no id and rows that differ in a map alone: one of each class stays, and texts are fetched once."""
    rows = [(None, f"{SHARED} number{k // 2}", {"k": str(k)}) for k in range(40)] + [(1, "alone here", {"a": "2"}), (1, "alone here", {"a": "1"}), (1, "other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, string>")
    kept = neardup.keep_one(docs).collect()
    assert len(kept) == 3
    assert {r.text: r.extra for r in kept}["alone here"] == {"a": "1"}
    idf = neardup.idf_table(docs)
    signatures = neardup.signed(docs, idf)
    members = neardup.bucketed(signatures)
    vecs = neardup.stored_vectors(docs, members.groupBy("node").agg(F.min("row_key").alias("row_key")), idf)
    assert vecs.count() == members.select("node").distinct().count()


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    top = {x: x for p in pairs for x in p}
    for a, b in pairs:
        x, y = top[a], top[b]
        top = {k: min(x, y) if t in (x, y) else t for k, t in top.items()}
    name = lambda x: hashlib.md5(bytes([x])).digest()
    edges = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in components(edges).collect()}
    assert set(got) == {name(x) for x in top}
    assert all((got[name(x)] == got[name(y)]) == (top[x] == top[y]) for x in top for y in top)


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64))
    wa, wb = rng.random(400) + 0.1, rng.random(400) + 0.1
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    hits, n = 0, 0
    old = neardup.ROWS
    neardup.ROWS = 1
    try:
        for seed in range(60):
            s = neardup.Sampler(seed)
            own = np.zeros(400, np.int64)
            hits += (s.bands(own, key, wa, 1) == s.bands(own, key, wb, 1)).sum()
            n += neardup.BANDS
    finally:
        neardup.ROWS = old
    assert abs(hits / n - want) < 0.06


def test_weights_of_long_repetitions_are_whole():
    idf = np.full(1 << neardup.IDF_BITS, 13, np.float32)
    line = b"one line of seven words and again\n"
    two = [neardup.vectors(Words([line * n], ITEM_WORDS), idf) for n in (10_000, 20_000)]
    a, b = (neardup.unpack_vector(neardup.pack_vector(key, weight)) for _, key, weight in two)
    assert abs(neardup.weighted_jaccard(a, b) - 0.5) < 1e-3
    common = neardup.overlaps([a, b])
    assert abs(common[0, 1] / common[1, 1] - 0.5) < 1e-3


def test_overlaps_by_hand():
    rng = np.random.default_rng(5)
    vecs = []
    for _ in range(9):
        k = np.sort(rng.choice(50, 20, replace=False)).astype(np.uint32)
        vecs.append((k, rng.integers(1, 5, 20).astype(float)))
    got = neardup.overlaps(vecs)
    for a in range(9):
        for b in range(9):
            x, y = dict(zip(*vecs[a], strict=True)), dict(zip(*vecs[b], strict=True))
            assert abs(got[a, b] - sum(min(v, y[k]) for k, v in x.items() if k in y)) < 1e-3


def test_toxicity(spark, docs, none):
    rows = [(i, f"some plain words number{i} " + ("you utter snorkwad " if i % 3 == 0 else "you kind friend ") * 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(frame, model).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(90, 120))
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == len(TEXTS)
    assert all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, model).count() == 0
    assert not toxicity.train(frame, labels.where("false"))[0].any()


def test_ratios_and_regression_by_hand():
    """Naive Bayes ratios as counted, and a fit whose loss is near that of a plain solver."""
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["aba", "bcb", "cdc", "ded"], 4, p=[0.4, 0.3, 0.2, 0.1] if y else [0.1, 0.2, 0.3, 0.4])).encode() for y in range(2) for _ in range(150)]
    y = np.repeat([0.0, 1.0], 150)
    rows = [toxicity.features(t, seen) for t in texts]
    assert all(len(set(f.tolist())) == len(f) for f in rows)
    w, b = toxicity.fit(rows, y, 0.5, epochs=60)
    bins = sorted({x for f in rows for x in f.tolist()})
    n = {x: [sum(x in f for f, k in zip(map(set, map(np.ndarray.tolist, rows)), y, strict=True) if k == c) for c in (0, 1)] for x in bins}
    used = [x for x in bins if sum(n[x]) >= toxicity.LEAST_TEXTS]
    ratio = np.array([math.log(((n[x][1] + 1) / 152) / ((n[x][0] + 1) / 152)) for x in used])
    assert not w[[x for x in bins if x not in used]].any()
    X = np.array([[float(x in f) for x in used] for f in map(set, map(np.ndarray.tolist, rows))]) * ratio
    v, c = np.zeros(len(used)), 0.0
    for _ in range(4000):  # plain gradient descent
        err = 1 / (1 + np.exp(-(X @ v + c))) - y
        v -= 0.05 * (X.T @ err / len(y) + 1e-4 * v)
        c -= 0.05 * err.mean()
    loss = lambda z: float(np.mean(np.logaddexp(0, z) - y * z))
    own = np.array([w[f].sum() for f in rows]) + b
    assert loss(own) <= loss(X @ v + c) + 0.02


def test_language_model(spark, docs, none):
    rows = [(i, t, i is not None and i % 4 == 2) for i, t in TEXTS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    end = object()
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), end] for _, t, _ in rows]
    c, b = Counter(), Counter()
    for w, (_, _, out) in zip(words, rows, strict=True):
        if not out:
            c.update(w)
            b.update(zip([end, *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    want = []
    for w, (i, _, out) in zip(words, rows, strict=True):
        root = [(c[x] + 1) / (n + v + 1) for x in w]
        full = [(b[u, x] + lm.K * p) / (c[u] + lm.K) for u, x, p in zip([end, *w[:-1]], w, root, strict=True)]
        want.append((-1 if i is None else i, out, len(w), sum(c[x] > 0 for x in w), n, round(sum(map(math.log10, root)), 5), round(sum(map(math.log10, full)), 5)))
    got = [(-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:5], round(r.base_score, 5), round(r.score, 5)) for r in lm.score(frame).collect()]
    assert sorted(got) == sorted(want)
    assert lm.score(frame.where("false")).count() == 0


def brute_cut(texts, span=100):
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            x = t[s : s + span]
            if x in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(x)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sort_bytes", [1 << 20, 500])
def test_suffix_dedup(spark, docs, none, monkeypatch, sort_bytes):
    monkeypatch.setattr(suffixes, "SORT_BYTES", sort_bytes)
    rng = np.random.default_rng(2)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage = noise(300)
    rows = [(k, noise(150) + passage[k : 200 + k * 7] + noise(90)) for k in range(14)] + [(20, "ab" * 300), (21, "b" + "ab" * 120), (22, None), (23, ""), (24, noise(4000) * 2)]
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_cut([(t or "").encode() for _, t in rows]), strict=True))
    got = suffixes.dedup(table(spark, rows).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == want
    awkward = suffixes.dedup(docs, ("doc_id", "n_words", "node"), with_text=True)
    assert awkward.count() == len(TEXTS)
    assert awkward.where("kept is null").count() == sum(t is None for _, t in TEXTS)
    assert suffixes.dedup(none).count() == 0


def test_cuts_leave_replacement_characters(spark):
    """The repeat starts inside a character (of equal last bytes) and ends inside one (of equal first bytes)."""
    passage = "".join(f"{i}," for i in range(100, 140))
    rows = [(1, "\ufffd one é" + passage + "Ä tail"), (2, "\ufffd two \u0269" + passage + "Ç end \ufffd\ufffd")]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, table(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: "\ufffd two  end \ufffd\ufffd"}
    for text in (b"a\x80\x80\x80b", b"\x80\xe6\x97", "日本".encode()):
        buf = np.frombuffer(text, np.uint8)
        for k in range(len(buf)):
            assert suffixes.split_too(buf, np.arange(len(buf)) == k)[k]
    assert suffixes.split_too(np.frombuffer(b"a\x80\x80b", np.uint8), np.array([1, 0, 0, 0], bool)).tolist() == [True, False, False, False]


def test_multikey_sort():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:1400] = buf[200:600]
    at = np.arange(2900)
    group = rng.integers(0, 3, 2900)
    order, kind = suffixes.multikey(buf, at, group)
    rows = [(group[i], buf[i : i + 100].tobytes()) for i in order]
    assert all((a == b) == (x == y) for a, b, x, y in zip(rows, rows[1:], kind, kind[1:], strict=False))
    assert len(set(rows)) == kind[-1] + 1
