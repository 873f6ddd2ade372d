"""Benchmark decontamination by winnowing.

The minimum k-gram hash of each window of W k-grams is kept as a fingerprint. Two
texts that share W + K - 1 = 13 words share a fingerprint, so looking up a
document's fingerprints among the items' finds every shared 13-word window. Each
hit is extended over the words themselves to both ends. Items of fewer words are
one window each and are looked up by a hash of all their words.
"""

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quirefold.llm.common import arrow, batch, binaries, distinct, free, grams, ITEM_WORDS, raw_text, runs, stored, without, Words

SPAN = 13
K = 5
W = SPAN - K + 1
#: Bytes of item texts that the broadcast index may hold.
BROADCAST_BYTES = 16 << 20
#: Bits, as a power of two, of the table that keeps documents' fingerprints from the join.
FILTER_BITS = 24
U64 = np.uint64
NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions that are a minimum of a window of W that holds them; ascending. Equal
    minima are all kept, so the choice depends on the window's own words alone."""
    return np.flatnonzero(_near(g, _slide(g))) if len(g) >= W else np.empty(0, np.int64)


def _slide(g: np.ndarray) -> np.ndarray:
    """Minimum of each window of W by doubling."""
    m, size = g, 1
    while size * 2 <= W:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(g) - W + 1], m[W - size : W - size + len(g) - W + 1])


def _near(g: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Is g[i] the minimum of one of the windows that contain i?"""
    n = len(low)
    out = np.zeros(len(g), bool)
    for j in range(W):
        out[j : j + n] |= g[j : j + n] == low
    return out


@dataclass
class Index:
    """Fingerprints (sorted) with item and word position; short items by length."""

    ids: list
    words: list[list[bytes]]
    hashes: list[np.ndarray]
    prints: np.ndarray
    at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build(items: list[tuple[object, bytes]]) -> Index:
    """Items without a word are left out: they have no window."""
    ids, words, hashes = [], [], []
    found, place, short = [], [], defaultdict(list)
    for item_id, text in items:
        w = Words([text], ITEM_WORDS)
        if not len(w):
            continue
        n = len(ids)
        ids.append(item_id)
        words.append([w.bytes[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)])
        hashes.append(w.hash)
        if len(w) < SPAN:
            short[len(w)].append((int(grams(w.hash, len(w))[0]), n))
            continue
        g = grams(w.hash, K)
        for p in winnow(g):
            found.append(g[p])
            place.append((n, p))
    order = np.argsort(np.array(found, np.uint64), kind="stable")
    table = {}
    for k, v in short.items():
        v.sort()
        table[k] = (np.array([x for x, _ in v], np.uint64), np.array([n for _, n in v]))
    return Index(ids, words, hashes, np.array(found, np.uint64)[order], np.array(place, np.int64).reshape(-1, 2)[order], table)


def _pairs(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in keys, in sorted_keys) of equal values."""
    lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    hit = np.flatnonzero(n)
    rep = np.repeat(hit, n[hit])
    offset = np.arange(len(rep)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
    return rep, np.repeat(lo[hit], n[hit]) + offset


def hits(texts: list[bytes], index: Index) -> list[tuple[int, np.ndarray, set[int]]]:
    """Per text: its number of words, the hit ranges (start, end) and the items found."""
    w = Words(texts, ITEM_WORDS)
    first, n = w.first, len(w)
    ranges: dict[int, set] = defaultdict(set)
    items: dict[int, set] = defaultdict(set)

    def same(p: int, item: int, q: int) -> bool:
        return w.hash[p] == index.hashes[item][q] and w.bytes[w.start[p] : w.end[p]].tobytes() == index.words[item][q]

    if len(index.prints) and n >= SPAN:
        g = grams(w.hash, K)
        at = winnow(g)  # a window over two texts only adds fingerprints
        near = np.minimum(np.searchsorted(index.prints, g[at]), len(index.prints) - 1)
        at = at[index.prints[near] == g[at]]
        doc = np.searchsorted(first, at, "right") - 1
        seen: dict[tuple, int] = {}
        pos, idx = _pairs(index.prints, g[at])
        for i, k in zip(pos.tolist(), idx.tolist(), strict=True):
            p, d = int(at[i]), int(doc[i])
            item, q = int(index.at[k, 0]), int(index.at[k, 1])
            lo_d, hi_d = int(first[d]), int(first[d + 1])
            if seen.get((d, item, p - q), -1) > p:
                continue
            a = 0
            while a < q and p - a > lo_d and same(p - a - 1, item, q - a - 1):
                a += 1
            b = 0
            while q + b < len(index.words[item]) and p + b < hi_d and same(p + b, item, q + b):
                b += 1
            seen[d, item, p - q] = p + b
            if a + b >= SPAN:
                ranges[d].add((p - a - lo_d, p + b - lo_d))
                items[d].add(item)
    for k, (keys, which) in index.short.items():
        if n < k:
            continue
        g = grams(w.hash, k)
        pos = np.flatnonzero(np.isin(g, keys))
        doc = np.searchsorted(first, pos, "right") - 1
        i_of, k_of = _pairs(keys, g[pos])
        for i, j in zip(i_of.tolist(), k_of.tolist(), strict=True):
            p, d, item = int(pos[i]), int(doc[i]), int(which[j])
            if p + k <= first[d + 1] and all(same(p + x, item, x) for x in range(k)):
                ranges[d].add((p - int(first[d]), p - int(first[d]) + k))
                items[d].add(item)
    return [(int(first[d + 1] - first[d]), np.array(sorted(ranges[d])).reshape(-1, 2), items[d]) for d in range(len(texts))]


def covered(ranges) -> int:
    """Words in the union of half-open ranges."""
    total, end = 0, 0
    for a, b in sorted(map(tuple, ranges)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
KINDS = [pa.int64()] * 3 + [pa.string(), pa.bool_()]


def verdict(n_words: int, spans, items: list[str]) -> tuple:
    """Values of FOUND for a document's hit ranges and the distinct ids of its items, sorted."""
    n_hit = covered(spans)
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """One pass over the documents with a broadcast index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    keep, raw = without(docs, *NAMES), free(docs, "_raw")
    schema = StructType(docs.select(keep).schema.fields + _parse_datatype_string(FOUND).fields)

    def run(batches):
        for b in batches:
            texts, out = binaries(b[raw]), []
            for lo, hi in runs(texts):
                for n, spans, items in hits(texts[lo:hi], shared.value):
                    out.append(verdict(n, spans, sorted({str(shared.value.ids[i]) for i in items})))
            cols = list(zip(*out, strict=True)) or [[] for _ in KINDS]
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + [pa.array(list(c), k) for c, k in zip(cols, KINDS, strict=True)], names=schema.names)

    return docs.select(*keep, raw_text().alias(raw)).transform(arrow(run, schema))


def prints_of(text: bytes, lengths: set[int]) -> np.ndarray:
    """Distinct fingerprints of a text: winnowed k-grams, and all n-grams of ``lengths`` words."""
    w = Words([text], ITEM_WORDS)
    g = grams(w.hash, K)
    parts = [g[winnow(g)]]
    parts += [grams(w.hash, n) ^ U64(n * 0x9E3779B97F4A7C15 % (1 << 64)) for n in lengths]
    return distinct(np.concatenate(parts))


def _sparse(prints: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, set for the fingerprints' upper bits; a table of fixed size."""
    at = prints.select(F.shiftrightunsigned("fp", 64 - FILTER_BITS).alias("at"))
    rows = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows.collect():
        bits[r.w] = r.b
    return bits.view(U64)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprints of documents and items joined; each document then meets the items that share one.

    The documents' rows are numbered and stored once. A bit table of fixed size keeps most
    fingerprints that no item has from the shuffle. A group is one document with its items.
    """
    row, raw = free(docs, "_row"), free(docs, "_raw")
    keep = without(docs, *NAMES)
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = numbered.select(F.col(row).alias("row"), raw_text().alias("raw"))
    item_kinds = pa.schema([("item", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])
    row_kinds = pa.schema([("row", pa.int64()), ("fp", pa.int64()), ("n_words", pa.int64())])

    def of_items(batches):
        for b in batches:
            rows = []
            for item, text in zip(b["item"].to_pylist(), binaries(b["raw"]), strict=True):
                n = len(Words([text], ITEM_WORDS))
                rows += [(item, fp, n) for fp in prints_of(text, {n} if 0 < n < SPAN else set()).view(np.int64).tolist()]
            yield batch(item_kinds, list(zip(*rows, strict=True)) or [[], [], []])

    fps = stored(items.select("item", "raw").transform(arrow(of_items, "item long, fp long, n long")), "fingerprints")
    lengths = {r.n for r in fps.where(F.col("n") < SPAN).select("n").distinct().collect()}
    bits = docs.sparkSession.sparkContext.broadcast(_sparse(fps))

    def of_rows(batches):
        for b in batches:
            rows = []
            for name, text in zip(b["row"].to_pylist(), binaries(b["raw"]), strict=True):
                fp = prints_of(text, lengths)
                at = fp >> U64(64 - FILTER_BITS)
                fp = fp[(bits.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1].view(np.int64)
                n = len(Words([text], ITEM_WORDS))
                rows += [(name, f, n) for f in (None, *fp.tolist())]
            yield batch(row_kinds, list(zip(*rows, strict=True)) or [[], [], []])

    marks = stored(texts.transform(arrow(of_rows, "row long, fp long, n_words long")), "fingerprints")
    pairs = marks.where("fp is not null").select("row", "fp").join(fps.select("item", "fp"), "fp").select("row", "item").distinct()
    wanted = pairs.join(items, "item").select("row", "item_id", "raw")

    def judge(key, left, right):
        text, own = left["raw"].to_pylist(), list(zip(right["item_id"].to_pylist(), binaries(right["raw"]), strict=True))
        if not text or not own:
            return pa.table([pa.array([], k) for k in (pa.int64(), *KINDS)], names=["row", *NAMES])
        index = build(own)
        ((n, spans, found),) = hits([text[0] or b""], index)
        return pa.table([pa.array([x], k) for x, k in zip((key[0].as_py(), *verdict(n, spans, sorted({index.ids[i] for i in found}))), (pa.int64(), *KINDS), strict=True)], names=["row", *NAMES])

    some = texts.join(pairs.select("row").distinct(), "row", "left_semi")
    found = some.groupBy("row").cogroup(wanted.groupBy("row")).applyInArrow(judge, f"row long, {FOUND}")
    sizes = marks.where("fp is null").select("row", F.col("n_words").alias("n"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    full = sizes.join(found, "row", "left").select(
        F.col("row").alias(row), F.col("n").alias("n_words"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")],
        F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )
    return numbered.select(*keep, row).join(full, row).select(*keep, *NAMES)


def annotate(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Columns of docs but those of FOUND, then FOUND. Null texts have no words; repeated rows
    are judged each; an empty table gives no rows.

    items (item_id, text): a null text or one without words is no item; rows with the
    same item_id are items of that id. Items of ``broadcast_bytes`` of text or less are one index,
    broadcast to a single scan; more of them are joined with the documents by fingerprint. Either
    way the same code extends the hits and counts them.
    """
    rows = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), raw_text().alias("raw")).distinct()
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, rows)
    return _scan(docs, build([(r.item_id, bytes(r.raw)) for r in rows.collect()]))
