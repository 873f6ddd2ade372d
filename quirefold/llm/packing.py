"""Lexical retrieval packing over a sharded BM25 inverted index.

Index shards hold documents that are lexically alike. A bounded sample of documents gives
routers, and each document names the DEPTH routers whose BM25 weights, as vectors of length 1, score
highest for it, best first.
Documents are range-partitioned and sorted by those names, and each run of SHARD_DOCS of
them is a shard, so a shard is as fine a cell of that order as the corpus fills, at any size,
and a group of copies of any size is just several shards. Within a shard a window starts with a
seed, and the index returns the unused documents most like it, which fill the window in
that order. The last one is cut; what is left of it seeds the next window. So only a
shard's last window has padding. Document frequencies and the mean length of the index are
those of the whole corpus; the routers' are of their sample.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, batch, binaries, distinct, least_hashes, raw_text, runs, stored
from quirefold.llm.tokens import encoder

WINDOW = 2048
#: An index shard closes at so many documents or tokens; it holds one document at least.
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 22
#: Documents sampled for routers, the bytes of text that each of them has at most, and routers chosen.
SAMPLE, SAMPLE_BYTES, ROUTERS = 512, 1 << 16, 32
#: Routers that a document names; a sampled document this like a router becomes none.
DEPTH, ALIKE = 4, 0.5
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def bm25(tf: np.ndarray, length: np.ndarray | float, mean: float) -> np.ndarray:
    """The weight of a term's count before its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))


def bm25_idf(df: np.ndarray, n: int) -> np.ndarray:
    """0 for a term of half of all documents or more."""
    return np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))


class Routers:
    """BM25 weights of some documents: a row a term that any of them has, a column of length 1 a router."""

    def __init__(self, docs: list[np.ndarray], vocabulary: int, most: int = ROUTERS):
        seen = [np.unique(d, return_counts=True) for d in docs]
        df = np.zeros(vocabulary, np.int64)
        for u, _ in seen:
            df[u] += 1
        idf, mean = bm25_idf(df, len(docs)), float(np.mean([len(d) for d in docs])) if docs else 1.0
        columns: list[np.ndarray] = []
        for d, (u, c) in zip(docs, seen, strict=True):
            col = np.zeros(vocabulary, np.float32)
            col[u] = idf[u] * bm25(c.astype(float), float(len(d)), mean)
            own = float(col[u].sum())
            if own > 0 and all(float(x[u].sum()) < ALIKE * min(own, float(x.sum())) for x in columns):
                columns.append(col)
            if len(columns) == most:
                break
        matrix = np.stack([x / np.linalg.norm(x) for x in columns], 1) if columns else np.zeros((vocabulary, 0), np.float32)
        used = np.flatnonzero(matrix.any(1))
        self.row = np.full(vocabulary, len(used), np.int32)
        self.row[used] = np.arange(len(used))
        self.weight = np.concatenate([matrix[used], np.zeros((1, matrix.shape[1]), np.float32)])

    def key(self, terms: np.ndarray) -> int:
        """The names of the best routers of a document's distinct terms, first in the upper bits;
        a byte of 255 stands for none."""
        score = self.weight[self.row[terms]].sum(0)
        best = np.argsort(-score, kind="stable")[:DEPTH].tolist()
        names = [r if score[r] > 0 else 255 for r in best] + [255] * (DEPTH - len(best))
        return int.from_bytes(bytes(names), "big")


def routers(docs: DataFrame, tokenizer: str, end_id: int) -> Routers:
    """Of SAMPLE documents with some text, those of least hash; a copy takes no second place.

    A threshold on the hash leaves about twice as many rows before they are sorted, so the
    driver gets a bounded number whatever the number of tasks.
    """
    size = F.octet_length("text")
    rows = docs.where((size > 0) & (size <= SAMPLE_BYTES)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    some = rows.where(least_hashes(F.col("h"), 2 * SAMPLE, docs.count())).dropDuplicates(["h"])
    enc = encoder(tokenizer)
    texts = list(dict.fromkeys(r.text.encode() for r in some.orderBy("h").limit(SAMPLE).collect()))
    return Routers([x.astype(np.int64) for x in enc.ids(texts)], max(enc.vocabulary, end_id + 1))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, by: Routers) -> DataFrame:
    """row, doc_id, key (the routers named), ids (bytes, with the end id); and for each task a
    row with its counts: ids, and ``df``, their document frequencies, then documents and ids in all.
    Stored in the shared folder."""
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary()), ("df", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 33
        wide = id_width(enc.vocabulary, end_id)
        end = np.array([end_id], wide)
        df, total, first = np.zeros(max(enc.vocabulary, end_id + 1), np.int64), 0, row
        for b in batches:
            names, texts = b["doc_id"].to_pylist(), binaries(b["raw"])
            for lo, hi in runs(texts, 1 << 19):
                ids = [np.concatenate([x.astype(wide, copy=False), end]) for x in enc.ids(texts[lo:hi])]
                keys = []
                for x in ids:
                    u = distinct(x)
                    df[u] += 1
                    total += len(x)
                    keys.append(shared.value.key(u))
                yield batch(kinds, [np.arange(row, row + hi - lo), names[lo:hi], keys, [x.tobytes() for x in ids], [None] * (hi - lo)])
                row += hi - lo
        at = np.flatnonzero(df)
        counts = np.append(df[at], [row - first, total])
        yield batch(kinds, [[-1], [None], [-1], [at.astype("<i8").tobytes()], [counts.astype("<i8").tobytes()]])

    rows = docs.select("doc_id", raw_text().alias("raw")).transform(arrow(run, "row long, doc_id long, key long, ids binary, df binary"))
    return stored(rows, "tokens")


def id_width(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype(np.uint16 if max(vocabulary, end_id + 1) <= 1 << 16 else np.uint32)


def statistics(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, int, float]:
    """ids, their document frequencies, documents, mean length. The driver gets one row
    an id of the vocabulary, from the rows that the tasks of tokenized() have summed."""
    kinds = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for ids, df in zip(b["ids"].to_pylist(), b["df"].to_pylist(), strict=True):
                yield batch(kinds, [np.append(np.frombuffer(ids, "<i8"), [-1, -2]), np.frombuffer(df, "<i8")])

    found = tokens.where("df is not null").select("ids", "df").transform(arrow(run, "id long, n long")).groupBy("id").agg(F.sum("n").alias("n"))
    got = {r.id: r.n for r in found.collect()}
    docs, total = got.pop(-1, 0), got.pop(-2, 0)
    ids = np.array(sorted(got), np.int64)
    return ids, np.array([got[i] for i in ids.tolist()], np.int64), docs, total / max(1, docs)


class Shard:
    """The inverted index of one shard: postings by term with their BM25 weights.

    The weight of a term in half of all documents or more is 0, so such terms have no
    postings; nothing else is left out.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = [], []
        for d in docs:
            u, c = np.unique(d, return_counts=True)
            keep = idf[u] > 0
            terms.append(u[keep])
            counts.append(c[keep])
        self.terms = terms
        sizes = np.array([len(t) for t in terms])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        term = np.concatenate(terms) if terms else np.empty(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if terms else np.empty(0)
        length = np.array([len(d) for d in docs], np.float64)
        tf = bm25(tf, length[doc], mean)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], (idf[term] * tf)[order]
        present = np.bincount(term, minlength=len(idf))
        self.end = np.cumsum(present)
        self.size = present
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        n = self.size[t]
        at = np.repeat(self.end[t] - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(docs: list[np.ndarray], shard: Shard, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window number, offset) of all documents."""
    out = []
    unused = np.ones(len(docs), bool)
    next_seed, number, offset = 0, 0, 0
    doc, start = -1, 0
    ranking: list[int] = []
    while True:
        if doc < 0:
            if offset == 0:
                ranking = []
            while ranking and not unused[ranking[-1]]:
                ranking.pop()
            if ranking:
                doc = ranking.pop()
            else:
                while next_seed < len(docs) and not unused[next_seed]:
                    next_seed += 1
                if next_seed == len(docs):
                    break
                doc = next_seed
            start = 0
            unused[doc] = False
        seeding = offset == 0
        n = min(window - offset, len(docs[doc]) - start)
        out.append((doc, start, n, number, offset))
        offset, start = offset + n, start + n
        seed = doc
        if start == len(docs[doc]):
            doc = -1
        if offset == window:
            number, offset = number + 1, 0
        elif seeding and doc < 0:
            score = shard.scores(seed)
            near = np.flatnonzero(unused & (score > 0))
            ranking = near[np.argsort(-score[near], kind="stable")][::-1].tolist()
    return out


def shards(batches, width: np.dtype, shard_docs: int):
    """Lists of (doc_id, ids) of one index shard each, in the order of the rows."""
    own, size = [], 0
    for b in batches:
        for doc_id, raw in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True):
            x = np.frombuffer(raw, width)
            own.append((doc_id, x))
            size += len(x)
            if len(own) >= shard_docs or size >= SHARD_TOKENS:
                yield own
                own, size = [], 0
    if own:
        yield own


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """docs (doc_id, text) → PIECES, each id of each document in one piece.

    Null texts count as empty: one piece with the end id. Repeated rows are packed each, and
    a text longer than a window fills windows of its own, whatever its length. sequence_id is unique
    over all shards, not gapless. A task holds one index shard at a time, whose size
    doesn't grow with the corpus, and its longest document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    tokens = tokenized(docs, tokenizer, end_id, routers(docs, tokenizer, end_id))
    ids, df, n, mean = statistics(tokens)
    vocabulary = max(encoder(tokenizer).vocabulary, end_id + 1)
    idf = np.zeros(vocabulary)
    idf[ids] = bm25_idf(df, n)
    shared, width = spark.sparkContext.broadcast(idf), id_width(vocabulary, end_id)
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for own in shards(batches, width, shard_docs):
            names, arrays = [d for d, _ in own], [x for _, x in own]
            pieces = fill(arrays, Shard(arrays, shared.value, mean), window)
            crcs = [zlib.crc32(arrays[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in pieces]
            yield batch(kinds, [
                [names[p[0]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], crcs,
                [len(arrays[p[0]]) for p in pieces], [base + p[3] for p in pieces], [p[4] for p in pieces],
            ])
            base += pieces[-1][3] + 1

    rows = tokens.where("df is null").select("key", "row", "doc_id", "ids")
    alike = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return alike.select("doc_id", "ids").transform(arrow(run, PIECES))
