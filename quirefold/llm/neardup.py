"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's words (A-Z lowered, digits, letters, non-ASCII) give shingles of five words; a
text of fewer words is one shingle. A shingle's weight is its count times the mean
idf of its words. Document frequencies cover all documents; words are hashed to
2**IDF_BITS bins, so the table has a fixed size, is summed on the map side and
broadcast. Texts with equal words are one node. Samples are banded; nodes that
share a band are compared by the weighted Jaccard similarity of their vectors.

The head of a band's bucket is the node whose buckets are largest in sum: in a group of near
copies that is one near their common origin. First each node is compared with the heads of
its buckets, as many pairs as there are members. Where the links found leave a bucket in
several components, its pairs across components follow; the members of its largest
component, its home, aren't compared with each other. In a bucket of at most SMALL nodes the
pairs are joined. A larger one is dealt into groups of a bounded number of nodes and bytes,
and each two groups meet in a task of their own, which returns links only as far as they join
components. So no bucket has a cap and none is held in one task. The work in such a bucket
grows with its nodes times those of them that are outside its home.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, batch, binaries, discard, distinct, grams, ITEM_WORDS, mix, raw_text, runs, stored, sweep, Words
from quirefold.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
IDF_BITS = 18
POOL_BITS = 16
#: Nodes of a bucket whose pairs are joined; nodes and bytes of vectors in a group of a larger one, on average.
SMALL, TILE, TILE_BYTES = 32, 128, 8 << 20
U64 = np.uint64


def word_bins(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - IDF_BITS)).astype(np.int64)


def digests(w: Words) -> list[bytes]:
    """Equal for texts of equal words."""
    raw = w.hash.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def idf_table(docs: DataFrame) -> np.ndarray:
    """log((N + 1) / (df + 1)) + 1 of each bin, over all rows; 2**IDF_BITS values."""
    kinds = pa.schema([("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        df, n = np.zeros(1 << IDF_BITS, np.int64), 0
        for b in batches:
            texts = binaries(b["raw"])
            n += len(texts)
            for lo, hi in runs(texts):
                w = Words(texts[lo:hi], ITEM_WORDS)
                pair = distinct((w.owner() << IDF_BITS) | word_bins(w.hash))
                df += np.bincount(pair & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
        at = np.flatnonzero(df)
        yield batch(kinds, [np.append(at, -1), np.append(df[at], n)])

    counts = docs.select(raw_text().alias("raw")).transform(arrow(run, "bin int, n long")).groupBy("bin").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    df, n = np.zeros(1 << IDF_BITS), 0
    for b, v in zip(got["bin"].to_numpy(), got["n"].to_numpy(), strict=True):
        if b < 0:
            n = v
        else:
            df[b] = v
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


def vectors(w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, hash, weight; by owner, then by hash."""
    value = idf[word_bins(w.hash)].astype(np.float64)
    owner = w.owner()
    parts = []
    g = grams(w.hash, SHINGLE)
    if len(g):
        ok = owner[: len(g)] == owner[SHINGLE - 1 :]
        sums = np.concatenate([[0], np.cumsum(value)])
        mean = (sums[SHINGLE:] - sums[:-SHINGLE]) / SHINGLE
        parts.append((owner[: len(g)][ok], g[ok], mean[ok]))
    sizes = np.diff(w.first)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        a, b = int(w.first[i]), int(w.first[i + 1])
        parts.append((np.array([i]), grams(w.hash[a:b], b - a), value[a:b].mean(keepdims=True)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0)
    own, key, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(own[order], kind="stable")]
    own, key, weight = own[order], key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])]))
    count = np.diff(np.append(first, len(own)))
    return own[first], key[first], weight[first] * count


class Sampler:
    """Consistent samples: equal shingles of equal weight draw alike in every text.

    The draws (r, c, beta) of a shingle and sample come from a pool of 2**POOL_BITS
    triples, chosen by a hash of both.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        u = rng.random((5, 1 << POOL_BITS))
        u = np.clip(u, 1e-12, 1)
        self.r = (-np.log(u[0] * u[1])).astype(np.float32)
        self.r_inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        self.beta = u[4].astype(np.float32)
        self.factor = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)

    def bands(self, own: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n rows of BANDS keys; a text without shingles has zeros."""
        out = np.zeros((n, BANDS), np.int64)
        if not len(own):
            return out
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        log_w = np.log(weight).astype(np.float32)
        at = np.arange(len(own), dtype=U64)
        for b in range(BANDS):
            h = np.full(len(start), b + 1, U64)
            for j in range(b * ROWS, (b + 1) * ROWS):
                i = (key * self.factor[j]) >> U64(64 - POOL_BITS)
                i = i.astype(np.int32)
                r, beta = self.r[i], self.beta[i]
                t = np.floor(log_w * self.r_inverse[i] + beta)
                a = self.log_c[i] - r * (t - beta) - r
                bits = a.view(np.uint32)
                bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
                least = np.minimum.reduceat((bits.astype(U64) << U64(32)) | at, start) & U64(0xFFFFFFFF)
                won = least.astype(np.int64)
                h = mix(h * U64(0x9E3779B97F4A7C15) + key[won] + t[won].astype(np.int64).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            out[own[start], b] = h.view(np.int64)
        return out


def row_key() -> Column:
    """Of id and text; never null."""
    text = F.coalesce(F.md5(raw_text()), F.lit("null"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, row_key, node (digest of the words), bands, shingles (distinct ones); stored."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    kinds = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("shingles", pa.int64())])

    def run(batches):
        sampler = Sampler()
        for b in batches:
            texts, names, row_keys = binaries(b["raw"]), b["doc_id"], b["row_key"]
            for lo, hi in runs(texts):
                w = Words(texts[lo:hi], ITEM_WORDS)
                own, key, weight = vectors(w, shared.value)
                bands = sampler.bands(own, key, weight, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield batch(kinds, [names.slice(lo, hi - lo), row_keys.slice(lo, hi - lo), pa.array(digests(w), pa.binary()), lists, pa.array(np.bincount(own, minlength=hi - lo))])

    rows = docs.select("doc_id", row_key().alias("row_key"), raw_text().alias("raw"))
    return stored(rows.transform(arrow(run, "doc_id long, row_key string, node binary, bands array<long>, shingles long")), "signed")


def stored_vectors(docs: DataFrame, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, vec for the given (node, row_key), one row a node."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    kinds = pa.schema([("node", pa.binary()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            texts, nodes_ = binaries(b["raw"]), b["node"]
            for lo, hi in runs(texts):
                own, key, weight = vectors(Words(texts[lo:hi], ITEM_WORDS), shared.value)
                edge = np.searchsorted(own, np.arange(hi - lo + 1))
                vecs = [pack_vector(key[x:y], weight[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield batch(kinds, [nodes_.slice(lo, hi - lo), vecs])

    rows = docs.select(row_key().alias("row_key"), raw_text().alias("raw")).join(nodes.select("node", "row_key"), "row_key").select("node", "raw")
    return stored(rows.transform(arrow(run, "node binary, vec binary")).dropDuplicates(["node"]), "vectors")


def pack_vector(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Upper 32 bits of each hash, ascending, then single-precision weights."""
    return (key >> U64(32)).astype("<u4").tobytes() + weight.astype("<f4").tobytes()


def unpack_vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 8
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<f4", n, 4 * n).astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Two empty vectors are equal."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[at] == ka
    common = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def verified(pairs: DataFrame, vecs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of that similarity or more; stored."""
    kinds = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for x in batches:
            keep = [
                (a, b)
                for a, b, va, vb in zip(*(x[c].to_pylist() for c in ("a", "b", "va", "vb")), strict=True)
                if weighted_jaccard(unpack_vector(va), unpack_vector(vb)) >= least
            ]
            if keep:
                yield batch(kinds, list(zip(*keep, strict=True)))

    a = vecs.select(F.col("node").alias("a"), F.col("vec").alias("va"))
    b = vecs.select(F.col("node").alias("b"), F.col("vec").alias("vb"))
    return stored(pairs.join(b, "b").join(a, "a").select("a", "b", "va", "vb").transform(arrow(run, "a binary, b binary")), "links")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets whose nodes are in several components: bucket, node, shingles,
    label, and of the bucket size, home (the label of most nodes), n_home and bytes."""
    labels = components(links)
    at = stored(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    discard(labels)
    parts = at.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    most = F.max(F.struct("n", "label"))
    several = parts.groupBy("bucket").agg(F.count("*").alias("x"), F.sum("n").alias("size"), (8 * F.sum("s")).alias("bytes"), most.alias("m")).where("x > 1")
    opened = stored(at.join(several.select("bucket", "size", "bytes", F.col("m.label").alias("home"), F.col("m.n").alias("n_home")), "bucket"), "open")
    discard(at)
    return opened


def bucketed(signatures: DataFrame) -> DataFrame:
    """Members of the buckets of two nodes or more: bucket, node, row_key, shingles, head; stored."""
    nodes = signatures.groupBy("node").agg(*[F.min(c).alias(c) for c in ("row_key", "bands", "shingles")])
    banded = nodes.select("node", "row_key", "shingles", F.posexplode("bands").alias("band", "key"))
    banded = banded.select(F.xxhash64("band", "key").alias("bucket"), "node", "row_key", "shingles")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(sizes, "bucket"), "members")
    popular = members.groupBy("node").agg(F.sum("size").alias("popular"))
    heads = members.select("bucket", "node").join(popular, "node").groupBy("bucket").agg(F.max(F.struct("popular", "node"))["node"].alias("head"))
    out = stored(members.join(heads, "bucket").select("bucket", "node", "row_key", "shingles", "head"), "members")
    discard(members)
    return out


def near_links(signatures: DataFrame, docs: DataFrame, idf: np.ndarray, least: float = SIMILARITY) -> DataFrame:
    """node pairs of ``least`` similarity or more that hold the components together; stored."""
    members = bucketed(signatures)
    vecs = stored_vectors(docs, members.groupBy("node").agg(F.min("row_key").alias("row_key")), idf)
    sweep(docs.sparkSession)
    star = members.where("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    first = verified(star, vecs, least)
    sweep(docs.sparkSession)
    opened = _open(members.select("bucket", "node", "shingles"), first)
    links = stored(first.unionByName(compared(opened, vecs, least)).distinct(), "links")
    discard(members, vecs, first, opened)
    return links


def compared(opened: DataFrame, vecs: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of different labels of each bucket, whatever its size."""
    one, two = (opened.where(F.col("size") <= SMALL).select("bucket", F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in "ab")
    pairs = one.join(two, "bucket").where("a < b and la <> lb").select("a", "b").distinct()
    return verified(pairs, vecs, least).unionByName(tile_links(opened.where(F.col("size") > SMALL), vecs, least))


def overlaps(vecs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of the lesser weights, for all pairs of some vectors.

    The lesser of two weights is the sum of the steps between a shingle's weights that
    both reach, so each step is a column and the sums are a matrix product.
    """
    n = len(vecs)
    own = np.repeat(np.arange(n), [len(k) for k, _ in vecs])
    key = np.concatenate([k for k, _ in vecs]).astype(np.int64)
    weight = np.concatenate([w for _, w in vecs])
    order = np.lexsort((weight, key))
    own, key, weight = own[order], key[order], weight[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    new = new_key | np.concatenate([[True], weight[1:] != weight[:-1]]) if len(key) else new_key
    level = np.cumsum(new) - 1
    first = level[np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))] if len(key) else level
    step = weight[new] - np.where(new_key[new], 0, np.concatenate([[0], weight[new][:-1]])) if len(key) else weight
    total = np.zeros((n, n))
    columns = 4096
    for lo in range(0, len(step), columns):
        hi = min(lo + columns, len(step))
        part = np.zeros((n, hi - lo), np.float32)
        a, z = np.maximum(first, lo), np.minimum(level + 1, hi)
        use = np.flatnonzero(a < z)
        reach = z[use] - a[use]
        at = np.repeat(a[use] - lo - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        part[np.repeat(own[use], reach), at] = np.sqrt(step[lo:hi], dtype=np.float32)[at]
        total += part @ part.T
    return total


def tile_links(members: DataFrame, vecs: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of a bucket with different labels, found tile by tile.

    Groups below ``rest`` hold nodes outside the bucket's home, those from there on the home's.
    """
    kinds = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    n_of = lambda n: F.ceil(F.greatest(n / TILE, F.col("bytes") * n / F.col("size") / TILE_BYTES)).cast("int")
    rest, home = n_of(F.col("size") - F.col("n_home")), n_of(F.col("n_home"))
    at_home = F.col("label") == F.col("home")
    dealt = members.withColumns({"rest": rest, "all": rest + home, "in": F.xxhash64("node")})
    dealt = dealt.withColumn("g", F.when(at_home, F.col("rest") + F.pmod("in", F.col("all") - F.col("rest"))).otherwise(F.pmod("in", F.col("rest"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(at_home, F.col("rest")).otherwise(F.col("all")) - 1))
    tiles = dealt.select("bucket", "node", "label", "g", other.alias("h")).select(
        "bucket", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "node", "label"
    )

    def run(key, table):
        nodes, labels, raw = (table[c].to_pylist() for c in ("node", "label", "vec"))
        unpacked = [unpack_vector(v) for v in raw]
        root = {x: x for x in labels}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        if len(root) > 1:
            total = np.array([w.sum() for _, w in unpacked])
            common = overlaps(unpacked)
            near = common >= (least - 0.01) * (total[:, None] + total[None, :] - common)
            for a, b in np.argwhere(np.triu(near, 1)).tolist():
                la, lb = top(labels[a]), top(labels[b])
                if la != lb and weighted_jaccard(unpacked[a], unpacked[b]) >= least:
                    root[la] = lb
                    found.append((nodes[a], nodes[b]))
        cols = list(zip(*found, strict=True)) or [[], []]
        return pa.table([pa.array(c, pa.binary()) for c in cols], schema=kinds)

    return tiles.join(vecs, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def _labelled(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, links, and the label of each node."""
    docs = docs.select("doc_id", "text")
    idf = idf_table(docs)
    signatures = signed(docs, idf)
    links = near_links(signatures, docs, idf, least)
    nodes = signatures.select("node").distinct().join(components(links), "node", "left")
    return signatures, links, nodes.withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (links of its text that
    made the classes), one row a document.

    Null texts and texts without words are one class. Rows with equal words are one
    class whatever their number; a class without any id has a null class_id. Columns but
    doc_id and text are not read. An empty table gives no rows.
    """
    signatures, links, labels = _labelled(docs, least)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    n_links = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    own = signatures.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(labels, "node")
    top = own.groupBy("label").agg(F.min("least_id").alias("class_id"))
    table = own.join(top, "label").join(n_links, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signatures.select("doc_id", "node").join(table, "node").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The row of least doc_id of each class, all columns. A row without id stays only where
    its class has no id; of rows with one id and text that whose other columns are least as
    JSON stays, whatever their types. Null texts and texts without words are one class."""
    signatures, _, labels = _labelled(docs, least)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    own = signatures.groupBy("node").agg(F.min(place).alias("p")).join(labels, "node")
    stay = own.groupBy("label").agg(F.min("p").alias("p")).select(F.col("p.row_key").alias("__key"))
    found = docs.withColumn("__key", row_key()).join(stay, "__key")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return found.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), order).alias("r")).select("r.*")
