"""Nearest neighbours by blocks: int8 product tiles with error bounds, then exact products of what survives.

Every vector is kept with its int8 codes, their scale, and the norm of what the codes lose. The product of two rows of codes
then gives the inner product up to a bound (Cauchy-Schwarz), so a pair whose upper bound is below the k-th best
product of its query can be left out without loss. Stripes of candidates meet groups of queries in one task each; both are
bounded in bytes, and a task works through tiles of them. Its lists, best first, are merged by heaps.
"""

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, batch, release, stored

K = 20
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
#: Bytes of the vectors that a task holds of either side.
STRIPE_BYTES = 64 << 20
#: Queries of a tile, and pairs that are recomputed at a time.
TILE, PAIRS = 256, 1 << 16
#: Queries whose lists are merged in one group.
MERGED = 32
#: So many products of codes add up exactly in single precision.
EXACT_DIMS = (1 << 24) // 127**2
#: Relative allowance for rounding in norms, bounds and products.
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale, and norms: of the vector, of its codes times scale, of the difference."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None])
    near = code * scale[:, None]
    return code.astype(np.int8), scale, *(np.sqrt((v * v).sum(1)) for v in (x, near, x - near))


def _write(vec_id: np.ndarray, row: np.ndarray, x: np.ndarray) -> bytes:
    code, scale, norm, near, lost = quantise(x)
    dim = x.shape[1]
    cols = {
        "vec_id": pa.array(vec_id), "row": pa.array(row), "scale": pa.array(scale), "norm": pa.array(norm), "near": pa.array(near), "lost": pa.array(lost),
        "code": pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(code))]),
        "vector": pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), dim),
    }
    t, sink = pa.table(cols), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


class Vectors:
    """What a payload holds, as arrays; ``only`` picks rows."""

    def __init__(self, payloads: list[bytes], only=None):
        t = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads]).combine_chunks()
        self.vec_id, self.row, self.scale, self.norm, self.near, self.lost = (t[c].to_numpy() for c in ("vec_id", "row", "scale", "norm", "near", "lost"))
        v, c = t["vector"].chunk(0), t["code"].chunk(0)
        self.dim = v.type.list_size
        self.vector = v.values.to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        self.code = np.frombuffer(c.buffers()[1], np.int8)[c.offset * self.dim :][: len(t) * self.dim].reshape(-1, self.dim)


def in_blocks(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding → block, dim, n, n_bytes, payload; stored. Rows that take no part are gone."""
    kinds = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("n_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        number, held = TaskContext.get().partitionId() << 24, {}

        def close(dim):
            nonlocal number
            ids, x = (np.concatenate(v) for v in zip(*held.pop(dim), strict=True))
            out = [[number], [dim], [len(x)], [len(x) * row_bytes(dim, x.itemsize)], [_write(ids, (number << 13) + np.arange(len(x)), x)]]
            number += 1
            return batch(kinds, out)

        for b in batches:
            ids, lists = b["vec_id"], b["embedding"]
            whole = np.asarray(pc.and_(ids.is_valid(), lists.is_valid()))
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat, at = lists.flatten(), np.cumsum(size) - size  # nulls are no part of flatten()
            good = np.asarray(flat.is_valid())
            x = flat.fill_null(0).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(good & np.isfinite(x))]), np.concatenate([[0], np.cumsum(x != 0)])
            fine, some = (s[at + size] - s[at] for s in sums)
            whole &= (size > 0) & (fine == size) & (some > 0)
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            for dim in np.unique(size[whole]).tolist():
                own = np.flatnonzero(whole & (size == dim))
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes(dim, x.itemsize)))
                while len(own):
                    room = most - sum(len(v) for v, _ in held.get(dim, []))
                    take, own = own[:room], own[room:]
                    held.setdefault(dim, []).append((ids[take], x[at[take][:, None] + np.arange(dim)]))
                    if len(take) == room:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)

    schema = "block long, dim int, n int, n_bytes long, payload binary"
    return stored(vectors.select("vec_id", "embedding").transform(arrow(run, schema)), "vectors")


def row_bytes(dim: int, itemsize: int) -> int:
    return dim * (itemsize + 1) + 48


def query_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of each block whose id is divisible by ``every``, as a block."""
    kinds = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("n_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for b in batches:
            for block, payload in zip(b["block"].to_pylist(), b["payload"].to_pylist(), strict=True):
                v = Vectors([payload])
                own = v.vec_id % every == 0
                if own.any():
                    n = int(own.sum())
                    yield batch(kinds, [[block], [v.dim], [n], [n * row_bytes(v.dim, v.vector.itemsize)], [_write(v.vec_id[own], v.row[own], v.vector[own])]])

    return stored(blocks.select("block", "payload").transform(arrow(run, "block long, dim int, n int, n_bytes long, payload binary")), "query-vectors")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of two blocks of codes. Whole numbers in single precision, exact within EXACT_DIMS."""
    out = 0
    for lo in range(0, a.shape[1], EXACT_DIMS):
        part = a[:, lo : lo + EXACT_DIMS].astype(np.float32) @ b[:, lo : lo + EXACT_DIMS].astype(np.float32).T
        out = part.astype(np.float64) + out
    return out


class Best:
    """The k best of each query so far, sorted: greatest product, then least id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.vec_id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        own = np.unique(q)
        at = np.concatenate([np.searchsorted(own, q), np.repeat(np.arange(len(own)), self.k)])
        score, vec_id = np.concatenate([score, self.score[own].ravel()]), np.concatenate([vec_id, self.vec_id[own].ravel()])
        order = np.lexsort((vec_id, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = order[place < self.k]
        self.score[own], self.vec_id[own] = score[top].reshape(-1, self.k), vec_id[top].reshape(-1, self.k)


def meet(q: Vectors, c: Vectors, best: Best) -> int:
    """One block of candidates against all queries, tile by tile; the number of pairs recomputed."""
    recomputed = 0
    for lo in range(0, len(q.row), TILE):
        s = slice(lo, lo + TILE)
        near = products(q.code[s], c.code) * (q.scale[s, None] * c.scale)
        off = q.near[s, None] * c.lost + q.lost[s, None] * c.norm + SLACK * (q.norm[s, None] * c.norm)
        own = q.row[s, None] == c.row
        least = best.score[s, -1]
        if len(c.row) > best.k and (least == -np.inf).any():
            low = np.where(own, -np.inf, near - off)
            least = np.maximum(least, np.partition(low, -best.k, axis=1)[:, -best.k])
        a, b = np.nonzero((near + off >= least[:, None]) & ~own)
        recomputed += len(a)
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS] + lo, b[i : i + PAIRS]
            exact = (q.vector[x].astype(np.float64) * c.vector[y].astype(np.float64)).sum(1)
            best.add(x, exact, c.vec_id[y])
    return recomputed


def search(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """vectors (vec_id, embedding) → query_id, rank, vec_id, score: for each row whose id is divisible by ``every``,
    the k rows of greatest inner product, all where there are fewer; exact, with ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part. Of rows with
    one id each is a row of its own: a query doesn't find itself, but finds the others. Vectors of different
    lengths don't meet. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    blocks = in_blocks(vectors)
    queries = query_blocks(blocks, every)
    n, n_bytes = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    n_queries, query_bytes = queries.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    groups = -(-query_bytes // STRIPE_BYTES) or 1
    stripes = max(1, -(-n_bytes // STRIPE_BYTES), min(n, 4 * spark.sparkContext.defaultParallelism))

    def dealt(m: int):
        return F.pmod(F.xxhash64("block"), F.lit(m)).cast("int")

    def all_of(m: int):
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    left = queries.select("dim", dealt(groups).alias("g"), all_of(stripes).alias("s"), "block", "payload")
    right = blocks.select("dim", all_of(groups).alias("g"), dealt(stripes).alias("s"), "block", "payload")
    kinds = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("score", pa.list_(pa.float64())), ("vec_id", pa.list_(pa.int64()))])

    def run(_, own, there):
        if not len(own) or not len(there):
            return kinds.empty_table()
        q = Vectors(own["payload"].to_pylist())
        best = Best(len(q.row), k)
        for p in there["payload"]:
            meet(q, Vectors([p.as_py()]), best)
        n = (best.score > -np.inf).sum(1)
        keep, offsets = best.score > -np.inf, pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[keep])) for x in (best.score, best.vec_id)]
        release()
        return pa.table([pa.array(q.row), pa.array(q.vec_id), *lists], schema=kinds)

    keys = ("dim", "g", "s")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, query_id long, score array<double>, vec_id array<long>")
    part = F.pmod(F.xxhash64("query"), F.lit(max(1, n_queries // MERGED)))
    out = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def merge(t: pa.Table) -> pa.Table:
        lists: dict[int, list] = {}
        for query, query_id, score, vec_id in zip(*(t[c].to_pylist() for c in ("query", "query_id", "score", "vec_id")), strict=True):
            lists.setdefault(query, [query_id]).append(zip([-x for x in score], vec_id, strict=True))
        rows = [(query_id, r, i, -s) for query_id, *own in lists.values() for r, (s, i) in enumerate(islice(heapq.merge(*own), k), 1)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out) if rows else out.empty_table()

    return found.withColumn("part", part).groupBy("part").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
