"""Documents in blocks, and corpus counts of keys sent back to the blocks.

A block is some megabytes of whole documents, compressed in one row of a table in
the shared folder. Each block sends its distinct 64-bit keys, sorted, in slices of the
key space; the task of a slice adds the counts of all blocks and answers each with
the totals in the block's own key order, which need no keys. So a key that is in every
document meets once a block, and no vocabulary is collected or broadcast. A block sends a row a
slice that it has keys of. Beyond DEEP_SLICES, where that would be many small rows, blocks
first meet in groups of about the root of their number: a group sends the union of its keys, and
its blocks are answered from the group's totals.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, batch, release, stored

BLOCK_BYTES = 8 << 20
DEEP_SLICES = 1 << 13
#: Blocks whose keys a task of a group holds at a time, about.
HELD_BLOCKS = 8
U64 = np.uint64
_ZSTD = "zstd"
#: Of a block, which is written once and travels twice or thrice.
LEVEL = 5


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec(_ZSTD, compression_level=LEVEL)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a binary column ``raw`` and ``doc_id`` → block, n_rows, payload; stored.

    Rows of a block are in ascending doc_id, null first, then in input order. A block holds
    one document at least, so memory is bounded by block_bytes and the longest one.
    """
    kinds = pa.schema([("block", pa.int64()), ("n_rows", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        parts, size = [], 0

        def close():
            t = pa.concat_tables(parts)
            order = pc.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_start")
            return batch(kinds, [[number], [len(t)], [_pack(t.take(order).combine_chunks())]])

        for b in batches:
            t = pa.Table.from_batches([b])
            sizes = np.asarray(pc.fill_null(pc.binary_length(b["raw"]), 0))
            lo = 0
            for i, n in enumerate(sizes.tolist()):
                size += n + 16
                if size >= block_bytes:
                    parts.append(t.slice(lo, i + 1 - lo))
                    yield close()
                    number, parts, size, lo = number + 1, [], 0, i + 1
            if lo < len(t):
                parts.append(t.slice(lo))
        if parts:
            yield close()

    return stored(docs.transform(arrow(run, "block long, n_rows long, payload binary")), "blocks")


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences of as few bytes as the largest needs."""
    d = np.diff(keys, prepend=U64(0))
    n = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([n]) + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    n = data[0]
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(-1, n)
    full = np.zeros((len(rows), 8), np.uint8)
    full[:, :n] = rows
    return np.cumsum(full.view("<u8").ravel().astype(U64), dtype=U64)


def pack_counts(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64
    raw = counts.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, _ZSTD, asbytes=True)


def unpack_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], size, _ZSTD, asbytes=True) if size else b""
    return np.frombuffer(raw, f"<u{data[0]}").astype(np.int64)


KeyMaker = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


SENT = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("totals", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64()), ("even", pa.int64()), ("even_total", pa.int64())])
ANSWER_SQL = "block long, slice int, totals binary, distinct long, total long, even long, even_total long"


def in_slices(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending keys as a row for each slice, of 2**bits, that has some."""
    own = keys >> U64(64 - bits) if bits else np.zeros(len(keys), U64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # slices without a key cost nothing
    edge = [*first.tolist(), len(keys)]
    rows = [(s, block, pack_keys(keys[a:z]), pack_counts(counts[a:z])) for s, a, z in zip(own[first].tolist(), edge[:-1], edge[1:], strict=True)]
    return batch(SENT, list(zip(*rows, strict=True)))


def united(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of several ascending lists once, and the place there of each key of theirs."""
    flat = np.concatenate(parts)
    order = np.argsort(flat)
    ranked = flat[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.empty(len(flat), np.int64)
    at[order] = np.cumsum(first) - 1
    return ranked[first], at


def added(key, table):
    """One slice: the totals for each block that has sent keys, and a row of block -1 with the slice's sums."""
    s = key[0].as_py()
    parts = [unpack_keys(k) for k in table["keys"].to_pylist()]
    counts = [unpack_counts(c) for c in table["counts"].to_pylist()]
    blocks_ = table["block"].to_pylist()
    distinct, at = united(parts)
    sums = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    used = sums > 0
    even = used & (distinct & U64(1) == 0)
    back, lo = [], 0
    for p in parts:
        back.append(pack_counts(sums[at[lo : lo + len(p)]]))
        lo += len(p)
    n = len(parts)
    return pa.table(
        [
            pa.array([*blocks_, -1], pa.int64()), pa.array([s] * (n + 1), pa.int32()), pa.array([*back, b""], pa.binary()),
            pa.array([0] * n + [int(used.sum())], pa.int64()), pa.array([0] * n + [int(sums.sum())], pa.int64()),
            pa.array([0] * n + [int(even.sum())], pa.int64()), pa.array([0] * n + [int(sums[even].sum())], pa.int64()),
        ],
        schema=ANSWER,
    )


def sent_keys(blocks: DataFrame, keys_of: KeyMaker, bits: int) -> DataFrame:
    """slice, block, keys, counts of all blocks."""

    def send(batches):
        for b in batches:
            for block, payload in zip(b["block"].to_pylist(), b["payload"].to_pylist(), strict=True):
                keys, counts = keys_of(unpack(payload))
                if len(keys):
                    yield in_slices(block, keys, counts, bits)
                del keys, counts
                release()

    return blocks.select("block", "payload").transform(arrow(send, "slice int, block long, keys binary, counts binary"))


def corpus_counts(blocks: DataFrame, keys_of: KeyMaker, slices: int) -> DataFrame:
    """keys_of(table) → a block's distinct keys ascending and what each adds.

    Returns block, slice, totals (see reply()); rows of block -1 hold what stats() sums. A
    slice's task holds its share of all blocks' keys, so ``slices`` must grow with the
    corpus: a power of two, by default that of slices_for().
    """
    bits = slices.bit_length() - 1
    assert slices == 1 << bits
    if slices > DEEP_SLICES:
        return grouped_counts(blocks, keys_of, bits)
    answered = sent_keys(blocks, keys_of, bits).groupBy("slice").applyInArrow(added, ANSWER_SQL)
    return stored(answered, "counts")


def grouped_counts(blocks: DataFrame, keys_of: KeyMaker, bits: int) -> DataFrame:
    """The same by way of groups. With n blocks there are about sqrt(n) groups of as many blocks; a block sends a row a coarse slice,
    of which a group's tasks take one each, and a group a row a slice: some n * sqrt(n) rows either way, of many
    keys each. The keys that were sent are stored, as they are read again when the totals come back."""
    n = blocks.count()
    groups = 1 << ((n - 1).bit_length() // 2)
    coarse = min(bits, max(0, (n // groups // HELD_BLOCKS).bit_length()))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g")
    sent = stored(sent_keys(blocks, keys_of, coarse).select("slice", "block", "keys", "counts", group), "sent")

    def unite(key, t):
        keys, at = united([unpack_keys(k) for k in t["keys"].to_pylist()])
        sums = np.bincount(at, np.concatenate([unpack_counts(c) for c in t["counts"].to_pylist()]), len(keys)).astype(np.int64)
        return pa.Table.from_batches([in_slices(key[0].as_py(), keys, sums, bits)])

    unions = sent.groupBy("g", "slice").applyInArrow(unite, "slice int, block long, keys binary, counts binary")
    totals = stored(unions.groupBy("slice").applyInArrow(added, ANSWER_SQL), "group-counts")

    def answer(key, own, back):
        if not len(own):
            return ANSWER.empty_table()
        parts = [unpack_keys(k) for k in own["keys"].to_pylist()]
        _, at = united(parts)
        sums, out, lo = reply(back), [], 0
        for p in parts:
            out.append(pack_counts(sums[at[lo : lo + len(p)]]))
            lo += len(p)
        none = [0] * len(parts)
        cols = [own["block"].to_pylist(), [key[1].as_py()] * len(parts), out, none, none, none, none]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ANSWER, strict=True)], schema=ANSWER)

    back = totals.where("block >= 0").select(F.col("block").alias("g"), F.shiftright("slice", bits - coarse).alias("c"), "slice", "totals")
    mine = sent.withColumnRenamed("slice", "c").groupBy("g", "c").cogroup(back.groupBy("g", "c"))
    return stored(mine.applyInArrow(answer, ANSWER_SQL).unionByName(totals.where("block = -1")), "counts")


def slices_for(blocks: DataFrame, least: int = 16, each: int = 2) -> int:
    """A power of two, at least ``each`` slices a block."""
    n = blocks.count() * each
    return max(least, 1 << max(0, (n - 1).bit_length()))


def stats(counts: DataFrame):
    """Sums over the slices: distinct, total; even, even_total for keys whose last bit is 0."""
    own = counts.where("block = -1")
    return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("distinct", "total", "even", "even_total")]).first()


def reply(table: pa.Table) -> np.ndarray:
    """All totals of a block in the order of its keys."""
    order = np.argsort(table["slice"].to_numpy(), kind="stable")
    raw = table["totals"].to_pylist()
    return np.concatenate([unpack_counts(raw[i]) for i in order] or [np.empty(0, np.int64)])


def with_replies(blocks: DataFrame, replies: DataFrame, use: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
    """use(block, documents, rows of replies) for each block."""

    def run(key, left, right):
        try:
            return use(key[0].as_py(), unpack(left["payload"][0].as_py()), right)
        finally:
            release()

    return blocks.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
