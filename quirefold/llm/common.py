"""What several operators share: Arrow helpers, word hashing."""

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.scratch import discard as discard
from quirefold.sources.scratch import scratch as scratch
from quirefold.sources.scratch import stored as stored

U64 = np.uint64
#: Bytes of text that one numpy pass handles; a longer document makes a pass of its own.
PASS_BYTES = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which executors drop the shuffle files of jobs that
    are over. Else these stay until the driver happens to run short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def set_apart(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text", "lang", "n_chars")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose columns but ``own`` have names that clash with no operator's, and a
    function that gives the first names back to all columns of docs and drops all others."""
    first = docs.columns
    apart = [c if c in own else f"extra_{i}" for i, c in enumerate(first)]
    return docs.toDF(*apart), lambda df: df.select(*[F.col(a).alias(c) for a, c in zip(apart, first, strict=True)])


def without(docs: DataFrame, *names: str) -> list[str]:
    """Columns of docs but those of these names, which Spark reads in any case."""
    return [c for c in docs.columns if c.lower() not in names]


def free(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it one that docs doesn't have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name = f"_{name}"
    return name


def crc_remainder(doc_id: str | Column, m: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % m


def held_out(m: int) -> Column:
    """doc_id as text, crc32, remainder 2; a null id is never held out."""
    return F.coalesce(crc_remainder("doc_id", m) == 2, F.lit(False))


def least_hashes(h: Column, n: int, of: int) -> Column:
    """True for about the n least of so many evenly spread 64-bit hashes."""
    return F.lit(True) if n >= of else h < F.lit(-(1 << 63) + n * (1 << 64) // of)


def raw_text(name: str = "text") -> Column:
    return F.col(name).cast("binary")


def release() -> None:
    """Gives freed memory back to the system; a worker that is used again keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch where the session sets no bound itself; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Rows of an Arrow batch that a task turns into Python objects at a time.
SLICE_ROWS = 1000


def tidy(run):
    """A function of Arrow batches that sees them in slices and leaves no memory behind."""

    def sliced(batches):
        for b in batches:
            for lo in range(0, len(b), SLICE_ROWS):
                yield b.slice(lo, SLICE_ROWS)

    def tidied(batches):
        yield from run(sliced(batches))
        release()

    return tidied


def arrow(run, schema):
    """For ``df.transform``: mapInArrow by ``run``, which sees bounded batches."""

    def mapped(df: DataFrame) -> DataFrame:
        bound = "spark.sql.execution.arrow.maxBytesPerBatch"
        if df.sparkSession.conf.get(bound, None) is None:
            df.sparkSession.conf.set(bound, BATCH_BYTES)
        return df.mapInArrow(tidy(run), schema)

    return mapped


def binaries(col) -> list[bytes]:
    """Null reads as empty."""
    return [x or b"" for x in col.to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def runs(texts: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Half-open ranges of documents of about ``limit`` bytes together, one document at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grows by doubling and is kept."""
    p = _pow.get(base)
    if p is None or len(p) < n:
        p = np.ones(1, U64)
        step = U64(base)
        while len(p) < max(n, 2 * PASS_BYTES):
            p = np.concatenate([p, p * step])
            step = U64(int(step) ** 2 % (1 << 64))
        _pow[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them; works in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by sorting."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def places(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in ascending keys; sorted first, which keeps the search in cache."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(keys, x[order])
    return out


def table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Byte to byte: 0 for separators, A-Z to a-z; others stay, bytes of non-ASCII too."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words between ASCII white space; NUL is a word character there.
BLANK_WORDS = table(SPACES)
#: Words of digits, letters and all of non-ASCII.
ITEM_WORDS = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end of each span."""
    n = len(data)
    value = BYTE_VALUE[data]
    value *= powers(BASE, n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    h = total[end]
    h -= total[start]
    h *= powers(INVERSE, n)[start]
    h += (end - start).astype(U64)
    return mix(h)


class Words:
    """The words of some texts: start and end bytes, 64-bit hashes, first word of each text."""

    def __init__(self, texts: list[bytes], lut: np.ndarray):
        joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        low = lut[joined]
        inside = low != 0
        if lut is BLANK_WORDS:
            inside |= joined == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, self.text_start)
        self.hash = span_hashes(low, self.start, self.end)
        self.bytes = low

    def __len__(self):
        return len(self.start)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words at every position; the caller drops those that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= U64(0xFF51AFD7ED558CCD)
        g += h[j : j + n]
    return mix(g)


def inside_text(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the n_words - k + 1 positions have k words of one text."""
    n = max(0, n_words - k + 1)
    ok = np.ones(n, bool)
    for e in first[1:-1] if len(first) < 2000 else ():
        ok[max(0, e - k + 1) : e] = False
    if len(first) >= 2000:
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ok = owner[:n] == owner[k - 1 : k - 1 + n]
    return ok
