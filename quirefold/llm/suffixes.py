"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

The suffixes to sort start at every byte of the input, but only such need sorting as can
be equal in their first SPAN bytes to another one. So each suffix is filed under a
leading token: the ANCHOR-byte string of least hash among those that lie within its
first SPAN bytes. Equal suffixes have the same leading token, and blocks.py counts the
leading tokens of the whole corpus; a suffix whose leading token occurs once is unique.

What is left is range-partitioned by leading token, document and place, with sampled
splitters. A bucket sorts its suffixes by multikey quicksort over characters of eight
bytes and finds equal neighbours; a leading token that a splitter cuts is compared
across the buckets' boundaries.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quirefold.llm.blocks import corpus_counts, in_blocks, reply, slices_for, with_replies
from quirefold.llm.common import arrow, BASE, batch, binaries, BYTE_VALUE, discard, distinct, distinct_counts, INVERSE, mix, places, powers, raw_text, runs, stored, sweep

SPAN = 100
ANCHOR = 40
U64 = np.uint64
OTHER = 0xD1342543DE82EF95
#: Bits that hold the place of an anchor, for the 2 GB that a value can have; those of the hash above order anchors.
PLACE_BITS = U64(31)
#: Bytes of segments that a bucket sorts at a time, whole leading tokens at least.
SORT_BYTES = 1 << 20
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive, by doubling."""
    m, size = key, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(key) - w + 1
    return np.minimum(m[:n], m[w - size : w - size + n])


def segments(texts: list[bytes], span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one leading token: text, first suffix, number, token's hash.

    Only suffixes of ``span`` bytes or more count. Both orders of two texts, and any
    cut into passes, give the same tokens: they depend on the bytes alone.
    """
    out: list[list[np.ndarray]] = [[], [], [], []]
    for lo, hi in runs(texts):
        joined = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        if len(joined) < span:
            continue
        n = len(joined)
        value = BYTE_VALUE[joined]
        value *= powers(BASE, n)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        h = total[anchor:] - total[:-anchor]
        h *= powers(INVERSE, n)[: len(h)]
        h = mix(h)
        place = np.arange(len(h), dtype=U64)
        at = (_least((h >> PLACE_BITS << PLACE_BITS) | place, span - anchor + 1) & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)
        sizes = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
        end = np.cumsum(sizes)
        ok = np.zeros(len(at), bool)
        text = np.repeat(np.arange(hi - lo), sizes)[: len(at)]
        ok[:] = np.arange(len(at)) + span <= end[text]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
        start = np.flatnonzero(new & ok)
        stop = np.flatnonzero(np.concatenate([new[1:] | ~ok[1:], [True]]) & ok) + 1
        out[0].append(text[start] + lo)
        out[1].append(start - (end - sizes)[text[start]])
        out[2].append(stop - start)
        out[3].append(mix(h[at[start]]))  # the least hashes are no even spread
    kinds = (np.int64, np.int64, np.int64, U64)
    return tuple(np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds, strict=True))


def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return distinct_counts(segments(binaries(table["raw"]))[3])


#: A row of a bucket: a segment with its bytes, or one whose suffixes all occur before in its block.
ROWS = "lead long, doc_id long, block long, text int, start long, n long, bytes binary"
RUNS = "lead long, block long, text int, start long, n long, part int, edge boolean, one long, two long"


def candidates(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The segments whose leading token occurs twice or more. Of equal segments in a
    block the later ones carry no bytes: their suffixes are known to be repeated."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def use(block, table, answers):
        texts = binaries(table["raw"])
        text, start, n, key = segments(texts)
        keys = distinct(key)
        twice = reply(answers)[places(keys, key)] > 1 if len(keys) else np.zeros(0, bool)
        text, start, n, key = text[twice], start[twice], n[twice], key[twice]
        seen, data = set(), []
        for t, a, k in zip(text.tolist(), start.tolist(), n.tolist(), strict=True):
            s = texts[t][a : a + k + SPAN - 1]
            data.append(None if s in seen else s)
            seen.add(s)
        ids = table["doc_id"].combine_chunks().take(pa.array(text))
        cols = [pa.array(key.view(np.int64)), ids, pa.array(np.full(len(text), block)), pa.array(text, pa.int32()), pa.array(start), pa.array(n), pa.array(data, pa.binary())]
        return pa.table([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return with_replies(blocks, counts.where("block >= 0").select("block", "slice", "totals"), use, ROWS)


def multikey(buf: np.ndarray, at: np.ndarray, group: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes at ``at`` within each group by their first ``span`` bytes.

    Returns the order and, in that order, the class of each: equal suffixes of a group are
    one class and stay in input order. Each level splits the parts of equal suffixes by
    the next eight bytes; parts that agree in these need no sorting there, and parts of
    one suffix are done.
    """
    n = len(buf)
    wide = np.zeros(n + 8, U64)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(U64)
    for i in range(8):
        wide[: n + 8] |= padded[i : i + n + 8] << U64(56 - 8 * i)
    order = np.argsort(group, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = np.diff(group[order]) != 0
    depths = [*range(0, span - 7, 8)]
    if depths[-1] + 8 < span:
        depths.append(span - 8)
    live = np.arange(len(at))  # positions in order that lie in parts of two or more
    for d in depths:
        alone = new[live] & np.concatenate([new[live][1:], [True]])
        live = live[~alone]
        if not len(live):
            break
        char = wide[at[order[live]] + d]
        first = new[live]
        part = np.cumsum(first) - 1
        differs = np.zeros(len(live), bool)
        differs[1:] = (char[1:] != char[:-1]) & ~first[1:]
        mixed = np.zeros(int(part[-1]) + 1, bool)
        mixed[part[differs]] = True
        todo = np.flatnonzero(mixed[part])
        if len(todo):
            p, c = part[todo], char[todo]
            by = np.argsort(c, kind="stable")
            by = by[np.argsort(p[by], kind="stable")]
            order[live[todo]] = order[live[todo]][by]
            c, p = c[by], p[by]
            cut = np.ones(len(todo), bool)
            cut[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
            new[live[todo]] = cut
    return order, np.cumsum(new) - 1


def repeated(lead: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Of the suffixes of some segments, in order: does an equal one stand before?"""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(len(n)), n)
    at = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(len(seg))
    order, kind = multikey(np.frombuffer(b"".join(data), np.uint8), at, lead[seg])
    out = np.zeros(len(seg), bool)
    same = np.zeros(len(seg), bool)
    same[1:] = kind[1:] == kind[:-1]
    out[order[same]] = True
    return out


def window_hashes(buf: np.ndarray, at: np.ndarray, base: int, inverse: int, span: int = SPAN) -> np.ndarray:
    value = BYTE_VALUE[buf]
    value *= powers(base, len(buf))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
    h = total[at + span] - total[at]
    h *= powers(inverse, len(buf))[at]
    return mix(h).view(np.int64)


def sort_buckets(rows: DataFrame) -> DataFrame:
    """Runs of repeated suffixes. Rows with ``edge``: suffixes new in their bucket, of its
    first or last leading token, with 128 bits of hash to be compared with other buckets'."""
    kinds = pa.schema(
        [("lead", pa.int64()), ("block", pa.int64()), ("text", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("part", pa.int32())]
        + [("edge", pa.bool_()), ("one", pa.int64()), ("two", pa.int64())]
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        first_lead = None
        size = 0

        def made(lead, block, text, start, n, edge, one=None, two=None):
            k = len(lead)
            none = np.zeros(k, np.int64)
            cols = [lead, block, text, start, n, np.full(k, part), np.full(k, edge), none if one is None else one, none if two is None else two]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, kinds, strict=True)], schema=kinds)

        def solve(last):
            lead, block, text, start, n = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:5])
            data = [r[5] for r in held]
            dup = repeated(lead, n, data)
            seg = np.repeat(np.arange(len(n)), n)
            first = np.cumsum(n) - n
            new = np.ones(len(seg), bool)
            new[1:] = seg[1:] != seg[:-1]
            opens = dup & (new | ~np.concatenate([[False], dup[:-1]]))
            closes = dup & (np.concatenate([new[1:], [True]]) | ~np.concatenate([dup[1:], [False]]))
            a, z = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            s = seg[a]
            if len(a):
                yield made(lead[s], block[s], text[s], start[s] + a - first[s], z - a, False)
            rim = (lead == first_lead) | ((lead == lead[-1]) if last else False)
            w = np.flatnonzero(rim[seg] & ~dup)
            if len(w):
                s = seg[w]
                sizes = np.fromiter(map(len, data), np.int64, len(data))
                at = (np.cumsum(sizes) - sizes)[s] + w - first[s]
                buf = np.frombuffer(b"".join(data), np.uint8)
                yield made(lead[s], block[s], text[s], start[s] + w - first[s], np.ones(len(w), np.int64), True, window_hashes(buf, at, BASE, INVERSE), window_hashes(buf, at, OTHER, pow(OTHER, -1, 1 << 64)))

        for b in batches:
            known = b.filter(b["bytes"].is_null())
            if len(known):
                yield made(*(known[c].to_numpy() for c in ("lead", "block", "text", "start", "n")), False)
            cols = [b[c].to_pylist() for c in ("lead", "block", "text", "start", "n", "bytes")]
            for r in zip(*cols, strict=True):
                if r[5] is None:
                    continue
                if first_lead is None:
                    first_lead = r[0]
                if size > SORT_BYTES and held[-1][0] != r[0]:
                    yield from solve(False)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield from solve(True)

    order = ("lead", "doc_id", "block", "text", "start")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).transform(arrow(run, RUNS))


def across_boundaries(found: DataFrame) -> DataFrame:
    """Runs found in buckets, and suffixes at a bucket's edge that an earlier bucket has.

    A bucket has each such suffix once, so a digest has a row a bucket at most.
    """
    first = F.min("part").over(Window.partitionBy("lead", "one", "two"))
    edges = found.where("edge").withColumn("first", first).where("part > first")
    return found.where("not edge").select("block", "text", "start", "n").unionByName(edges.select("block", "text", "start", "n"))


def split_too(buf: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """``covered``, with the other bytes of characters that it splits; no byte else."""
    at = np.arange(len(buf))
    lead = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, at, 0))
    first = buf[lead]
    size = 1 + (first >= 0xC0) + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    char = np.cumsum((lead == at) | (at - lead >= size)) - 1
    return (np.bincount(char, covered) > 0)[char]


def cut(text: bytes, start: np.ndarray, n: np.ndarray, span: int = SPAN) -> tuple[bytes, int, bytes]:
    """The text without the bytes that the repeated suffixes cover; maximal removed runs;
    the text without the characters of which they cover a byte."""
    gone = np.zeros(len(text) + 1, np.int64)
    np.add.at(gone, start, 1)
    np.add.at(gone, start + n + span - 1, -1)
    covered = np.cumsum(gone)[:-1] > 0
    spans = int((covered & ~np.concatenate([[False], covered[:-1]])).sum())
    buf = np.frombuffer(text, np.uint8)
    return buf[~covered].tobytes(), spans, buf[~split_too(buf, covered)].tobytes()


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) → the columns ``keep`` and RESULT, and with_text ``kept`` (binary),
    which also lacks the rest of characters that a cut splits; RESULT counts without them.

    Null texts count as empty, and so give the digest of no bytes; their ``kept`` is null. Of
    rows with one doc_id the order is that of the input, and a null id comes first. Texts below
    SPAN bytes lose nothing. RESULT is of bytes: a cut may fall inside a character.
    An empty table gives no rows.
    """
    rest = [F.col(c).alias(f"_{c}") for c in keep]
    blocks = in_blocks(docs.select("doc_id", raw_text().alias("raw"), *rest))
    counts = corpus_counts(blocks, keys_of, slices_for(blocks, each=1))
    sweep(docs.sparkSession)
    repeats = stored(sort_buckets(candidates(blocks, counts)), "repeats")
    discard(counts)
    gone = across_boundaries(repeats)
    sweep(docs.sparkSession)
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = StructType(docs.select(*keep).schema.fields + _parse_datatype_string(RESULT + ", kept binary" * with_text).fields)

    def use(_, table, runs_):
        texts = binaries(table["raw"])
        null = table["raw"].is_null().to_pylist()
        which = runs_["text"].to_numpy()
        order = np.argsort(which, kind="stable")
        start, n = runs_["start"].to_numpy()[order], runs_["n"].to_numpy()[order]
        edge = np.searchsorted(which[order], np.arange(len(texts) + 1))
        out = []
        for i, t in enumerate(texts):
            a, z = edge[i], edge[i + 1]
            kept, spans, chars = cut(t, start[a:z], n[a:z]) if z > a else (t, 0, t)
            out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), None if null[i] else chars)[: len(names)])
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.table([*(table[f"_{c}"] for c in keep), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *names])

    return with_replies(blocks, gone, use, schema)
