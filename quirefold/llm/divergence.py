"""How far the sources of a language lie apart, by integer-coded term counts.

Terms are counted by language and source in one pass over the text. The counts, range-partitioned and sorted by language
and term, are cut into chunks of kept terms: a chunk is a stretch of the sorted dictionary, a term's id its place
there, so ids follow UTF-8 order. A group's counts in a chunk are one dense vector. All pairs of groups meet chunk by chunk
(and, where a language has many sources, by blocks of groups), and only sums and the best terms leave a task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.blocks import pack_counts, unpack_counts
from quirefold.llm.common import arrow, binaries, distinct_counts, raw_text, runs, stored, table
from quirefold.llm.spans import Spans

#: Letters and all of non-ASCII; only A-Z are lower-cased.
TERMS = table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
MIN_DOCS = 3
TOP = 200
SHARE = 1_000_000_000
PASS = 1 << 20
#: Distinct counts that a task holds before it passes them on.
HELD = 400_000
#: Terms of a chunk, and counts read for one at most (or one term's).
CHUNK_TERMS, CHUNK_ROWS = 4096, 1 << 20
#: Groups of a language that a task compares with as many others.
BLOCK_GROUPS = 256
SALTS = 16


def coded(words: Spans) -> tuple[np.ndarray, pa.Array]:
    """An integer for each word, and the words of these integers."""
    offsets = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int32)
    data = np.ascontiguousarray(words.bytes[words.inside])
    terms = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return terms.indices.to_numpy().astype(np.int64), terms.dictionary


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) → lang, source, term, n (occurrences), d (documents with it); stored. A group also has a
    row of the empty term, so that it is there without terms."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches):
        held = kinds.empty_table()
        for b in batches:
            texts = binaries(b["raw"])
            pair = pa.StructArray.from_arrays([b["lang"], b["source"]], names=["lang", "source"])
            names = [(x["lang"], x["source"]) for x in pair.to_pylist()]
            groups = sorted(set(names))
            number = {g: i for i, g in enumerate(groups)}
            of_doc = np.array([number[x] for x in names], np.int64)
            lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            parts = [held, pa.table([lang, source, pa.array([""] * len(groups)), pa.array([0] * len(groups)), pa.array([0] * len(groups))], schema=kinds)]
            for lo, hi in runs(texts, PASS):
                words = Spans(texts[lo:hi], TERMS)
                if not len(words):
                    continue
                code, terms = coded(words)
                v = len(terms)
                at, n = distinct_counts(words.owner * v + code)
                at = of_doc[lo + at // v] * v + at % v
                order = np.argsort(at, kind="stable")
                at, n = at[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                g, t = pa.array(at[first] // v), pa.array(at[first] % v)
                parts.append(pa.table([lang.take(g), source.take(g), terms.take(t), pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, len(at))))], schema=kinds))
            held = pa.concat_tables(parts)
            if len(held) > HELD:
                held = held.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("d", "sum")]).rename_columns(kinds.names).cast(kinds)
                if len(held) > HELD // 2:
                    yield from held.to_batches(max_chunksize=1 << 16)
                    held = kinds.empty_table()
        yield from held.to_batches(max_chunksize=1 << 16)

    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], raw_text().alias("raw"))
    rows = named.transform(arrow(run, "lang string, source string, term string, n long, d long"))
    return stored(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")


def chunk_vectors(counts: DataFrame) -> DataFrame:
    """counts → lang, chunk, source, counts, total, terms; stored. A row a chunk and source that occurs there, and one
    of null source with the language's own counts and the chunk's terms, ascending."""
    kinds = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("counts", pa.binary()), ("total", pa.int64()), ("terms", pa.list_(pa.string()))])

    def run(batches):
        number, held = TaskContext.get().partitionId() << 24, None

        def cut(t: pa.Table, last: bool):
            """Chunks of whole terms from the sorted rows, and the rows left."""
            nonlocal number
            lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
            new_lang, new_term = (np.asarray(pc.not_equal(c[1:], c[:-1])) for c in (lang, term))
            start = np.flatnonzero(np.concatenate([[True], new_lang | new_term]))  # of each term's rows
            if not last:
                start, t = start[:-1], (t, t.slice(start[-1]))
                done, rest = t[0].slice(0, len(t[0]) - len(t[1])), t[1]
            else:
                done, rest = t, None
            out = []
            if len(start):
                n, d = (done[c].to_numpy() for c in ("n", "d"))
                kept = np.add.reduceat(d, start) >= MIN_DOCS
                of_lang = np.concatenate([[0], np.cumsum(new_lang)])[start]
                size = np.diff(np.append(start, len(done)))
                for k in np.unique(of_lang):
                    own = np.flatnonzero(kept & (of_lang == k))
                    for lo in range(0, len(own), CHUNK_TERMS):
                        at = own[lo : lo + CHUNK_TERMS]
                        rows = np.repeat(start[at], size[at]) + np.arange(size[at].sum()) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                        ids = np.searchsorted(start[at], rows, side="right") - 1
                        sources = done["source"].take(pa.array(rows)).combine_chunks().dictionary_encode()
                        groups, width = len(sources.dictionary), len(at)
                        dense = np.bincount(sources.indices.to_numpy() * width + ids, n[rows], groups * width).astype(np.int64).reshape(groups, width)
                        whole = [dense.sum(0), *dense]
                        name = lang[int(start[at[0]])].as_py()
                        terms = term.take(pa.array(start[at])).to_pylist()
                        out.append(pa.table(
                            [[name] * (groups + 1), [number] * (groups + 1), [None, *sources.dictionary.to_pylist()], [pack_counts(v) for v in whole], [int(v.sum()) for v in whole], [terms, *[None] * groups]],
                            schema=kinds,
                        ))
                        number += 1
            return out, rest

        for b in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            if len(held) >= CHUNK_ROWS // 8:
                out, held = cut(held, False)
                for t in out:
                    yield from t.to_batches()
        if held is not None and len(held):
            for t in cut(held, True)[0]:
                yield from t.to_batches()

    terms = counts.where("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return stored(terms.transform(arrow(run, "lang string, chunk long, source string, counts binary, total long, terms array<string>")), "chunk-vectors")


def shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / of), exact while ``of`` is below 9 * 10**15: three digits at a time."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """At most 10**18, as shares are at most 10**9 + 1."""
    return (p - q) * (p - q) // q


def compare(t: pa.Table, block_groups: int, top: int) -> pa.Table:
    """One chunk for one pair of blocks of groups: sums for all pairs of theirs, and each group's best terms."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("pair", pa.bool_())])
    lang, i, j = (t[c][0].as_py() for c in ("lang", "i", "j"))
    own = pc.is_null(t["source"])
    head, rest = t.filter(own), t.filter(pc.invert(own)).sort_by("number")
    terms = head["terms"][0].as_py() if len(head) else []
    width, names, block = len(terms), rest["source"].to_pylist(), rest["number"].to_numpy() // block_groups
    count = np.zeros((len(names), width), np.int64)
    for k, c in enumerate(rest["counts"].to_pylist()):
        if c is not None:
            count[k] = unpack_counts(c)
    out = []
    p = shares(count, (rest["n_own"].to_numpy() + rest["n_kept"].to_numpy())[:, None]) if width else count
    for a in range(len(names)):
        others = np.flatnonzero(block == (j if block[a] == i else i))
        f = divergence(p[a], p[others]).sum(1)
        out += [(lang, names[a], names[b], int(v), True) for b, v in zip(others.tolist(), f, strict=True) if b != a]
    if width and i == j:
        q = shares(unpack_counts(head["counts"][0].as_py()), np.int64(head["n_own"][0].as_py() + head["n_kept"][0].as_py()))
        for a, name in enumerate(names):
            at = np.flatnonzero((count[a] > 0) & (p[a] > q))
            f = divergence(p[a][at], q[at])
            best = np.lexsort((at, -f))[:top]
            out += [(lang, name, terms[k], int(v), False) for k, v in zip(at[best].tolist(), f[best].tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds) if out else kinds.empty_table()


def audit(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) → lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language, by the divergence from it over all kept terms; part ``term``: the
    terms that a source has more of than its language, TOP at most. Kept are the terms in at least MIN_DOCS
    documents of the language. Null texts, languages and sources are empty ones; rows that stand twice are two documents;
    a text of any length is read whole. A source alone in its language has no pairs. An empty table gives no
    rows. Other columns are ignored.
    """
    counts = term_counts(docs)
    vectors = chunk_vectors(counts)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    heads = vectors.where("source is null")
    langs = heads.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_kept"), F.sum("total").alias("n_lang"))
    totals = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("n_own"))
    groups = counts.where("term = ''").select("lang", "source").withColumn("number", number)
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_own", "n_kept", "n_lang"])
    block = F.floor(F.col("number") / BLOCK_GROUPS).cast("int")
    groups = stored(groups.withColumn("block", block), "groups")
    sizes = groups.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"), F.first("n_kept").alias("n_kept"), F.first("n_lang").alias("n_lang"))

    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    none = F.lit(None)
    # chunk -1 has no terms: with it, sources of a language without kept terms have pairs too
    chunks = heads.select("lang", "chunk").unionByName(sizes.select("lang", F.lit(-1).cast("long").alias("chunk"))).withColumn("salt", salt("chunk"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cells = salted.join(chunks, ["lang", "salt"]).join(sizes.select("lang", "n_blocks"), "lang")
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    cells = cells.join(vectors.where("source is not null").select("lang", "chunk", "source", "counts"), ["lang", "chunk", "source"], "left")
    rows = cells.select(
        "lang", "chunk", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "source", "number", "n_own", "n_kept", "counts",
        none.cast("array<string>").alias("terms"),
    )
    own = heads.join(sizes, "lang").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    own = own.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("n_blocks") - 1)))
    own = own.select("lang", "chunk", "i", "j", none.cast("string").alias("source"), F.lit(-1).alias("number"), F.col("n_lang").alias("n_own"), "n_kept", "counts", "terms")
    block_groups, top = BLOCK_GROUPS, TOP
    run = lambda t: compare(t, block_groups, top)
    found = rows.unionByName(own).groupBy("lang", "chunk", "i", "j").applyInArrow(run, "lang string, source string, item string, value long, pair boolean")
    found = stored(found, "divergences")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    terms = found.where("not pair").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
