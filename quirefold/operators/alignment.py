"""Two extractors' lines, and contents entries and page heads, in the order that both have: longest common subsequences.

A book's lines meet in one task as integers. The lengths come from bit vectors, a word of many lines at a time, and the
subsequence itself from halving (Hirschberg), so memory grows with the lines and not with their product.
"""

from collections.abc import Hashable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.names import strip

SPANS = "key string, same boolean, a_line int, n_a int, b_line int, n_b int, a_page int, b_page int"


def common_lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """For each j the length of the longest common subsequence of a and the first j of b."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    rises = every  # a zero bit: the length rises there
    for x in a:
        if hit := places.get(x):
            own = rises & hit
            rises = ((rises + own) | (rises - own)) & every
    bits = np.unpackbits(np.frombuffer(rises.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        if n - i == 1:
            out += [(i, k) for k in range(j, m) if b[k] == a[i]][:1]
            continue
        mid, own = (i + n) // 2, b[j:m]
        k = int((common_lengths(a[i:mid], own) + common_lengths(a[mid:n][::-1], own[::-1])[::-1]).argmax())
        todo += [(i, mid, j, j + k), (mid, n, j + k, m)]
    return sorted(out)


def _lines(t: pa.Table) -> tuple[list[str], list[int]]:
    pages = sorted(zip(t["page_no"].to_pylist(), t["body"].to_pylist(), strict=True), key=lambda p: p[0])
    rows = [(x, n) for n, body in pages for x in (body or "").split("\n")]
    return [x for x, _ in rows], [n for _, n in rows]


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b: pages (key, page_no, body) of two extractors → SPANS: stretches of lines that are the same in both, and what stands
    between them in either, numbered from 0 through the book with the page where they begin (null: none). Pages
    needn't agree: a line may have moved to another page. Null pages have one empty line; a book that only one
    extractor has is one stretch that differs."""
    kinds = pa.schema([("key", pa.string()), ("same", pa.bool_()), *[(c, pa.int32()) for c in ("a_line", "n_a", "b_line", "n_b", "a_page", "b_page")]])

    def run(key, left, right):
        (x, x_page), (y, y_page) = _lines(left), _lines(right)
        rows, i, j = [], 0, 0

        def span(same, n, m):
            if n or m:
                rows.append((key[0].as_py(), same, i, n, j, m, x_page[i] if n else None, y_page[j] if m else None))

        pairs = [*common(x, y), (len(x), len(y))]
        k = 0
        while k < len(pairs):
            p, q = pairs[k]
            span(False, p - i, q - j)
            i, j = p, q
            while k < len(pairs) - 1 and pairs[k + 1] == (pairs[k][0] + 1, pairs[k][1] + 1) and pairs[k + 1] != (len(x), len(y)):
                k += 1
            if pairs[k] != (len(x), len(y)):
                n = pairs[k][0] - i + 1
                span(True, n, n)
                i, j = i + n, j + n
            k += 1
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds) if rows else kinds.empty_table()

    sides = [d.select(F.col("key").cast("string").alias("key"), F.col("page_no").cast("int").alias("page_no"), "body").groupBy("key") for d in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, SPANS)


def similarity(spans: DataFrame) -> DataFrame:
    """key, n_a, n_b, n_same, similarity: twice the same lines over all lines of both."""
    same = F.sum(F.when(F.col("same"), F.col("n_a")).otherwise(0))
    rows = spans.groupBy("key").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), same.alias("n_same"))
    return rows.withColumn("similarity", 2 * F.col("n_same") / (F.col("n_a") + F.col("n_b")))


def entry_title(line: Column) -> Column:
    """A contents entry or a page's head to compare: lower case, no Markdown signs, leaders or page number at its end, white
    space joined."""
    bare = F.regexp_replace(F.coalesce(line, F.lit("")), r"^[ \t]*[#*>-]*[ \t]*", "")
    for end in (" \t", "0123456789", " .\t"):  # from the end: white space, the number, the leaders; anchored, so lines aren't scanned for them
        bare = F.rtrim(bare, F.lit(end))
    return strip(F.regexp_replace(F.lower(bare), "[ \t]+", " "))


def place_entries(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """entries (key, pos, title) of a table of contents and pages (key, page_no, body) → entries with ``page_no``: the page whose
    first line is the entry, so that the pages ascend with the entries and as many as can be are placed; null for the others.
    So chapters are found without a pattern for headings. Blank entries and heads match nothing."""
    heads = pages.select(F.col("key"), "page_no", entry_title(F.split_part(F.coalesce("body", F.lit("")), F.lit("\n"), F.lit(1))).alias("t")).where("t <> ''")
    named = entries.select("key", "pos", entry_title(F.col("title")).alias("t")).where("t <> ''")
    heads = heads.join(named.select("key", "t").distinct(), ["key", "t"], "left_semi")  # pages that no entry names don't travel
    kinds = pa.schema([("key", pa.string()), ("pos", pa.int32()), ("page_no", pa.int32())])

    def run(key, left, right):
        left, right = left.sort_by("pos"), right.sort_by("page_no")
        pairs = common(left["t"].to_pylist(), right["t"].to_pylist())
        pos, page = left["pos"].to_pylist(), right["page_no"].to_pylist()
        cols = [[key[0].as_py()] * len(pairs), [pos[i] for i, _ in pairs], [page[j] for _, j in pairs]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    sides = [d.select(F.col("key").cast("string").alias("key"), F.col(n).cast("int").alias(n), "t").groupBy("key") for d, n in ((named, "pos"), (heads, "page_no"))]
    placed = sides[0].cogroup(sides[1]).applyInArrow(run, "key string, pos int, page_no int")
    return entries.join(placed.withColumnRenamed("key", "_key").withColumnRenamed("pos", "_pos"), (F.col("key").cast("string") == F.col("_key")) & (F.col("pos") == F.col("_pos")), "left").drop("_key", "_pos")


def with_parents(headings: DataFrame, key: str, most_levels: int = 6) -> DataFrame:
    """headings (key, pos, level) with ``parent``: the place of the last heading before with a lesser level, null at the top. One
    sort by book; the last heading of each level is carried along."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(1, most_levels)]
    none = F.lit(None).cast(dict(headings.dtypes)["pos"])
    carried = headings.withColumn("_last", F.array(*last))
    above = F.slice("_last", 1, F.least(F.greatest(F.col("level") - 1, F.lit(0)), F.lit(most_levels - 1)))
    return carried.withColumn("parent", F.coalesce(F.array_max(above), none)).drop("_last")
