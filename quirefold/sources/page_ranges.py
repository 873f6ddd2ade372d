"""Pages of text files by range: an index of where pages begin, and reads of no other bytes than those of the pages asked for.

The index is made by byte ranges, so one large file is scanned by many tasks; a row holds the page starts within one
range. Pages end at form feeds. ``read`` takes the ranges as a table; ``load`` is a data source that plans a partition a
stretch of pages and takes what is asked for as pushed filters.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
INDEX = "key string, path string, length long, first_page int, n_starts int, starts array<long>"
PAGES = "key string, page_no int, body string, start_page int, n_bytes long"
FORM_FEED = 0x0C


def reachable(path: str) -> bool:
    """Whether tasks can open files of this path's store."""
    try:
        FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _breaks(fs: FileSystem, path: str, lo: int, hi: int) -> np.ndarray:
    """Places of the form feeds in a stretch of bytes."""
    out = [np.empty(0, np.int64)]
    with fs.open_input_file(path) as f:
        f.seek(lo)
        while lo < hi:
            data = np.frombuffer(f.read(min(READ_BYTES, hi - lo)), np.uint8)
            if not len(data):
                break
            out.append(np.flatnonzero(data == FORM_FEED) + lo)
            lo += len(data)
    return np.concatenate(out)


def index(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (key, path, length) → INDEX. Page 0 begins at byte 0, every other after a form feed; an empty file has
    one empty page. Not stored: the caller does."""
    n = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1)).cast("int")
    ranges = files.select("key", "path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("r"))
    kinds = pa.schema([("key", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("r", pa.int32()), ("starts", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, path = FileSystem.from_uri(row["path"])
                lo = row["r"] * range_bytes
                starts = _breaks(fs, path, lo, min(lo + range_bytes, row["length"])) + 1
                starts = np.concatenate([[0], starts]) if row["r"] == 0 else starts
                cols = [[row["key"]], [row["path"]], [row["length"]], [row["r"]], [starts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], schema=kinds)

    found = ranges.repartition("key", "r").mapInArrow(run, "key string, path string, length long, r int, starts array<long>")
    before = Window.partitionBy("key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0)).cast("int")
    return found.withColumn("first_page", first).where(F.size("starts") > 0).select("key", "path", "length", "first_page", F.size("starts").alias("n_starts"), "starts")


def page_counts(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("key").agg(F.sum("n_starts").cast("int").alias("n_pages"))


def _place(indexed: DataFrame, wanted: DataFrame, page: str, name: str) -> DataFrame:
    """wanted with the byte at which ``page`` begins; null past the last one. An equi join by key with one index row each."""
    at = F.col("_p") - F.col("first_page")
    rows = wanted.withColumn("_p", F.col(page)).join(
        indexed.select(F.col("key").alias("_k"), "first_page", "n_starts", "starts"), (F.col("key") == F.col("_k")) & (at >= 0) & (at < F.col("n_starts")), "left"
    )
    return rows.withColumn(name, F.get("starts", at)).select(*wanted.columns, name)


def read(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, start_page, end_page) → PAGES, ``n_bytes`` being the bytes that were read for a page. A task reads one range
    after the other and holds the pages of one; ranges spread over tasks, whatever file they are of."""
    files = indexed.groupBy("key").agg(F.first("path").alias("path"), F.first("length").alias("length"))
    placed = _place(indexed, _place(indexed, wanted.select("key", "start_page", "end_page"), "start_page", "lo"), "end_page", "hi")
    spans = placed.join(files, "key").select("key", "path", "start_page", "lo", F.coalesce(F.col("hi") - 1, "length").alias("hi")).where("lo is not null")
    kinds = pa.schema([("key", pa.string()), ("page_no", pa.int32()), ("body", pa.string()), ("start_page", pa.int32()), ("n_bytes", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                pages = list(_read_span(row["path"], row["lo"], row["hi"]))
                n, first = len(pages), row["start_page"]
                cols = [[row["key"]] * n, list(range(first, first + n)), [p.decode("utf-8", "replace") for p in pages], [first] * n, [len(p) + (i + 1 < n) for i, p in enumerate(pages)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], schema=kinds)

    return spans.repartition("key", "start_page").mapInArrow(run, PAGES)


def _read_span(path: str, lo: int, hi: int) -> list[bytes]:
    fs, at = FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        f.seek(lo)
        return f.read(hi - lo).split(b"\f")


class Stretch(InputPartition):
    def __init__(self, key: str, path: str, first: int, lo: int, hi: int):
        self.key, self.path, self.first, self.lo, self.hi = key, path, first, lo, hi


class PageReader(DataSourceReader):
    """Partitions from the index that ``options['index']`` names: up to ``pages`` pages each, only those that the filters on key
    and page_no leave."""

    def __init__(self, options: dict):
        self.index, self.pages = options["index"], int(options.get("pages", 150))
        self.keys, self.first, self.end = None, 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            page = f.attribute == ("page_no",) if hasattr(f, "attribute") else False
            if page and isinstance(f, EqualTo):
                self.first, self.end = max(self.first, f.value), min(self.end, f.value + 1)
            elif page and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif page and isinstance(f, LessThan | LessThanOrEqual):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            elif getattr(f, "attribute", None) == ("key",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = own if self.keys is None else self.keys & own
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        import pyarrow.dataset as ds

        fs, at = FileSystem.from_uri(self.index)
        wanted = ds.field("first_page") < self.end
        if self.keys is not None:
            wanted &= ds.field("key").isin(sorted(self.keys))
        books: dict[str, list] = {}
        for b in ds.dataset(at, filesystem=fs, format="parquet").to_batches(filter=wanted):
            for r in b.to_pylist():
                books.setdefault(r["key"], []).append(r)
        out = []
        for key, rows in sorted(books.items()):
            starts = {r["first_page"] + i: s for r in rows for i, s in enumerate(r["starts"])}
            end = min(self.end, max(starts) + 1)
            for first in range(self.first, end, self.pages):
                last = min(first + self.pages, end)
                # the page after may lie beyond the rows that were read: its start is then the first of what follows
                out.append(Stretch(key, rows[0]["path"], first, starts[first], starts[last] - 1 if last in starts else -1 if last == self.end else rows[0]["length"]))
        return out

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        n = None
        if stretch.hi < 0:  # the last page asked for ends at the next form feed
            stretch.hi, n = _end_of(stretch.path, stretch.lo, self.end - stretch.first), self.end - stretch.first
        for i, p in enumerate(_read_span(stretch.path, stretch.lo, stretch.hi)[:n]):
            yield stretch.key, stretch.first + i, p.decode("utf-8", "replace")


def _end_of(path: str, lo: int, n: int) -> int:
    """The byte at which the n-th page from lo ends."""
    fs, at = FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        f.seek(lo)
        while data := f.read(READ_BYTES):
            found = np.flatnonzero(np.frombuffer(data, np.uint8) == FORM_FEED)
            if len(found) >= n:
                return lo + int(found[n - 1])
            n, lo = n - len(found), lo + len(data)
    return lo


class PageRanges(DataSource):
    """key, page_no, body of indexed files; see ``load``."""

    @classmethod
    def name(cls) -> str:
        return "page_ranges"

    def schema(self) -> str:
        return "key string, page_no int, body string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def load(spark: SparkSession, index: str, pages: int = 150) -> DataFrame:
    """The source as a table; the session lets it see filters from now on. Spark keeps a loaded source's last plan and uses it
    for a query without filters, so one that is always true stands before any other."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageRanges)
    return spark.read.format("page_ranges").option("index", index).option("pages", pages).load().where("page_no >= 0")
