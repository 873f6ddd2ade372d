"""Books published whole: everything goes to a folder of the run's own, then one pointer table is swapped, then the old goes.

    output/versions/RUN/books      a row a book: folder, key, metadata, number of bytes
    output/versions/RUN/index      a row a text file: folder, file, offset, n_bytes
    output/versions/RUN/text/F/…   the text of folder F, in files of ascending name
    output/versions/RUN/images/F/images/… its images
    output/pointers/N              folder, version: what is current; the greatest N that was written to its end counts

A reader asks the pointers first, so it sees a book's old version until the new one is there whole, text and images alike. A
run that ends early leaves files that no pointer names; the next publication removes them. One publication at a time.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.operators.assemble import PLAIN_BREAK
from quirefold.sources.store import children, exists, remove

POINTER = "folder string, version string"
INDEX = "folder string, file string, offset long, n_bytes long"
#: Bytes after which a text file ends; the row that passes the mark still goes into it.
FILE_BYTES = 64 << 20


def version_path(output: str, version: str) -> str:
    return f"{output.rstrip('/')}/versions/{version}"


def _pointers(spark: SparkSession, output: str) -> list[int]:
    """Numbers of the pointer tables that were written to their end, ascending."""
    top = f"{output.rstrip('/')}/pointers"
    return sorted(int(n) for n in children(spark, top) if n.isdigit() and exists(spark, f"{top}/{n}/_SUCCESS"))


def current(spark: SparkSession, output: str) -> DataFrame:
    """folder, version of all books that are published."""
    numbers = _pointers(spark, output)
    return spark.read.schema(POINTER).parquet(f"{output.rstrip('/')}/pointers/{numbers[-1]}") if numbers else spark.createDataFrame([], POINTER)


def _tables(spark: SparkSession, output: str, table: str, schema: str) -> DataFrame:
    """A table of all versions, only the rows of current books."""
    live = current(spark, output)
    paths = [f"{version_path(output, r.version)}/{table}" for r in live.select("version").distinct().collect()]  # a row a run that still has books
    if not paths:
        return spark.createDataFrame([], schema + ", version string")
    of = F.regexp_extract(F.col("_metadata.file_path"), "/versions/([^/]+)/", 1)
    return spark.read.schema(schema).parquet(*paths).withColumn("version", of).join(live, ["folder", "version"], "left_semi")


BOOK = "folder string, key string, metadata string, n_bytes long, n_chunks long"


def books(spark: SparkSession, output: str) -> DataFrame:
    return _tables(spark, output, "books", BOOK)


def text_files(spark: SparkSession, output: str) -> DataFrame:
    """folder, file, offset, n_bytes, version: where each part of each book lies."""
    return _tables(spark, output, "index", INDEX)


def read_text(spark: SparkSession, output: str, folder: str) -> Iterator[bytes]:
    """The text of one book, file by file in order; at most one file is in memory."""
    files = text_files(spark, output).where(F.col("folder") == folder).orderBy("offset")
    fs, base = FileSystem.from_uri(output)
    for r in files.collect():
        with fs.open_input_stream(f"{version_path(base, r.version)}/text/{r.folder}/{r.file}") as f:
            yield f.read()


def with_offsets(segments: DataFrame) -> DataFrame:
    """segments (folder, start_page, n_bytes) with ``offset``: where a segment's bytes begin in the book, the blank line between
    segments before its text. Narrow rows; a book's numbers are sorted in one task, its text isn't."""
    w = Window.partitionBy("folder").orderBy("start_page")
    gap = F.when(F.row_number().over(w) == 1, 0).otherwise(len(PLAIN_BREAK))
    sized = segments.withColumn("_all", F.col("n_bytes") + gap).withColumn("first", F.row_number().over(w) == 1)
    before = F.coalesce(F.sum("_all").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("offset", before.cast("long")).drop("_all")


def write_text(segments: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """segments (folder, offset, first, text) → files ``root/folder/OFFSET.md`` and their index rows.

    Segments are range-partitioned by folder and offset, so a large book is written by many tasks, and sorted; a task appends
    row after row and holds one batch of rows. Joined in order of name the files are the book. A task that
    runs again writes the same files. Lazy, as any DataFrame.
    """
    kinds = pa.schema([("folder", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        fs, base = FileSystem.from_uri(root)
        out, at, size = None, None, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((at[0], at[1], at[2], size), kinds, strict=True)], schema=kinds)

        for b in batches:
            rows = zip(*(b[c] for c in ("folder", "offset", "first", "text")), strict=True)
            for folder, offset, first, text in ((f.as_py(), o.as_py(), x.as_py(), t.as_py() or b"") for f, o, x, t in rows):
                if out is None or at[0] != folder or size >= file_bytes:
                    if out is not None:
                        yield close()
                    at, size = (folder, f"{offset:015d}.md", offset), 0
                    fs.create_dir(f"{base.rstrip('/')}/{folder}", recursive=True)
                    out = fs.open_output_stream(f"{base.rstrip('/')}/{folder}/{at[1]}")
                data = text if first else PLAIN_BREAK.encode() + text
                out.write(data)
                size += len(data)
        if out is not None:
            yield close()

    rows = segments.select("folder", "offset", "first", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.repartitionByRange("folder", "offset").sortWithinPartitions("folder", "offset").mapInArrow(run, INDEX)


def switch(spark: SparkSession, output: str, version: str, folders: DataFrame) -> None:
    """Makes ``version`` current for the folders. The write of the new pointer table, of which the marker comes last, is the one
    moment at which readers change over."""
    old = current(spark, output)
    new = folders.select("folder", F.lit(version).alias("version"))
    numbers = _pointers(spark, output)
    at = f"{output.rstrip('/')}/pointers/{(numbers or [0])[-1] + 1}"
    old.join(new.select("folder"), "folder", "left_anti").unionByName(new).write.mode("overwrite").parquet(at)


def sweep_old(spark: SparkSession, output: str) -> None:
    """Removes pointer tables but the last, versions that none of its rows names (unfinished runs too) and, in those that stay,
    the files of folders that moved on."""
    numbers = _pointers(spark, output)
    if not numbers:
        return
    top = f"{output.rstrip('/')}/pointers"
    for n in children(spark, top):
        if n != str(numbers[-1]):
            remove(spark, f"{top}/{n}")
    live = current(spark, output)
    named = {r.version for r in live.select("version").distinct().collect()}
    for v in children(spark, f"{output.rstrip('/')}/versions"):
        at = version_path(output, v)
        if v not in named:
            remove(spark, at)
            continue
        own = live.where(F.col("version") == v)
        gone = spark.read.schema(BOOK).parquet(f"{at}/books").select("folder").distinct().join(own, "folder", "left_anti")
        for r in gone.toLocalIterator():
            remove(spark, f"{at}/text/{r.folder}")
            remove(spark, f"{at}/images/{r.folder}")
