"""Scans: batch lists, whole files of any Hadoop file system, pages, archives."""

import io
import re
import zipfile
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.names import input_key
from quirefold.sources.scratch import stored

#: What may stand before a path: a scheme and slashes in any number.
SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:/*"


def _bare(path: str) -> str:
    return re.sub(SCHEME, "/", path)


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def batch_list(spark: SparkSession, inputs: list[str]) -> DataFrame:
    rows = list(enumerate(inputs, 1))
    return spark.createDataFrame(rows, "input_ord int, raw_input string").withColumn("input_key", input_key("raw_input"))


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, length, content: any scheme that Hadoop knows; content is pruned if not selected."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


def text_pages(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines as pages, numbered from 0. An empty text has one page, a null text none."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("page_no", "body")
    return docs.select(F.col(key), lines)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some input paths that are files; a batch list is the user's own and short."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for p in dict.fromkeys(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if fs.exists(at) and fs.getFileStatus(at).isFile():
            found.append(p)
    return found


def repositories(spark: SparkSession, root: str) -> DataFrame:
    """repo_path: folders below ``root`` that hold a ``.git``, at any depth. Tasks list the folders of one depth after the
    other, each folder in one of them (Spark's own listing leaves hidden ones out); links aren't followed."""
    kinds = pa.schema([("path", pa.string()), ("repo", pa.bool_())])

    def run(batches):
        fs, _ = FileSystem.from_uri(root)
        for b in batches:
            for here in b["path"].to_pylist():
                below = [f for f in fs.get_file_info(FileSelector(here)) if f.type == FileType.Directory]
                rows = [(f.path, False) for f in below if f.base_name != ".git"]
                rows += [(here, True)] if len(rows) < len(below) else []
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True) if rows else ([], []), kinds, strict=True)], schema=kinds)

    level, found = spark.createDataFrame([(FileSystem.from_uri(root)[1],)], "path string"), []
    while not level.isEmpty():
        n = spark.sparkContext.defaultParallelism
        listed = stored(level.repartition(n).mapInArrow(run, "path string, repo boolean"), "folders")
        found.append(listed.where("repo").select(F.col("path").alias("repo_path")))
        level = listed.where("not repo").select("path")
    return reduce(DataFrame.unionByName, found)


def named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """raw_input, content of the paths that exist, by the names they were given."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "raw_input string, content binary")
    given = spark.createDataFrame([(p, _bare(_qualified(spark, p))) for p in found], "raw_input string, _path string")
    rows = spark.read.format("binaryFile").load(sorted({_qualified(spark, p) for p in found})).withColumn("_path", F.regexp_replace("path", SCHEME, "/"))
    return rows.join(F.broadcast(given), "_path").select("raw_input", "content")


INFO = ("title", "author", "created")


def split_pages(
    files: DataFrame, splitter: Callable[[bytes], list[str]], info: Callable[[bytes], dict[str, str]] | None = None, key: str = "raw_input"
) -> DataFrame:
    """key, content → key, page_no, body, then for page -1, which each file has: n_pages, title, author, created, cause.

    ``splitter`` knows the format and is called once a file, and so is ``info``, which reads what a file says of itself. A file
    that the splitter fails on has no pages and the exception's text as its cause, and the others go on. One that
    only ``info`` fails on has its pages, blank information and the cause."""
    kinds = pa.schema([(key, pa.string()), ("page_no", pa.int32()), ("body", pa.string()), ("n_pages", pa.int32()), *[(c, pa.string()) for c in INFO], ("cause", pa.string())])
    step = 1000

    def rows(name, content):
        pages, found, cause = None, {}, None
        try:
            pages = list(splitter(content))
            found = info(content) if info else {}
        except Exception as e:  # noqa: BLE001  one unreadable file doesn't sink the batch
            cause = f"{type(e).__name__}: {e}"
        n = None if pages is None else len(pages)
        yield [[name], [-1], [None], [n], *[[found.get(c)] for c in INFO], [cause]]
        for lo in range(0, n or 0, step):
            part = pages[lo : lo + step]
            none = [None] * len(part)
            yield [[name] * len(part), list(range(lo, lo + len(part))), part, *[none] * 5]

    def run(batches):
        for b in batches:
            for name, content in zip(b[key].to_pylist(), b["content"].to_pylist(), strict=True):
                for cols in rows(name, content or b""):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, kinds, strict=True)], schema=kinds)

    return files.select(key, "content").mapInArrow(run, f"{key} string, page_no int, body string, n_pages int, title string, author string, created string, cause string")


def form_feeds(content: bytes) -> list[str]:
    """A splitter for plain text: pages end at form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def prefix(spark_df: DataFrame, text: str, n: int = 6000) -> DataFrame:
    return spark_df.withColumn("head", F.substring(F.col(text), 1, n))


def numbered_folders(df: DataFrame, name: str, start: str = "chunk_") -> DataFrame:
    """Folders named ``chunk_N`` with their number; others go."""
    no = F.try_to_number(F.split_part(F.col(name), F.lit("_"), F.lit(2)), F.lit("999999999")).cast("int")
    return df.where(F.startswith(F.col(name), F.lit(start))).withColumn("chunk_no", no)


def key_values(text: str):
    return F.str_to_map(F.col(text), F.lit("\n"), F.lit("="))


def zip_members(archives: DataFrame) -> DataFrame:
    """path, content → path, member, data. A file that is no archive gives no rows."""

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for m in z.namelist():
                    yield pa.RecordBatch.from_pylist(
                        [{"path": path, "member": m, "data": z.read(m)}],
                        pa.schema([("path", pa.string()), ("member", pa.string()), ("data", pa.binary())]),
                    )

    return archives.select("path", "content").mapInArrow(run, "path string, member string, data binary")
