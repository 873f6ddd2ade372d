"""Inputs by what they hold: path, name and content are three columns.

The digest of a file's bytes is its identity. An index keeps the digests by path, length and time of change, so a file
that hasn't changed since isn't read again to know it.
"""

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.sources import SCHEME, _bare, _qualified, batch_list, existing
from quirefold.sources.store import exists

INDEX = "path string, length long, modified timestamp, digest string, scanned_at double"
#: A file changed so shortly before a scan may change again without another time or length: it is read again.
RACY_SECONDS = 2


def digest(content: Column | str) -> Column:
    return F.sha2(content, 256)


def known(spark: SparkSession, index: str) -> DataFrame:
    """path, length, modified, digest as last scanned."""
    if not exists(spark, index):
        return spark.createDataFrame([], INDEX)
    rows = spark.read.schema(INDEX).parquet(index)
    top = rows.groupBy("path").agg(F.max_by(F.struct("length", "modified", "digest", "scanned_at"), "scanned_at").alias("r"))
    return top.select("path", "r.*")


def _binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files as rows, their paths without scheme. One that goes or can't be read meanwhile has no row."""
    rows = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(paths)
    return rows.withColumn("path", F.regexp_replace("path", SCHEME, "/"))


def identify(spark: SparkSession, inputs: list[str], index: str) -> DataFrame:
    """input_ord, raw_input, input_key, path, digest, cause: one row an input. An input that is no file or can't be read has a
    null digest and the cause. The index gets a row for each file that was read."""
    batch = batch_list(spark, inputs)
    there = existing(spark, inputs)
    if not there:
        lost = F.lit("FileNotFoundError: no such file: ")
        return batch.select("*", *[F.lit(None).cast("string").alias(c) for c in ("path", "digest")], F.concat(lost, "raw_input").alias("cause"))
    full = {p: _qualified(spark, p) for p in there}
    given = spark.createDataFrame([(p, _bare(q)) for p, q in full.items()], "raw_input string, path string")
    listed = _binary(spark, sorted(set(full.values()))).select("path", "length", F.col("modificationTime").alias("modified"))  # no bytes are read
    old = known(spark, index).withColumn("safe", F.unix_micros("modified") / 1e6 < F.col("scanned_at") - RACY_SECONDS)
    state = listed.join(old.where("safe").select("path", "length", "modified", "digest"), ["path", "length", "modified"], "left")
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))
    names = {_bare(q): q for q in full.values()}
    new = [names[r.path] for r in state.where(F.col("digest").isNull() & (F.col("length") <= most)).select("path").collect()]  # of the batch's own list
    if new:
        read = _binary(spark, new).select("path", "length", F.col("modificationTime").alias("modified"), digest("content").alias("digest"))
        read.withColumn("scanned_at", F.lit(time.time())).write.mode("append").parquet(index)
    fresh = known(spark, index).select("path", "length", "modified", "digest")
    found = given.join(listed, "path", "left").join(fresh, ["path", "length", "modified"], "left")
    cause = F.when(F.col("path").isNull(), F.concat(F.lit("FileNotFoundError: no such file: "), "raw_input")).when(
        F.col("length") > most, F.format_string("ValueError: longer than %d bytes", F.lit(most))
    ).when(F.col("digest").isNull(), "OSError: it could not be read")
    return batch.join(found.select("raw_input", "path", "digest", "length"), "raw_input", "left").withColumn("cause", cause).drop("length")


def readers(inputs: DataFrame) -> DataFrame:
    """digest, path, input_ord: of inputs of equal content the first is read."""
    return inputs.where("digest is not null").groupBy("digest").agg(F.min_by("path", "input_ord").alias("path"), F.min("input_ord").alias("input_ord"))


def contents(spark: SparkSession, found: DataFrame) -> DataFrame:
    """key, content of ``readers``; a file that has changed since gives no row, as its digest is another."""
    paths = [r.path for r in found.select("path").distinct().collect()]  # of the batch's own list
    if not paths:
        return spark.createDataFrame([], "key string, content binary")
    rows = _binary(spark, [_qualified(spark, p) for p in paths]).select("path", "content")
    return rows.join(F.broadcast(found.select("path", F.col("digest").alias("key"))), "path").where(digest("content") == F.col("key")).select("key", "content")


def located(spark: SparkSession, found: DataFrame) -> DataFrame:
    """key, path (with its scheme), length of ``readers``; no bytes are read."""
    names = {r.path: _qualified(spark, r.path) for r in found.select("path").distinct().collect()}  # of the batch's own list
    if not names:
        return spark.createDataFrame([], "key string, path string, length long")
    full = spark.createDataFrame(list(names.items()), "path string, _full string")
    rows = _binary(spark, sorted(names.values())).select("path", "length").join(full, "path")
    return rows.join(found.select("path", F.col("digest").alias("key")), "path").select("key", F.col("_full").alias("path"), "length")


def own_folders(books: DataFrame, folder: str, key: str, order: str) -> DataFrame:
    """books (folder, key, order, …): where several contents want one folder the first keeps it; the names of the others end in
    the first eight digits of their key. Rows of one folder and content become one, the last input's."""
    one = books.groupBy(folder, key).agg(F.min(order).alias("_first"), F.max_by(F.struct(*[c for c in books.columns if c not in (folder, key)]), order).alias("_r"))
    place = F.row_number().over(Window.partitionBy(folder).orderBy("_first"))
    named = F.when(place > 1, F.concat(folder, F.lit("_"), F.substring(key, 1, 8))).otherwise(F.col(folder))
    return one.withColumn("_named", named).select(F.col("_named").alias(folder), key, "_r.*")
