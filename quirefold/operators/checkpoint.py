"""The manifest: one row per finished chunk, with its images. A row's presence is the marker."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.store import children, exists, remove

MANIFEST = (
    "key string, start_page int, chunk_tag string, text string, meta string, images map<string,binary>, done_at double, "
    "end_page int, hit_exception boolean, cause string, run string"
)
#: The tag of a row that says that a key's rows so far are done with.
FORGOTTEN = "forgotten"


def tolerant_meta(meta):
    """Metadata JSON; what is no object or can't be read becomes ``{}``."""
    return F.when(F.json_object_keys(meta).isNotNull(), meta).otherwise("{}")


def recorded_size(config):
    """chunk_size of a run-config JSON; anything unreadable: null."""
    return F.try_to_number(F.get_json_object(config, "$.chunk_size"), F.lit("999999999")).cast("int")


def raw_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were appended. A folder not yet written is empty. Tags give the last page of rows of older manifests."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(path)
    return rows.withColumn("end_page", F.coalesce("end_page", F.expr("try_cast(split_part(chunk_tag, '_', 2) AS int)")))


def live_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Finished chunks of keys that weren't forgotten since; a chunk that was finished twice stands twice."""
    rows = raw_manifest(spark, path)
    gone = rows.where(F.col("chunk_tag") == FORGOTTEN).groupBy("key").agg(F.max("done_at").alias("_gone"))
    kept = rows.where("text is not null").join(gone, "key", "left").where(F.col("_gone").isNull() | (F.col("done_at") > F.col("_gone")))
    return kept.drop("_gone")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The finished chunks, last commit of each."""
    rows = live_chunks(spark, path)
    return rows.groupBy("key", "start_page", "chunk_tag").agg(
        F.max_by(F.struct("text", "meta", "images"), "done_at").alias("r"), F.max("done_at").alias("done_at")
    ).select("key", "start_page", "chunk_tag", "r.text", "r.meta", "r.images", "done_at")


def commit(chunks: DataFrame, path: str, run: str | None = None) -> None:
    """Appends chunks; a chunk and its images appear at once. What a task has finished stays, even if the job
    doesn't end: its files move to their place with the task. Columns that chunks don't have are null."""
    rows = chunks.withColumn("done_at", F.lit(time.time())).withColumn("run", F.lit(run).cast("string"))
    kinds = {f.name: f.dataType for f in chunks.sparkSession.createDataFrame([], MANIFEST).schema}
    all_ = [F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    rows.select(*all_).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def failed_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as rows of the attempts log: a chunk without text failed."""
    rows = raw_manifest(spark, path).where(F.col("chunk_tag") != FORGOTTEN)
    return rows.select(
        "key", F.lit("convert").alias("stage"), "start_page", "end_page", F.col("text").isNotNull().alias("ok"), "cause", "run", F.col("done_at").alias("at")
    )


def forget(spark: SparkSession, keys: DataFrame, path: str) -> None:
    """Ends the life of the keys' chunks, after the sink has them; where no key has a chunk left, all files go."""
    commit(keys.select("key", F.lit(-1).alias("start_page"), F.lit(FORGOTTEN).alias("chunk_tag")).distinct(), path)
    if live_chunks(spark, path).isEmpty():
        for name in children(spark, path):
            if not name.startswith("_") or name == "_SUCCESS":
                remove(spark, f"{path.rstrip('/')}/{name}")


def image_rows(chunks: DataFrame, key: str = "key") -> DataFrame:
    """key, start_page, name, image: one row an image. A chunk without images has none."""
    return chunks.select(key, "start_page", F.explode("images").alias("name", "image"))


def purge(spark: SparkSession, path: str) -> None:
    """After the sink has succeeded."""
    remove(spark, path)
