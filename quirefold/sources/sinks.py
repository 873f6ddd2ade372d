"""Overwrite-by-key sinks, image files and batch reports."""

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one output name, the latest input. Map-side combined."""
    rest = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return top.select(key, "r.*")


def write_by_folder(rows: DataFrame, path: str, folder: str) -> None:
    """Replaces the folders that occur in rows and leaves all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)


def write_images(rows: DataFrame, root: str) -> DataFrame:
    """rows (folder, name, image) as files ``root/folder/images/name``, in any store that pyarrow
    knows → the paths written. A folder without images isn't made; a task that runs again
    writes the same bytes, and a later image of one name wins. Lazy, as any DataFrame."""
    kinds = pa.schema([("path", pa.string())])

    def run(batches):
        fs, base = FileSystem.from_uri(root)
        for b in batches:
            paths = []
            for folder, name, image in zip(*(b[c].to_pylist() for c in ("folder", "name", "image")), strict=True):
                place = f"{base.rstrip('/')}/{folder}/images/{name}"
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(image or b"")
                paths.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], schema=kinds)

    return rows.select("folder", "name", "image").mapInArrow(run, "path string")


def write_marker(spark: SparkSession, path: str, version: str, **more: str) -> None:
    """``key=value`` lines, one row, to be written when all else is: its presence says that the set-up ended."""
    lines = [f"setup_version={version}", *(f"{k}={v}" for k, v in more.items())]
    spark.createDataFrame([("\n".join(lines),)], "marker string").coalesce(1).write.mode("overwrite").parquet(path)


def read_marker(spark: SparkSession, path: str) -> str | None:
    """The marker's text; None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("marker string").parquet(path).first().marker


def metadata_json(**fields):
    """Non-ASCII characters stay as they are."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def batch_results(batch: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """OK or FAILED per input; an input without result failed. ``position`` is k/N; N is one row,
    counted on the map side and sent to all."""
    ok = results.select(key).distinct().withColumn("_ok", F.lit(True))
    n = batch.agg(F.count("*").alias("_n"))
    return (
        batch.join(ok, key, "left")
        .join(F.broadcast(n))
        .withColumn("status", F.when(F.col("_ok"), "OK").otherwise("FAILED"))
        .withColumn("detail", F.when(F.col("_ok"), "").otherwise(F.concat(F.lit("no result for "), F.col(key).cast("string"))))
        .withColumn("position", F.concat(F.col("input_ord").cast("string"), F.lit("/"), F.col("_n").cast("string")))
        .drop("_ok", "_n")
    )


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_inputs"),
        F.count_if(F.col("status") == "OK").alias("n_ok"),
        F.count_if(F.col("status") == "FAILED").alias("n_failed"),
        F.coalesce(F.bool_or(F.col("status") == "FAILED"), F.lit(False)).alias("any_failed"),
    )


def ordinal(rows: DataFrame, order: str, by: str) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long"))
