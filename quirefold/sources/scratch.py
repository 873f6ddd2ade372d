"""Scratch tables in the shared checkpoint folder: lineage ends there and lost executors lose nothing."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder. Where none is set, a local session gets one
    of its own; on a cluster, whose executors share no local folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quirefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quirefold/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` made, once all that was derived from them is stored too."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
