"""An extension: new documents converted as they arrive, resumed from the checkpoint."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.functions.names import chunk_tag
from quirefold.operators.checkpoint import commit, read_manifest
from quirefold.operators.chunking import pending
from quirefold.operators.convert import Converter, convert_chunks
from quirefold.sources import text_pages


def convert_stream(
    spark: SparkSession, source: str, schema: str, manifest: str, state: str, converter: Converter, size: int
) -> StreamingQuery:
    """Files with (key, text) → manifest rows. A batch that runs again skips what it had
    committed, so each chunk appears once."""

    def batch(docs: DataFrame, _: int) -> None:
        pages = text_pages(docs, "key").withColumn("start_page", (F.col("page_no") - F.col("page_no") % size).cast("int"))
        todo = pending(pages, read_manifest(spark, manifest), ["key", "start_page"])
        ends = todo.groupBy("key", "start_page").agg((F.max("page_no") + 1).alias("end_page"))
        done = convert_chunks(todo, converter, size).join(ends, ["key", "start_page"])
        commit(done.withColumn("chunk_tag", chunk_tag("start_page", "end_page")), manifest)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
