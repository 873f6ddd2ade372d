"""Page ranges: planning, pinning to a recorded size, pending work."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.names import chunk_tag

CHUNK_SIZE = 150


def plan_chunks(books: DataFrame, pages: str, size: int | str = CHUNK_SIZE) -> DataFrame:
    """One row per half-open page range. A book without pages has none.

    ``size`` is a number or a column name. A size below 1 is an error.
    """
    if isinstance(size, int):
        if size < 1:
            raise ValueError(f"chunk size must be positive, not {size}")
        k = F.lit(size)
    else:
        k = F.when(F.col(size) >= 1, F.col(size)).otherwise(
            F.raise_error(F.lit("chunk size must be positive"))
        )
    n = F.col(pages).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, k.cast("int")))
    return (
        books.withColumn("start_page", F.explode(starts))
        .withColumn("end_page", F.least(F.col("start_page") + k.cast("int"), n))
        .withColumn("chunk_tag", chunk_tag("start_page", "end_page"))
    )


def pin_chunk_size(books: DataFrame, recorded: DataFrame, key: str, requested: int) -> DataFrame:
    """The recorded size wins, so that a resumed book keeps its page ranges."""
    return (
        books.join(recorded, key, "left")
        .withColumn("pinned", F.col("chunk_size").isNotNull() & (F.col("chunk_size") != requested))
        .withColumn("chunk_size", F.coalesce("chunk_size", F.lit(requested)).cast("int"))
    )


def pending(planned: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Planned rows without a finished one. The anti join runs before any conversion."""
    return planned.join(done.select(*on).distinct(), on, "left_anti")
