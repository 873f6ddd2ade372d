"""Page sets as half-open ranges: what is covered, by which chunks, and what is left to plan.

Chunks of any earlier size count for the pages that they hold, so a new chunk size converts nothing twice.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.names import chunk_tag

RANGES = "array<struct<start_page:int,end_page:int>>"


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start_page"), end.cast("int").alias("end_page"))


def _walk(ranges: Column) -> Column:
    """Over ranges by start, the longest first: those that begin where no kept one has been yet, and the gaps between them."""
    none = F.array().cast(RANGES)
    start = F.struct(F.lit(0).alias("at"), none.alias("kept"), none.alias("gaps"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = x["start_page"], -x["minus_end"]
        gap = F.when(begin > acc["at"], F.array(_range(acc["at"], begin))).otherwise(none)
        taken = F.struct(end.alias("at"), F.concat(acc["kept"], F.array(_range(begin, end))).alias("kept"), F.concat(acc["gaps"], gap).alias("gaps"))
        return F.when((begin >= acc["at"]) & (end > begin), taken).otherwise(acc)

    return F.aggregate(F.array_sort(ranges), start, step)


def coverage(done: DataFrame, key: str) -> DataFrame:
    """done (key, start_page, end_page) → key, ``kept``: disjoint ranges ascending, ``gaps`` before and between them, and
    ``at``: the page after the last. A range that overlaps a kept one isn't kept. A key's ranges, two numbers each, meet in one row."""
    one = F.struct(F.col("start_page").cast("int").alias("start_page"), (-F.col("end_page")).cast("int").alias("minus_end"))
    return done.groupBy(key).agg(_walk(F.collect_set(one)).alias("w")).select(key, "w.kept", "w.gaps", "w.at")


def kept_ranges(done: DataFrame, key: str) -> DataFrame:
    """key, start_page, end_page of the chunks that make up the book."""
    return coverage(done, key).select(key, F.inline("kept"))


def remaining(books: DataFrame, done: DataFrame, key: str, pages: str, size: int) -> DataFrame:
    """books (key, pages) → key, start_page, end_page, chunk_tag: chunks of ``size`` pages at most over the pages
    that no kept range of ``done`` covers. Without done ranges these are the chunks of ``chunking.plan_chunks``."""
    if size < 1:
        raise ValueError(f"chunk size must be positive, not {size}")
    have = books.select(key, F.col(pages).cast("int").alias("_n")).join(coverage(done, key), key, "left")
    at = F.coalesce("at", F.lit(0))
    tail = F.when(at < F.col("_n"), F.array(_range(at, F.col("_n")))).otherwise(F.array().cast(RANGES))
    gaps = have.select(key, F.explode(F.concat(F.coalesce("gaps", F.array().cast(RANGES)), tail)).alias("g"))
    first, end = F.col("g.start_page"), F.col("g.end_page")
    parts = gaps.select(key, F.explode(F.sequence(first, end - 1, F.lit(size))).alias("start_page"), end.alias("_end"))
    whole = parts.withColumn("end_page", F.least(F.col("start_page") + size, F.col("_end")).cast("int")).drop("_end")
    return whole.withColumn("chunk_tag", chunk_tag("start_page", "end_page"))


def pages_of(planned: DataFrame, key: str) -> DataFrame:
    """key, page_no, start_page: a row a page of the planned chunks."""
    return planned.select(key, F.explode(F.sequence("start_page", F.col("end_page") - 1)).alias("page_no"), "start_page")
