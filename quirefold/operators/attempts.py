"""What was tried, what came of it and why: an append-only log, and what still has tries left.

A failure is a row, not an exception: the splitter's, the converter's and the reply's text end here. ``key`` is the content
that was worked on, ``stage`` what was done to it, ``start_page`` and ``end_page`` which part of it (-1: the whole).
"""

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources.store import exists

SCHEMA = "key string, stage string, start_page int, end_page int, ok boolean, cause string, run string, at double"
UNIT = ["key", "stage", "start_page", "end_page"]
TRIES = 3


def reason(e: BaseException) -> str:
    """The kind of an exception and its text, which may be empty."""
    return f"{type(e).__name__}: {e}" if str(e) else type(e).__name__


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def append(rows: DataFrame, stage: str, run: str, path: str) -> None:
    """rows (key, ok, cause and, for parts, start_page, end_page); an attempt without a row never was."""
    whole = [F.col(c) if c in rows.columns else F.lit(-1).alias(c) for c in ("start_page", "end_page")]
    out = rows.select("key", F.lit(stage).alias("stage"), *whole, "ok", "cause", F.lit(run).alias("run"), F.lit(time.time()).alias("at"))
    out.write.mode("append").parquet(path)


def failures(log: DataFrame) -> DataFrame:
    """Per unit: how often it failed since it last succeeded, and the last cause. One aggregation over the narrow log."""
    last = F.max(F.when(F.col("ok"), F.col("at")))
    bad = F.when(~F.col("ok"), F.struct("at", "cause"))
    grouped = log.groupBy(*UNIT).agg(last.alias("_good"), F.collect_list(bad).alias("_bad"))
    since = F.filter("_bad", lambda b: F.col("_good").isNull() | (b["at"] > F.col("_good")))
    return grouped.select(*UNIT, F.size(since).alias("n_failed"), F.array_max(since)["cause"].alias("cause"))


def exhausted(log: DataFrame, tries: int = TRIES) -> DataFrame:
    return failures(log).where(F.col("n_failed") >= tries)


def with_tries_left(planned: DataFrame, log: DataFrame, stage: str, tries: int = TRIES) -> DataFrame:
    """planned (key and, for parts, start_page, end_page) without what has failed ``tries`` times: an anti join."""
    on = [c for c in ("key", "start_page", "end_page") if c in planned.columns]
    return planned.join(exhausted(log.where(F.col("stage") == stage), tries).select(*on), on, "left_anti")


def last_cause(log: DataFrame) -> DataFrame:
    """key, cause: of the units of a key that fail, the latest failure's stage, place and cause."""
    place = F.when(F.col("start_page") >= 0, F.format_string(" of pages %d-%d", F.col("start_page") + 1, F.col("end_page"))).otherwise("")
    text: Column = F.concat("stage", place, F.lit(" failed "), F.col("n_failed").cast("string"), F.lit(" times: "), F.coalesce("cause", F.lit("unknown")))
    bad = failures(log).where("n_failed > 0")
    return bad.groupBy("key").agg(F.max_by(text, F.struct("n_failed", "stage", "start_page")).alias("cause"))
