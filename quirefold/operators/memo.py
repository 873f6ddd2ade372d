"""Replies that were asked for once: an append-only table by the digest of the prompt, read before anything is asked."""

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.attempts import reason
from quirefold.sources.store import exists

SCHEMA = "prompt_digest string, reply string, cause string, at double"
PROMPT_CHARS = 6000


def prompt_of(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, PROMPT_CHARS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """prompt_digest, reply, reply_cause: the last answer that came, and if none did the last failure's cause."""
    rows = spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)
    came = F.col("cause").isNull()
    return rows.groupBy("prompt_digest").agg(
        F.max_by("reply", F.when(came, F.col("at"))).alias("reply"), F.bool_or(came).alias("answered"), F.max_by("cause", F.when(~came, F.col("at"))).alias("last")
    ).select("prompt_digest", "reply", "answered", F.when(~F.col("answered"), F.col("last")).alias("reply_cause"))


def ask_all(prompts: DataFrame, ask: Callable[[str], str], askers: int, per_second: float | None, tries: int, pause: float) -> DataFrame:
    """prompts (prompt_digest, prompt) → prompt_digest, reply, cause. ``askers`` tasks at most ask at a time, each
    ``per_second`` times a second at most; what fails is asked again after a pause that doubles, ``tries`` times in all."""
    kinds = pa.schema([("prompt_digest", pa.string()), ("reply", pa.string()), ("cause", pa.string())])

    def run(batches):
        free_at = 0.0
        for b in batches:
            for digest, prompt in zip(b["prompt_digest"].to_pylist(), b["prompt"].to_pylist(), strict=True):
                reply = cause = None
                for k in range(tries):
                    time.sleep(max(0.0, free_at - time.monotonic(), pause * 2**k / 2 if k else 0.0))
                    free_at = time.monotonic() + (1 / per_second if per_second else 0.0)
                    try:
                        reply, cause = ask(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  it becomes the row's cause
                        cause = reason(e)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (digest, reply, cause)], schema=kinds)

    return prompts.select("prompt_digest", "prompt").repartition(askers, "prompt_digest").mapInArrow(run, "prompt_digest string, reply string, cause string")


def with_replies(
    df: DataFrame, need: Column, text: str, ask: Callable[[str], str], path: str,
    askers: int = 8, per_second: float | None = None, tries: int = 3, pause: float = 1.0,
) -> DataFrame:
    """df with ``reply`` and ``reply_cause``. Of the rows that need one, each distinct prompt that the memo doesn't have is asked
    for once; answers are kept, and prompts that failed are asked for again by the next run. Rows that
    need none, and those whose prompt failed, have a null reply, so the text rules take over."""
    spark = df.sparkSession
    prompt = prompt_of(F.col(text))
    rows = df.withColumn("_prompt", F.when(need, prompt)).withColumn("prompt_digest", F.sha2(F.col("_prompt").cast("binary"), 256))
    wanted = rows.where("_prompt is not null").select("prompt_digest", F.col("_prompt").alias("prompt")).dropDuplicates(["prompt_digest"])
    new = wanted.join(read(spark, path).where("answered").select("prompt_digest"), "prompt_digest", "left_anti")
    answers = ask_all(new, ask, askers, per_second, tries, pause).withColumn("at", F.lit(time.time()))
    answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)  # answers of ended tasks stay
    return rows.join(read(spark, path).drop("answered"), "prompt_digest", "left").drop("_prompt", "prompt_digest")
