"""Documents to packed sequences, in five stages; each is stored before the next reads it.

Columns beyond those of ``documents`` pass through the filters unchanged, whatever their names.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import decontam, langid, neardup, packing, suffixes
from quirefold.llm.common import held_out, set_apart, stored

#: Least score of a text that counts as written in one of the learned languages.
MIN_LANGUAGE_SCORE = 0.25
END_ID = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und``, and near enough to its profile.

    Null texts and texts without a letter are ``und`` and go, whatever their length; rows that stand
    twice are judged alike; where nothing can be learned, all go. An empty table stays empty.
    """
    docs, named = set_apart(docs)
    profiles = langid.train(docs.where(~held_out(4)).select("text", "lang"))
    judged = langid.predict(docs, profiles)
    return named(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of least id.

    Texts without words are one class. Of rows with one id and text one stays, that of least other
    columns; rows without id stay only where their class has no id. An empty table stays empty.
    """
    docs, named = set_apart(docs)
    return named(neardup.keep_one(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that stand earlier; n_chars follows the text.

    A character that a cut splits goes whole. A document that is nothing but repeats stays,
    with an empty text; null texts stay null. Of equal passages the first by id stays, a null id before
    all others, and of rows with one id the first in the table. An empty table stays empty.
    """
    docs, named = set_apart(docs)
    cut = suffixes.dedup(docs, tuple(c for c in docs.columns if c != "text"), with_text=True)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return named(cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated.

    Null and empty texts have no words and stay; rows that stand twice are judged alike. Without
    benchmark items all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, named = set_apart(docs)
    return named(decontam.annotate(docs, items).where(~F.col("contaminated")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences.

    Null and empty texts are one piece, their end id; a long text fills sequences of its own; rows that
    stand twice are packed twice. An empty table gives no pieces. Columns but id and text end here.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("sequences", sequences),
]

#: Tokenizing, sampling and profiles are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
