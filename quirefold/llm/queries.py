"""The registered queries of the operators and of the pipeline."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import decontam, divergence, langid, lm, neardup, neighbours, packing, quality, resampling, sharding, suffixes, tokenfiles, toxicity
from quirefold.llm.common import held_out, scratch
from quirefold.llm.oracles import ORACLES as ORACLES

N_SHARDS = 24


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_sharding(spark, d):
    out = sharding.shard(_table(spark, d, "documents").select("doc_id", "text"), N_SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark, d):
    path = scratch(spark, "token-file")
    tokenfiles.write(_table(spark, d, "documents"), path, _tokenizer(), end_id=2)
    return tokenfiles.read(spark, path, with_ids=False)


def op3_langid(spark, d):
    docs = _table(spark, d, "documents")
    profiles = langid.train(docs.where(~held_out(4)).select("text", "lang"))
    rows = docs.select("doc_id", held_out(4).alias("held_out"), "text")
    return langid.predict(rows, profiles).drop("text")


def op4_decontam(spark, d):
    return decontam.annotate(_table(spark, d, "documents").select("doc_id", "text"), _table(spark, d, "benchmark")).drop("text")


def op5_quality(spark, d):
    out = quality.judge(_table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_neardup(spark, d):
    return neardup.classes(_table(spark, d, "documents"))


def op7_toxicity(spark, d):
    docs, labels = _table(spark, d, "documents").select("doc_id", "text"), _table(spark, d, "labels")
    learn = ~held_out(4)
    model = toxicity.train(docs.where(learn), labels.where(learn).select("doc_id", "toxic"))
    return toxicity.score(docs.withColumn("held_out", held_out(4)), model).drop("text")


def op8_lm(spark, d):
    return lm.score(_table(spark, d, "documents").select("doc_id", held_out(7).alias("held_out"), "text"))


def op9_suffix_dedup(spark, d):
    return suffixes.dedup(_table(spark, d, "documents").select("doc_id", "text"))


def op10_packing(spark, d):
    return packing.pack(_table(spark, d, "documents"), _tokenizer(), end_id=1)


def op11_resampling(spark, d):
    return resampling.resample(_table(spark, d, "documents"), _table(spark, d, "benchmark")).drop("n_words")


def op12_neighbours(spark, d):
    return neighbours.search(_table(spark, d, "embeddings"))


def op13_divergence(spark, d):
    return divergence.audit(_table(spark, d, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_files": op2_token_files,
    "op3_langid": op3_langid,
    "op4_decontam": op4_decontam,
    "op5_quality": op5_quality,
    "op6_neardup": op6_neardup,
    "op7_toxicity": op7_toxicity,
    "op8_lm": op8_lm,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_resampling": op11_resampling,
    "op12_neighbours": op12_neighbours,
    "op13_divergence": op13_divergence,
    "pipeline": corpus_pipeline.run,
}
