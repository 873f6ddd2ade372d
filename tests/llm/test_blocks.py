"""Corpus counts by slices and by groups of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import blocks
from quirefold.llm.common import BLANK_WORDS, Words, binaries, distinct_counts


def keys():
    def keys_of(table):
        h, n = distinct_counts(Words(binaries(table["raw"]), BLANK_WORDS).hash)
        return h, np.where(h % np.uint64(7) == 0, 0, n)  # some keys add nothing

    return keys_of


def corpus(spark, n):
    words = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), (F.col("id") * (k + 1) % (k * 5 + 3)).cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).cast("binary").alias("raw"))
    return blocks.in_blocks(docs.repartition(4), 700)


def answers(counts):
    """block → its totals in the order of its keys."""
    out = {}
    for b, rows in counts.where("block >= 0").toPandas().groupby("block"):
        parts = [blocks.unpack_counts(t) for t in rows.sort_values("slice")["totals"]]
        out[b] = np.concatenate(parts).tolist()
    return out


@pytest.mark.parametrize("held", [1, 8])
def test_grouped_counts_equal_plain_ones(spark, monkeypatch, held):
    made = corpus(spark, 1200)
    plain = blocks.corpus_counts(made, keys(), 64)
    monkeypatch.setattr(blocks, "DEEP_SLICES", 1)
    monkeypatch.setattr(blocks, "HELD_BLOCKS", held)
    grouped = blocks.corpus_counts(made, keys(), 64)
    assert answers(plain) == answers(grouped)
    assert len(answers(plain)) == made.count() > 200
    assert blocks.stats(plain) == blocks.stats(grouped)
    none = made.where("false")
    assert blocks.corpus_counts(none, keys(), 16).count() == 0


def test_rows_of_groups_grow_slowly(spark, monkeypatch):
    """Rows that pass between tasks for 16 times the blocks, with as many slices as blocks: by slices alone they grow with the
    square (as far as there are keys), by groups with the power of one and a half at most."""
    monkeypatch.setattr(blocks, "HELD_BLOCKS", 1)
    sent = {}
    for n in (100, 1600):
        made = corpus(spark, n)
        k = made.count()
        bits = max(1, (k - 1).bit_length())
        coarse = (k // (1 << ((k - 1).bit_length() // 2))).bit_length()
        sent[n] = [k, blocks.sent_keys(made, keys(), bits).count(), blocks.sent_keys(made, keys(), coarse).count()]
    grown = [b / a for a, b in zip(sent[100], sent[1600], strict=True)]
    assert 12 < grown[0] < 20
    assert grown[2] < 1.3 * grown[0] ** 1.5
    assert sent[1600][2] < sent[1600][1]
