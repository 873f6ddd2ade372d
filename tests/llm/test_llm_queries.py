"""Queries of the subpackage on the smallest tables: SQL where there is some, and the pipeline."""

import glob
import os
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.llm import neardup
from quirefold.llm.common import stored
from quirefold.llm.oracles import ORACLES
from quirefold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    if name == "op11_resampling":  # an integer with nulls
        a, b = (x.assign(rank=x["rank"].astype("Int64")) for x in (a, b))
    assert [a[c].dtype for c in cols] == [b[c].dtype for c in cols]
    keys = [k for k in ("doc_id", "query_id", "lang", "source", "part", "rank") if k in cols]
    a, b = (x[cols].sort_values(keys, ignore_index=True) for x in (a, b))
    sums = [c for c in cols if a[c].dtype == float]  # of many logarithms, in any order
    pd.testing.assert_frame_equal(a[sums], b[sums], rtol=1e-12, atol=0)
    rest = [c for c in cols if c not in sums]
    a, b = (x[rest].astype(object).where(x[rest].notna(), None) for x in (a, b))
    assert a.values.tolist() == b.values.tolist()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = QUERIES["op3_langid"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count()
    toxic = QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    assert toxic.where("toxic = predicted").count() >= 0.88 * toxic.count()  # some labels have no cause in the text


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "12 34 !", "en", "s", 7), (10_002, "", None, None, None)], docs.schema)
    docs = docs.unionByName(odd)
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), name)
        if k == 0:
            assert docs.where("doc_id >= 10000").count() == 0
            assert docs.count() >= 0.98 * before - 3
        if k < 4:
            assert docs.columns == columns
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert "sequence_id" in docs.columns


def test_extra_columns_pass_through(spark):
    extra = ["score", "lang_pred", "contaminated", "n_words", "n_removed", "n_bytes", "kept", "_raw", "_text", "__key", "node", "p", "r", "extra_9", "Kept_Sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").withColumns({c: F.concat(F.lit(c), "doc_id") for c in extra})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
    wrong = [F.col(c) != F.concat(F.lit(c), "doc_id") for c in extra]
    assert docs.count() > 0
    assert docs.where(F.greatest(*[w.cast("int") for w in wrong]) > 0).count() == 0


def test_registered_pipeline(spark):
    """Whole documents in pieces, full windows, and none that a stage has to reject."""
    rows = QUERIES["pipeline"](spark, SF).collect()
    documents, windows = defaultdict(list), Counter()
    for r in rows:
        documents[r.doc_id].append(r)
        windows[r.sequence_id] += r.length
        assert r.offset + r.length <= 2048
    for own in documents.values():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == own[0].doc_tokens
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(n < 2048 for n in windows.values()) <= 0.2 * len(windows) + 8
    spoken = QUERIES["op3_langid"](spark, SF).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.MIN_LANGUAGE_SCORE}")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spoken.select("doc_id"), "doc_id", "left_semi")
    assert set(documents) <= {r.doc_id for r in docs.collect()}
    kept = {r.class_id for r in neardup.classes(docs).collect()}
    assert set(documents) <= kept
    gone = kept - set(documents)  # contaminated ones alone
    bad = QUERIES["op4_decontam"](spark, SF).where("n_hit > 0")
    assert gone <= {r.doc_id for r in bad.collect()}


def test_odd_rows_pass_through(spark):
    """Null ids, repeated rows and a map column."""
    text = " ".join(f"the word{i} and that" for i in range(40))
    rows = [(None, text, "en", "s", len(text), {"a": 1}), (None, text, "en", "s", len(text), {"a": 0}), (3, text + " more", "en", "s", len(text) + 5, None)]
    rows += [(7, f"so it is with the {i} of them that goes on", "en", "s", 1, {"b": 2}) for i in range(3)] * 2 + [(None, None, None, None, None, None), (None, "", "en", "s", 0, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>")
    columns = docs.columns
    docs = stored(corpus_pipeline.language(spark, docs, SF), "language")
    assert docs.count() == 9
    docs = stored(corpus_pipeline.near_duplicates(spark, docs, SF), "near_duplicates")
    assert sorted(r.doc_id for r in docs.collect()) == [3, 7, 7, 7]  # a class with an id keeps that one
    docs = stored(corpus_pipeline.repeated_passages(spark, docs, SF), "repeated_passages")
    docs = stored(corpus_pipeline.benchmark_passages(spark, docs, SF), "benchmark_passages")
    assert docs.columns == columns
    assert sum(r.length for r in corpus_pipeline.sequences(spark, docs, SF).collect() if r.doc_id == 3) > 0


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.count() == 0
