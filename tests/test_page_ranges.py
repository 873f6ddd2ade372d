"""Page ranges of text files: the index, ranges as a table, and the data source with pushed filters."""

import pytest
from pyspark.sql import functions as F

from quirefold.sources import form_feeds, page_ranges


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("books")
    texts = {"big": "\f".join(f"page {i} é" * (i % 7) for i in range(10_000)), "one": "alone", "empty": "", "ends": "a\f\fb\f"}
    for k, t in texts.items():
        (top / f"{k}.txt").write_bytes(t.encode())
    rows = [(k, str(top / f"{k}.txt"), len(t.encode())) for k, t in texts.items()]
    at = str(top / "index")
    page_ranges.index(spark.createDataFrame(rows, "key string, path string, length long"), 50_000).write.parquet(at)
    return {k: form_feeds(t.encode()) for k, t in texts.items()}, at, spark.read.schema(page_ranges.INDEX).parquet(at)


def test_counts(books):
    pages, _, index = books
    assert {r.key: r.n_pages for r in page_ranges.page_counts(index).collect()} == {k: len(p) for k, p in pages.items()}
    assert index.where("key = 'big'").count() > 5


def test_ranges_read_only_their_bytes(spark, books):
    pages, _, index = books
    wanted = [("big", 0, 3), ("big", 4000, 4150), ("big", 9990, 10_000), ("one", 0, 1), ("empty", 0, 1), ("ends", 1, 4), ("ends", 0, 1)]
    got = page_ranges.read(index, spark.createDataFrame(wanted, "key string, start_page int, end_page int")).collect()
    assert sorted((r.key, r.page_no, r.body) for r in got) == sorted((k, i, pages[k][i]) for k, a, z in wanted for i in range(a, z))
    due = sum(len("\f".join(pages[k][a:z]).encode()) for k, a, z in wanted)
    assert sum(r.n_bytes for r in got) == due  # and not the 10,000 pages
    assert due < 0.03 * sum(len(p.encode()) for p in pages["big"])


def test_data_source_takes_filters(spark, books):
    pages, at, _ = books
    source = page_ranges.load(spark, at, 40)
    some = source.where((F.col("key") == "big") & (F.col("page_no") >= 7001) & (F.col("page_no") < 7100))
    assert sorted((r.page_no, r.body) for r in some.collect()) == [(i, pages["big"][i]) for i in range(7001, 7100)]
    assert some.rdd.getNumPartitions() == 3  # of the 250 that the file has
    assert sorted((r.key, r.body) for r in source.where(F.col("key").isin("one", "ends") & (F.col("page_no") <= 1)).collect()) == [("ends", ""), ("ends", "a"), ("one", "alone")]
    last = source.where("key = 'big' and page_no > 9998").collect()
    assert [(r.page_no, r.body) for r in last] == [(9999, pages["big"][9999])]
    assert source.where("key = 'ends' and page_no = 2").first().body == "b"
    assert source.count() == sum(map(len, pages.values()))
