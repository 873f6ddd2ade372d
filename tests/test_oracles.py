"""Every query with SQL equals DuckDB on the same tables."""

import glob
import os
import random

import duckdb
import pytest

from quirefold.functions import names
from quirefold.plans.oracles import ORACLES
from quirefold.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_oracle(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert [a[c].dtype for c in cols] == [b[c].dtype for c in cols]
    rows = [sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).values.tolist())) for x in (a, b)]
    assert rows[0] == rows[1]


def test_case_is_letter_by_letter(spark):
    """Every character between two letters, in capitals and in small letters, as in DuckDB."""
    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = spark.createDataFrame([("".join("α" + c for c in chars[i : i + 5000]) + "Σ",) for i in range(0, len(chars), 5000)], "x string")
    got = texts.select("x", names.upper("x").alias("u"), names.lower("x").alias("l")).toPandas()  # noqa: F841
    assert duckdb.sql("SELECT count(*) FROM got WHERE u <> upper(x) OR l <> lower(x)").fetchall() == [(0,)]


def test_title_lookup_of_other_letters(spark, tmp_path):
    """Letters of several bytes, and those whose capitals are two: the distance counts bytes, ß stays one letter."""
    rng = random.Random(6)
    words = ["Straße", "STRAẞE", "ﬁne", "ΟΔΟΣ", "ᾳδης", "İzmir", "ıŉ", "né", "né", "日本", "𝄞😀", "ßß", "ü", "a", " ", "\u2003", "É"]
    titles = [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(2400)] + [""] * 40
    rows = [(i, f"<h1>{t}</h1>" if t else None) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "wanted", "title", "distance", "rank"]
    want = con.sql(ORACLES["title_lookup"]).select(*columns).fetchall()
    got = [tuple(r) for r in QUERIES["title_lookup"](spark, str(tmp_path)).select(*columns).collect()]
    assert len(want) > 50
    assert sorted(got) == sorted(want)
