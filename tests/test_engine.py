"""Rules and properties that SQL on the tables doesn't reach."""

import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quirefold.functions import bib, config, names
from quirefold.operators import alignment, assemble, checkpoint, chunking, convert, decisions, router
from quirefold.plans.batch import convert_batch
from quirefold.sources import batch_list, files, numbered_folders, publish, repositories, sinks, text_pages, zip_members

SF = "/root/testdata/sf0.001"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "k"), [(0, 4), (1, 4), (3, 4), (4, 4), (5, 4), (9, 100)])
def test_chunks_tile(spark, n, k):
    rows = chunking.plan_chunks(spark.createDataFrame([(n,)], "n int"), "n", k).orderBy("start_page").collect()
    assert [p for r in rows for p in range(r.start_page, r.end_page)] == list(range(n))


def test_bad_chunk_size(spark):
    df = spark.createDataFrame([(3, 0)], "n int, k int")
    with pytest.raises(ValueError, match="positive"):
        chunking.plan_chunks(df, "n", 0)
    with pytest.raises(Exception, match="positive"):
        chunking.plan_chunks(df, "n", "k").collect()


def test_tag_keeps_long_numbers(spark):
    assert one(spark, names.chunk_tag(F.lit(123456), F.lit(7))) == "123456_00007"


@pytest.mark.parametrize(("raw", "want"), [
    ("A (1) – x", "A_1_x"), ("-a-", "_a_"), ("a\t b", "a_b"), ("!!", ""), (None, ""), ("Größe é", "Größe_é"),
])
def test_sanitize(spark, raw, want):
    assert one(spark, names.sanitize(F.lit(raw).cast("string"))) == want
    assert one(spark, names.sanitize(names.sanitize(F.lit(raw).cast("string")))) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("Ann Lee", "Lee"), ("Lee, Ann", "Lee"), ("Ann Lee and Bo Ray", "Lee"), ("", "UnknownAuthor"), (" ", "UnknownAuthor"), ("Plato", "Plato"), (", Ann", "UnknownAuthor"), (" and Bo", "UnknownAuthor"),
])
def test_last_name(spark, raw, want):
    assert one(spark, names.last_name(F.lit(raw))) == want


def test_duration(spark):
    assert one(spark, names.duration_text(F.lit(125))) == "2m 5s"


def test_heading_crosses_blank_lines(spark):
    assert one(spark, bib.heading_title(F.lit("#\n\nText\n# B"))) == "Text"
    assert one(spark, bib.heading_title(F.lit("x" * 4000 + "\n# Late"))) == ""
    assert one(spark, bib.heading_title(F.lit("# **\n# Second"))) == ""


def test_doc_info(spark):
    d = one(spark, bib.doc_info(F.lit("\tT "), F.lit(None).cast("string"), F.lit("2001-02-03").cast("timestamp")))
    assert (d.title, d.author, d.year) == ("T", "", "2001")


def test_replies_only_where_needed(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom")], "id int, md string")
    ask = lambda s: 1 / 0 if s == "boom" else f'{{"title":"{s}"}}'
    out = bib.with_replies(df, F.col("id") != 1, "md", ask).orderBy("id").collect()
    assert [r.reply for r in out] == [None, '{"title":""}', None]
    got = bib.with_replies(df, F.col("id") != 1, "md", lambda texts: [f"{len(texts)}:{t}" for t in texts], many=True)
    assert {r.id: (r.reply or "")[2:] for r in got.collect()} == {1: "", 2: "", 3: "boom"}
    assert bib.with_replies(df, F.col("id") > 0, "md", lambda texts: [], many=True).where("reply is not null").count() == 0


def test_identity_gives_texts_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    no = F.lit(False)
    conv = convert.convert_native(text_pages(docs, "doc_id"), "doc_id", 5, no, no)
    back = conv.groupBy("doc_id").agg(assemble.ordered_concat(F.col("text"), F.col("start_page"), "\n").alias("md"))
    assert back.join(docs, "doc_id").where("md = text").count() == docs.count()


def chunks(spark, mode="fallback"):
    def shout(pages):
        if any(p == "slow" for p in pages):
            time.sleep(5)
        if any(p == "bad" for p in pages):
            raise RuntimeError("bad page")
        return "|".join(pages).upper(), '{"n":1}', {"i.png": b"1"}

    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "bad"), ("a", 3, "z"), ("b", 0, "slow"), ("b", 1, "w")]
    pages = spark.createDataFrame(rows, "key string, page_no int, body string")
    return convert.convert_chunks(pages, shout, 2, mode, 0.3, 0.3)


def test_three_tiers(spark):
    got = {(r.key, r.start_page): r for r in chunks(spark).collect()}
    assert got["a", 0].text == "X|Y"
    assert got["a", 0].images == {"pg_1_i.png": b"1"}
    assert got["a", 2].text == "\n\n<!-- PyPDF Fallback: Page 3 -->\n\nbad\n\nZ"
    assert got["a", 2].meta is None
    assert got["a", 2].hit_exception
    assert got["b", 0].text == "\n\n<!-- PyPDF Fallback: Page 1 -->\n\nslow\n\nW"


def test_modes(spark):
    assert [(r.key, r.start_page) for r in chunks(spark, "drop_chunk").collect()] == [("a", 0)]
    with pytest.raises(Exception, match="bad page|over"):
        chunks(spark, "fail_fast").collect()


def test_resume_equals_full_run(spark, tmp_path):
    path = str(tmp_path / "manifest")
    pages = text_pages(spark.createDataFrame([("a", "1\n2\n3\n4\n5")], "key string, text string"), "key")
    at = pages.withColumn("start_page", (F.col("page_no") / 2).cast("int") * 2)
    tag = lambda df: df.withColumn("chunk_tag", names.chunk_tag(F.col("start_page"), F.col("start_page") + 2))
    up = lambda p: ("|".join(p), None, {})
    assert checkpoint.read_manifest(spark, path).count() == 0
    checkpoint.commit(tag(convert.convert_chunks(at.where("start_page = 2"), up, 2)), path)
    todo = chunking.pending(at, checkpoint.read_manifest(spark, path), ["key", "start_page"])
    assert sorted(r.body for r in todo.collect()) == ["1", "2", "5"]
    checkpoint.commit(tag(convert.convert_chunks(todo, up, 2)), path)
    rows = checkpoint.read_manifest(spark, path).orderBy("start_page").collect()
    assert [r.text for r in rows] == ["1|2", "3|4", "5"]
    checkpoint.purge(spark, path)
    assert checkpoint.read_manifest(spark, path).count() == 0


def test_run_config(spark):
    get = lambda s: one(spark, checkpoint.recorded_size(F.lit(s).cast("string")))
    assert [get('{"chunk_size": 50}'), get("[1]"), get("oops"), get(None)] == [50, None, None, None]


def test_overwrite_leaves_other_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, "folder string, v int")
    sinks.write_by_folder(make([("a", 1), ("b", 1)]), path, "folder")
    sinks.write_by_folder(make([("b", 2)]), path, "folder")
    assert {(r.folder, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    top = sinks.last_wins(make([("a", 1), ("a", 3), ("a", 2)]), "folder", "v").first()
    assert top.v == 3


def test_batch_of_missing_and_repeated_inputs(spark):
    batch = batch_list(spark, ["x/a.pdf", "gone.pdf", "x/a.pdf"])
    done = spark.createDataFrame([("a",)], "input_key string")
    rows = sinks.batch_results(batch, done, "input_key").orderBy("input_ord").collect()
    assert [(r.status, r.position) for r in rows] == [("OK", "1/3"), ("FAILED", "2/3"), ("OK", "3/3")]


def test_files_and_archives(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a/b.md", "hi")
    (tmp_path / "x.zip").write_bytes(buf.getvalue())
    (tmp_path / "y.zip").write_bytes(b"no archive")
    (tmp_path / "z.md").write_bytes(b"-")
    found = files(spark, str(tmp_path), "*.zip")
    assert found.count() == 2
    assert [(r.member, bytes(r.data)) for r in zip_members(found).collect()] == [("a/b.md", b"hi")]


def test_numbered_folders(spark):
    df = spark.createDataFrame([("chunk_10",), ("chunk_2",), ("other",)], "f string")
    assert [r.f for r in numbered_folders(df, "f").orderBy("chunk_no").collect()] == ["chunk_2", "chunk_10"]


def test_flatten_repeated_link(spark):
    md = spark.createDataFrame([(1, "(a) (b) (a)"), (2, "(a)")], "chunk_no int, md string")
    links = spark.createDataFrame([(1, 0, "(a)"), (1, 1, "(b)"), (1, 2, "(a)"), (2, 0, "(a)")], "chunk_no int, pos int, link string")
    have = spark.createDataFrame([(1, "(a)"), (2, "(a)")], "chunk_no int, link string")
    run = lambda d: [r.md for r in assemble.flatten_images(md, links, have, d).orderBy("chunk_no").collect()]
    g = "all_graphs/graph_%04d.png"
    assert run(True) == [f"{g % 0} (b) {g % 0}", g % 1]
    assert run(False) == [f"{g % 0} (b) {g % 0}", g % 2]


def test_router(spark):
    assert one(spark, router.route(F.lit(30), F.lit(True))) == "direct"
    assert one(spark, router.route(F.lit(31), F.lit(True))) == "chapter_file"
    assert one(spark, router.route(F.lit(31), F.lit(False))) == "page_blocks"
    assert one(spark, router.formula_links(F.lit("![Mathematical Formula Reference](./formulas/math_page_3.png)"))) == ["./formulas/math_page_3.png"]


def test_extractors_compare(spark):
    a = spark.createDataFrame([("k", 0, "x"), ("k", 1, "y")], "key string, page_no int, body string")
    b = spark.createDataFrame([("k", 0, "x"), ("k", 2, None)], "key string, page_no int, body string")
    assert sorted((r.page_no, r.same) for r in router.compare_extractors(a, b, "key").collect()) == [(0, True), (1, False), (2, True)]


def test_stream_converts_each_chunk_once(spark, tmp_path):
    from quirefold.streaming import convert_stream

    src, man, state = (str(tmp_path / x) for x in ("src", "man", "state"))
    up = lambda p: ("|".join(p), None, {})
    for i in range(2):
        spark.createDataFrame([(f"k{i}", "1\n2\n3")], "key string, text string").write.mode("append").parquet(src)
        convert_stream(spark, src, "key string, text string", man, state, up, 2).awaitTermination()
    rows = checkpoint.read_manifest(spark, man).collect()
    assert sorted((r.key, r.text) for r in rows) == [("k0", "1|2"), ("k0", "3"), ("k1", "1|2"), ("k1", "3")]
    assert {r.chunk_tag for r in rows} == {"00000_00002", "00002_00003"}  # those that plan_chunks gives


def test_running_number_of_wide_rows(spark, tmp_path):
    """More rows than one partition holds, written: each number once, in order."""
    n = 400_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("pad"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assemble.running_number(rows, ["k"], "n").write.parquet(str(tmp_path / "n"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    back = spark.read.parquet(str(tmp_path / "n"))
    assert back.rdd.getNumPartitions() > 1
    assert (back.count(), back.where("k = n").count()) == (n, n)


def test_running_number_of_ties_and_none(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x"), (0, "y")], "k int, n0 string")
    got = assemble.running_number(rows, ["k"], "n").orderBy("n").collect()
    assert [(r.k, r.n) for r in got] == [(None, 0), (0, 1), (1, 2), (1, 3)]
    assert assemble.running_number(rows.where("false"), ["k"], "n").count() == 0


def test_batch_from_paths_to_report(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("# Title One\n\u00a9 1990 by Ann Lee\fbad\fp3")
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.txt").write_text("broken")

    def factory(tag):
        def conv(pages):
            if "bad" in pages:
                raise RuntimeError
            return tag.join(pages), '{"n":1}', {"i.png": b"1"} if len(pages) > 1 or "p3" in pages else {}

        return conv

    def splitter(content):
        if content == b"broken":
            raise ValueError
        return content.decode().split("\f")

    inputs = [str(tmp_path / x) for x in ("a b.txt", "gone.txt", "c.txt", "d.txt")] + [f"file://{tmp_path}/c.txt"]
    out, man = str(tmp_path / "out"), str(tmp_path / "man")
    for _ in range(2):  # the second run has nothing to convert
        report = convert_batch(spark, inputs, out, man, convert.Setup(factory, {"tag": "|"}), splitter, 2).orderBy("input_ord").collect()
        assert [r.status for r in report] == ["OK", "FAILED", "OK", "FAILED", "OK"]
        assert spark.read.parquet(man).count() == 3
    books = {r.folder: b"".join(publish.read_text(spark, out, r.folder)).decode() for r in publish.books(spark, out).collect()}
    assert books == {"Lee_Title_One_1990": "# Title One\n\u00a9 1990 by Ann Lee\n\n\n\n<!-- PyPDF Fallback: Page 2 -->\n\nbad\n\np3", "c": "plain"}
    assert sorted(str(p.relative_to(out)) for p in (tmp_path / "out").rglob("*.png")) == [f"versions/{spark.read.parquet(f'{out}/pointers/2').first().version}/images/Lee_Title_One_1990/images/pg_3_i.png"]


def test_converter_is_set_up_once_a_worker(spark):
    def factory():
        made = []

        def conv(pages):
            made.append(1)
            return str(len(made)), None, {}

        return conv

    pages = spark.createDataFrame([("a", i, "x") for i in range(40)], "key string, page_no int, body string").coalesce(1)
    rows = convert.convert_chunks(pages, convert.Setup(factory), 1).collect()
    assert max(int(r.text) for r in rows) > 1


def test_settings():
    env = config.read_env("# c\nA=1\nB=${A}/${HOME_}x${NO}\nbad\nA=2\n", {"HOME_": "h"})
    assert env == {"A": "2", "B": "1/hx"}
    assert config.first_set(None, " ", "p", "q") == "p"
    assert config.first_set(None, "") is None
    assert config.options({"a": 1, "b": 2}, {"b": 3}, {"b": 4}) == {"a": 1, "b": 4}
    with pytest.raises(ValueError, match="c"):
        config.options({"a": 1}, {"c": 1})
    config.require(gpu=True)
    with pytest.raises(RuntimeError, match="gpu"):
        config.require(gpu=False, disk=True)


def test_marker_and_repositories(spark, tmp_path):
    path = str(tmp_path / "marker")
    assert sinks.read_marker(spark, path) is None
    sinks.write_marker(spark, path, "7", at="x")
    rows = spark.createDataFrame([(sinks.read_marker(spark, path),)], "m string")
    assert rows.select(decisions.setup_decision(F.col("m"), "7", F.lit(True)).alias("d")).first().d == "skip"
    for p in ("a/.git/objects", "b/c/.git", "d"):
        (tmp_path / "w" / p).mkdir(parents=True)
    assert sorted(r.repo_path for r in repositories(spark, str(tmp_path / "w")).collect()) == [f"{tmp_path}/w/a", f"{tmp_path}/w/b/c"]


def test_near_titles_equal_brute_force(spark):
    """Edits of real and of awkward titles, equal ones, and blank requests; against every pair."""
    rng = random.Random(4)
    words = ["Äpfel", "index", "of", "the", "zz", "Moby", "aaaa", "théorie", "Part"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(150)] + ["", None, " \t", "a", "ab", "aaaaaaaa", "aaaaaaaaa"] * 2

    def edited(t):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "é" + t[i + 1 :]])
        return t

    asked = [edited(t or "") for t in titles[:60]] + ["", None, "the the", "the the"]
    got = router.nearest_titles(
        spark.createDataFrame(list(enumerate(asked)), "n int, w string"), spark.createDataFrame([(t,) for t in titles], "t string"), "w", "t", 5
    )

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    have = {t.strip().lower() for t in titles if t and t.strip()}
    want = []
    for n, w in enumerate(asked):
        low = (w or "").strip().lower()
        near = sorted((d, t) for t in have if low and (d := distance(low, t)) <= min(len(low) // 4, 3))
        want += [(n, w, t, d, r) for r, (d, t) in enumerate(near[:5], 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_three_way_sync_ends_in_agreement(spark):
    """Whatever both sides and the snapshot hold: after one round of all that isn't a conflict, a second has nothing to do."""
    states = [(b, dead, x, y) for b in (None, "D", "E") for dead in (False, True) for x in (None, "D", "L") for y in (None, "D", "L", "R") if not (dead and b is None)]
    make = lambda rows, kinds: spark.createDataFrame([(i, *r) for i, r in enumerate(rows) if r[0] is not None], f"k int, digest string{kinds}")
    base = make([s[:2] for s in states], ", deleted boolean")
    left, right = make([(s[2],) for s in states], ""), make([(s[3],) for s in states], "")
    rows = {r.k: r for r in decisions.sync_three_way(base, left, right, "k").collect()}
    after = []
    for i, (b, dead, x, y) in enumerate(states):
        r = rows.get(i)
        if r is None:
            assert (b, x, y) == (None, None, None)
            continue
        if r.action == "conflict":
            live = None if dead else b
            assert x != y and x != live and y != live and not (dead and b in (x, y))
            continue
        x, y = {"copy_left": (y, y), "copy_right": (x, x), "delete_left": (None, y), "delete_right": (x, None)}.get(r.action, (x, y))
        assert x == y
        assert (None if r.deleted else r.digest) == x
        after.append((i, r.digest, r.deleted, x))
    again = decisions.sync_three_way(
        spark.createDataFrame([a[:3] for a in after], "k int, digest string, deleted boolean"), *[spark.createDataFrame([(a[0], a[3]) for a in after if a[3]], "k int, digest string")] * 2, "k"
    )
    assert {r.action for r in again.collect()} == {"none"}
    assert {r.action for r in rows.values()} == set(decisions.ACTIONS)


def test_common_subsequences_equal_the_quadratic_table():
    rng = random.Random(2)

    def quadratic(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[j], old[j + 1]))
        return row

    for _ in range(200):
        a, b = ([rng.randrange(rng.choice((2, 9, 40))) for _ in range(rng.choice((0, 1, 3, 30, 80)))] for _ in "ab")
        if rng.random() < 0.5:  # edits of one text
            b = [x for x in a if rng.random() < 0.8]
            b.insert(rng.randrange(len(b) + 1), 99)
        assert alignment.common_lengths(a, b).tolist() == quadratic(a, b)
        pairs = alignment.common(a, b)
        assert len(pairs) == quadratic(a, b)[-1]
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and i < j for (p, i), (q, j) in zip(pairs, pairs[1:], strict=False))
    long = list(range(60_000))
    assert len(alignment.common(long, long[:20_000] + [-1] + long[20_500:])) == 59_500


def test_spans_rebuild_both_extractions(spark):
    pages = lambda rows: spark.createDataFrame(rows, "key string, page_no int, body string")
    a = pages([("k", 0, "one\ntwo\nthree"), ("k", 1, "four"), ("only a", 0, "x"), ("null", 0, None), ("same", 0, "p\nq")])
    b = pages([("k", 0, "one"), ("k", 5, "2\nthree\nfour"), ("k", 6, "five"), ("only b", 0, "y\nz"), ("null", 3, ""), ("same", 7, "p\nq")])
    spans = alignment.align(a, b)
    got = sorted(tuple(r) for r in spans.where("key = 'k'").collect())
    assert sorted(got, key=lambda r: (r[2], r[4])) == [
        ("k", True, 0, 1, 0, 1, 0, 0), ("k", False, 1, 1, 1, 1, 0, 5), ("k", True, 2, 2, 2, 2, 0, 5), ("k", False, 4, 0, 4, 1, None, 6),
    ]
    rest = {r.key: (r.n_a, r.n_b, r.n_same, r.similarity) for r in alignment.similarity(spans).collect()}
    assert rest["only a"] == (1, 0, 0, 0.0)
    assert rest["only b"] == (0, 2, 0, 0.0)
    assert rest["null"] == (1, 1, 1, 1.0)
    assert rest["same"] == (2, 2, 2, 1.0)


def test_contents_lead_to_pages_in_order(spark):
    bodies = ["Contents", "# The  Start\ntext", "x", "Middle\ny", "The Start\nagain", "## END", None]
    pages = spark.createDataFrame([("k", i, b) for i, b in enumerate(bodies)] + [("other", 0, "Middle")], "key string, page_no int, body string")
    entries = spark.createDataFrame([("k", 0, "The Start .... 1"), ("k", 1, "middle 3"), ("k", 2, "Missing .. 4"), ("k", 3, "End"), ("k", 4, ""), ("none", 0, "Middle")], "key string, pos int, title string")
    got = alignment.place_entries(entries, pages).orderBy("key", "pos").collect()
    assert [r.page_no for r in got] == [1, 3, None, 5, None, None]
    heads = spark.createDataFrame([("k", i, level) for i, level in enumerate([2, 1, 2, 3, 3, 2, 6, 1])], "key string, pos int, level int")
    assert [r.parent for r in alignment.with_parents(heads, "key").orderBy("pos").collect()] == [None, None, 1, 2, 2, 1, 5, None]
