"""The batch run: identity by content, attempts, plans by page ranges, publication, replies."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quirefold.operators import attempts, chunking, intervals, memo
from quirefold.plans import batch as plans
from quirefold.plans.batch import convert_batch
from quirefold.sources import identity, publish


# lambdas travel to the workers by value; this module isn't there
upper = lambda pages: ("|".join(pages).upper(), None, {})
pictured = lambda pages: ("|".join(pages), None, {f"{p}.png": p.encode() for p in pages})


def books(spark, out):
    """folder → text, joined from its files."""
    return {r.folder: b"".join(publish.read_text(spark, out, r.folder)).decode() for r in publish.books(spark, out).collect()}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


class Place:
    def __init__(self, top):
        self.top, self.out, self.man = top, str(top / "out"), str(top / "man")

    def file(self, name, text):
        p = self.top / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        os.utime(p, (1_700_000_000, 1_700_000_000 + hash(text) % 1000))
        return str(p)


@pytest.fixture
def at(tmp_path):
    return Place(tmp_path)


def run(spark, at, inputs, conv=upper, **more):
    rows = convert_batch(spark, inputs, at.out, at.man, conv, **more).orderBy("input_ord").collect()
    return [(r.status, r.detail.removeprefix(at.out + "/")) for r in rows]


def test_files_of_one_name_and_replaced_files(spark, at):
    inputs = [at.file("a/book.txt", "one"), at.file("b/book.txt", "two"), at.file("c/copy.txt", "one"), at.file("d/book.txt", "one")]
    got = run(spark, at, inputs)
    assert [s for s, _ in got] == ["OK"] * 4
    assert got[0][1] == got[3][1] == "book" and got[2][1] == "copy"
    assert got[1][1].startswith("book_") and len(got[1][1]) == len("book_") + 8
    assert books(spark, at.out) == {"book": "ONE", got[1][1]: "TWO", "copy": "ONE"}
    assert spark.read.parquet(at.man).count() == 2  # equal files are converted once
    at.file("a/book.txt", "p0\fp1")
    assert run(spark, at, inputs[:1]) == [("OK", "book")]
    assert books(spark, at.out) == {"book": "P0|P1", got[1][1]: "TWO", "copy": "ONE"}


def test_unchanged_files_are_not_read_again(spark, at):
    paths = [at.file("a.txt", "x"), at.file("b.txt", "y")]
    index = str(at.top / "index")
    first = identity.identify(spark, paths, index).collect()
    assert identity.known(spark, index).count() == 2
    at.file("b.txt", "z")
    second = {r.raw_input: r.digest for r in identity.identify(spark, paths, index).collect()}
    assert spark.read.parquet(index).count() == 3  # only the changed one was read
    assert second[paths[0]] == first[0].digest
    assert second[paths[1]] != first[1].digest


def test_another_size_converts_nothing_twice(spark, at):
    calls = at.top / "calls"
    calls.mkdir()
    where = str(calls)

    def conv(pages):
        for p in pages:
            with open(f"{where}/{p}-{time.time_ns()}", "w"):
                pass
        return "|".join(pages), None, {}

    inputs = [at.file("book.txt", "\f".join("abcdef"))]
    assert run(spark, at, inputs, conv, size=2) == [("OK", "book")]
    assert run(spark, at, inputs, conv, size=3) == [("OK", "book")]
    assert sorted(p.name[0] for p in calls.iterdir()) == list("abcdef")
    assert books(spark, at.out) == {"book": "a|b\n\nc|d\n\ne|f"}


def test_ranges(spark):
    done = spark.createDataFrame([("a", 2, 4), ("a", 2, 5), ("a", 4, 6), ("a", 7, 8), ("b", 0, 3)], "key string, start_page int, end_page int")
    pages = spark.createDataFrame([("a", 12), ("b", 3), ("c", 4), ("d", 0)], "key string, n int")
    assert [tuple(r) for r in intervals.kept_ranges(done, "key").orderBy("key", "start_page").collect()] == [("a", 2, 5), ("a", 7, 8), ("b", 0, 3)]
    left = intervals.remaining(pages, done, "key", "n", 3)
    assert sorted((r.key, r.start_page, r.end_page) for r in left.collect()) == [("a", 0, 2), ("a", 5, 7), ("a", 8, 11), ("a", 11, 12), ("c", 0, 3), ("c", 3, 4)]
    fresh = intervals.remaining(pages, done.where("false"), "key", "n", 3)
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, chunking.plan_chunks(pages, "n", 3).drop("n").collect()))
    # what is planned next closes the gaps: then all is kept and nothing is left
    both = done.unionByName(left.select("key", "start_page", "end_page"))
    assert intervals.remaining(pages, both, "key", "n", 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        intervals.remaining(pages, done, "key", "n", 0)


def test_causes_and_tries(spark, at):
    def splitter(content):
        if b"broken" in content:
            raise ValueError("no such format")
        return content.decode().split("\f")

    def conv(pages):
        if "bad" in pages:
            raise RuntimeError("cannot do it")
        return "|".join(pages), None, {}

    inputs = [at.file("a.txt", "x\fbad"), at.file("b.txt", "broken"), str(at.top / "gone.txt"), at.file("d.txt", "bad")]
    for k in range(4):
        got = run(spark, at, inputs, conv, splitter=splitter, mode="drop_chunk", size=1)
        assert got[0] == ("OK", "a")
        assert got[1] == ("FAILED", f"split failed {min(k + 1, 3)} times: ValueError: no such format")
        assert got[2] == ("FAILED", f"FileNotFoundError: no such file: {inputs[2]}")
        assert got[3] == ("FAILED", f"convert of pages 1-1 failed {min(k + 1, 3)} times: RuntimeError: cannot do it")
    log = plans.attempts_so_far(spark, plans.Ledger(at.man))
    assert log.where("stage = 'convert' and not ok").count() == 6  # two chunks, three tries
    assert attempts.read(spark, f"{at.man}/_attempts").where("not ok").count() == 3
    assert books(spark, at.out) == {"a": "x"}
    inputs = [at.file("a.txt", "bad\fbad")]
    with pytest.raises(RuntimeError, match="cannot do it"):
        run(spark, at, inputs, conv, mode="fail_fast")
    with pytest.raises(RuntimeError, match="gpu"):
        run(spark, at, inputs, conv, needs={"gpu": False})


def test_success_ends_a_row_of_failures(spark):
    rows = [("k", "convert", 0, 1, ok, None if ok else f"c{i}", "r", float(i)) for i, ok in enumerate([False, False, True, False])]
    log = spark.createDataFrame(rows, attempts.SCHEMA)
    assert [(r.n_failed, r.cause) for r in attempts.failures(log).collect()] == [(1, "c3")]
    assert attempts.exhausted(log, 2).count() == 0


def images(at):
    return sorted(p.name for p in (at.top / "out").rglob("*.png"))


def test_no_image_of_an_earlier_version_stays(spark, at):
    inputs = [at.file("book.txt", "a\fb"), at.file("other.txt", "o")]
    run(spark, at, inputs, pictured)
    assert images(at) == ["pg_1_a.png", "pg_1_b.png", "pg_1_o.png"]
    at.file("book.txt", "c")
    run(spark, at, inputs[:1], pictured)
    assert books(spark, at.out) == {"book": "c", "other": "o"}
    assert images(at) == ["pg_1_c.png", "pg_1_o.png"]


def test_a_killed_publication_leaves_one_whole_version(spark, at, monkeypatch):
    """Killed before the text, the images, the switch and the removal of what is old; then a torn pointer table."""

    def stop(*_, **__):
        raise KeyboardInterrupt

    inputs = [at.file("book.txt", "a\fb")]
    run(spark, at, inputs, pictured)
    there = "a|b"
    for k, step in enumerate(("write_text", "write_images", "switch", "sweep_old")):
        at.file("book.txt", f"c{k}")
        with monkeypatch.context() as m:
            m.setattr(plans.sinks if step == "write_images" else publish, step, stop)
            with pytest.raises(KeyboardInterrupt):
                run(spark, at, inputs, pictured)
        there = f"c{k}" if step == "sweep_old" else there
        assert books(spark, at.out) == {"book": there}
    torn = at.top / "out" / "pointers" / "9"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    assert books(spark, at.out) == {"book": "c3"}
    at.file("book.txt", "end")
    assert run(spark, at, inputs, pictured) == [("OK", "book")]
    assert books(spark, at.out) == {"book": "end"}
    assert images(at) == ["pg_1_end.png"]
    assert len(list((at.top / "out" / "versions").iterdir())) == 1


def test_purge_forgets_what_is_published(spark, at):
    run(spark, at, [at.file("book.txt", "a")], purge=True)
    assert plans.checkpoint.read_manifest(spark, at.man).count() == 0
    assert not [p for p in (at.top / "man").iterdir() if p.name[0] not in "_."]
    again = spark.createDataFrame([("k", 0, "00000_00001", "x")], "key string, start_page int, chunk_tag string, text string")
    plans.checkpoint.commit(again, at.man)
    assert plans.checkpoint.read_manifest(spark, at.man).count() == 1


def test_long_books_are_written_in_files(spark, at):
    """Many segments in files of few bytes: every byte of the book once, in order, and the index says where."""
    text = [f"{i}:" + "é" * (i % 50) for i in range(500)]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(text)] + [("l", 0, "one")], "folder string, start_page int, text string")
    placed = publish.with_offsets(rows.withColumn("n_bytes", F.octet_length("text")))
    index = publish.write_text(placed, str(at.top / "text"), 1000).orderBy("folder", "offset").collect()
    want = "\n\n".join(text).encode()
    files = sorted((at.top / "text" / "k").iterdir())
    assert b"".join(p.read_bytes() for p in files) == want
    assert [r.file for r in index if r.folder == "k"] == [p.name for p in files]
    own = [r for r in index if r.folder == "k"]
    assert [r.offset for r in own] == [sum(x.n_bytes for x in own[:i]) for i in range(len(own))]
    assert len(files) > 10
    assert (at.top / "text" / "l" / f"{0:015d}.md").read_text() == "one"


def test_info_and_replies_name_books(spark, at):
    asked = at.top / "asked"
    asked.mkdir()
    where = str(asked)

    def ask(prompt):
        with open(f"{where}/{time.time_ns()}", "w") as f:
            f.write(prompt)
        if "fails" in prompt.lower():
            raise OSError("busy")
        return '{"title": "Reply", "author": "Bo Ray", "year": "1999"}'

    def info(content):
        return {"title": "Own", "author": "Ann Lee", "created": "2001-02-03"} if b"own" in content else {}

    inputs = [at.file("a.txt", "own"), at.file("b.txt", "text"), at.file("c.txt", "# Head\nfails")]
    asking = {"tries": 2, "pause": 0.01}
    for k in range(2):
        got = run(spark, at, inputs, info=info, ask=ask, asking=asking)
        assert [d for _, d in got] == ["Lee_Own_2001", "Ray_Reply_1999", "UnknownAuthor_HEAD_0000"]
        assert len(list(asked.iterdir())) == 3 + 2 * k  # b once; c twice in each run; a never
    log = memo.read(spark, f"{at.man}/_replies").collect()
    assert sorted(r.reply_cause or "" for r in log) == ["", "OSError: busy"]


def test_equal_prompts_are_asked_once(spark, at):
    rows = spark.createDataFrame([(i, "same" if i < 9 else f"t{i}") for i in range(12)], "id int, text string")
    path = str(at.top / "memo")
    got = memo.with_replies(rows, F.col("id") != 11, "text", lambda p: p[::-1], path)
    assert {r.id: r.reply for r in got.collect()} == {**dict.fromkeys(range(9), "emas"), 9: "9t", 10: "01t", 11: None}
    assert spark.read.parquet(path).count() == 3


def test_what_ended_tasks_have_converted_stays(spark, at):
    """A job that a later chunk breaks: the chunks of the tasks before it aren't converted again."""
    calls = at.top / "calls"
    calls.mkdir()
    where = str(calls)

    def conv(pages):
        with open(f"{where}/{pages[0]}-{time.time_ns()}", "w"):
            pass
        if pages[0] == "9" and not os.path.exists(f"{where}/mended"):
            time.sleep(3)
            os._exit(1)  # the worker dies, as when it runs out of memory
        return pages[0], None, {}

    inputs = [at.file("book.txt", "\f".join("0123456789"))]
    with pytest.raises(Exception, match="(?i)worker|crash|exit|abort"):
        run(spark, at, inputs, conv, size=1)
    (calls / "mended").touch()
    assert run(spark, at, inputs, conv, size=1) == [("OK", "book")]
    first = [p.name[0] for p in calls.iterdir() if p.name != "mended"]
    assert sum(x != "9" for x in first) < 18  # most of the nine only once
    assert books(spark, at.out) == {"book": "\n\n".join("0123456789")}


def test_a_resumed_file_is_read_by_range(spark, at, monkeypatch):
    """A long file, half of which is converted: the second run reads the due pages alone."""
    inputs = [at.file("book.txt", "\f".join(f"page {i}" for i in range(400)))]
    key = identity.identify(spark, inputs, str(at.top / "index")).first().digest
    half = spark.createDataFrame([(key, 0, "00000_00390", "first", 390)], "key string, start_page int, chunk_tag string, text string, end_page int")
    plans.checkpoint.commit(half, at.man)
    read = []
    whole = plans.page_ranges.read
    monkeypatch.setattr(plans.page_ranges, "read", lambda index, planned: read.append(whole(index, planned)) or read[0])
    assert run(spark, at, inputs) == [("OK", "book")]
    assert books(spark, at.out) == {"book": "first\n\n" + "|".join(f"PAGE {i}" for i in range(390, 400))}
    monkeypatch.setattr(plans.page_ranges, "read", whole)
    index = plans.page_index(spark, plans.Ledger(at.man)).withColumn("path", F.lit(inputs[0]))
    again = whole(index, spark.createDataFrame([(key, 390, 400)], "key string, start_page int, end_page int"))
    assert again.agg(F.sum("n_bytes")).first()[0] == len("\f".join(f"page {i}" for i in range(390, 400)))
