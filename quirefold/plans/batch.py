"""A whole batch: paths in, published books out, one status row an input."""

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import bib, config, names
from quirefold.operators import assemble, attempts, checkpoint, chunking, convert, intervals, memo
from quirefold.sources import INFO, form_feeds, identity, page_ranges, publish, sinks, split_pages
from quirefold.sources.scratch import discard, stored
from quirefold.sources.store import exists

#: Tasks that conversion is dealt to at most; each commits its own chunks.
MOST_TASKS = 10_000
SOURCES = "key string, n_pages int, title string, author string, created string, cause string, run string"


class Ledger:
    """The tables of a manifest folder beside its chunks. Names with an underscore are no part of the chunks' table."""

    def __init__(self, path: str):
        top = path.rstrip("/")
        self.chunks, self.index, self.sources, self.pages = top, f"{top}/_inputs", f"{top}/_sources", f"{top}/_pages"
        self.attempts, self.replies = f"{top}/_attempts", f"{top}/_replies"


def known_sources(spark: SparkSession, ledger: Ledger) -> DataFrame:
    """key, n_pages and document info of the contents that were split before."""
    if not exists(spark, ledger.sources):
        return spark.createDataFrame([], SOURCES)
    return spark.read.schema(SOURCES).parquet(ledger.sources).dropDuplicates(["key"])


def attempts_so_far(spark: SparkSession, ledger: Ledger) -> DataFrame:
    return attempts.read(spark, ledger.attempts).unionByName(checkpoint.failed_attempts(spark, ledger.chunks))


def unread(spark: SparkSession, ledger: Ledger, found: DataFrame, size: int, tries: int) -> DataFrame:
    """The contents that have pages to convert, or were never split, and have tries left."""
    keys = found.select(F.col("digest").alias("key"))
    mine = known_sources(spark, ledger).join(keys, "key", "left_semi")
    open_ = plan(spark, ledger, mine, size, tries).select("key").distinct()
    due = keys.join(mine.select("key"), "key", "left_anti").unionByName(open_)
    return attempts.with_tries_left(due, attempts.read(spark, ledger.attempts), "split", tries)


def split_due(spark: SparkSession, ledger: Ledger, found: DataFrame, due: DataFrame, splitter, info, run: str) -> DataFrame:
    """Splits the due contents, each read whole; their pages, stored."""
    files = identity.contents(spark, found.join(due, found["digest"] == due["key"], "left_semi"))
    rows = stored(split_pages(files, splitter, info, "key"), "pages")
    heads = rows.where("page_no = -1")
    new = heads.where("n_pages is not null").join(known_sources(spark, ledger).select("key"), "key", "left_anti")
    new.select("key", "n_pages", *INFO, "cause", F.lit(run).alias("run")).write.mode("append").parquet(ledger.sources)
    attempts.append(heads.select("key", F.col("n_pages").isNotNull().alias("ok"), "cause"), "split", run, ledger.attempts)
    return rows


def page_index(spark: SparkSession, ledger: Ledger) -> DataFrame:
    return spark.read.schema(page_ranges.INDEX).parquet(ledger.pages) if exists(spark, ledger.pages) else spark.createDataFrame([], page_ranges.INDEX)


def index_due(spark: SparkSession, ledger: Ledger, found: DataFrame, due: DataFrame, run: str) -> DataFrame:
    """Finds the page starts of due contents that have none yet; the index with the contents' present paths. Pages are read
    later, and only those that are planned."""
    places = stored(identity.located(spark, found), "places")
    new = places.join(due, "key", "left_semi").join(known_sources(spark, ledger).select("key"), "key", "left_anti")
    page_ranges.index(new).write.mode("append").parquet(ledger.pages)
    counts = page_ranges.page_counts(page_index(spark, ledger)).join(new.select("key"), "key", "left_semi")
    counts.select("key", "n_pages", *[F.lit(None).cast("string").alias(c) for c in (*INFO, "cause")], F.lit(run).alias("run")).write.mode("append").parquet(ledger.sources)
    return page_index(spark, ledger).dropDuplicates(["key", "first_page"]).drop("path").join(places.select("key", "path"), "key")


def plan(spark: SparkSession, ledger: Ledger, books: DataFrame, size: int, tries: int) -> DataFrame:
    """Chunks over the pages that no finished chunk of any size has, without those that failed too often."""
    left = intervals.remaining(books, checkpoint.live_chunks(spark, ledger.chunks), "key", "n_pages", size)
    return attempts.with_tries_left(left, checkpoint.failed_attempts(spark, ledger.chunks), "convert", tries)


def convert_due(spark: SparkSession, ledger: Ledger, due: DataFrame, planned: DataFrame, n: int, converter, mode: str, limits: tuple, run: str) -> None:
    """Converts n planned chunks from their pages (key, page_no, body, start_page); each task commits what it has finished, failures
    with their cause too."""
    due = due.repartition(max(1, min(n, MOST_TASKS)), "key", "start_page")
    # a first failure that has to end the run is a row too: it is raised once it is in the log
    how = "drop_chunk" if mode == "fail_fast" else mode
    done = convert.convert_chunks(due.select("key", "page_no", "body", "start_page"), converter, None, how, *limits, keep_failed=True)
    ends = planned.select("key", "start_page", "end_page", "chunk_tag")
    checkpoint.commit(done.join(F.broadcast(ends) if n <= 100_000 else ends, ["key", "start_page"]), ledger.chunks, run)
    if mode == "fail_fast":
        bad = checkpoint.raw_manifest(spark, ledger.chunks).where((F.col("run") == run) & F.col("text").isNull()).select("key", "start_page", "cause").first()
        if bad:
            raise RuntimeError(f"the chunk at page {bad.start_page + 1} of {bad.key[:8]} failed: {bad.cause}")


def named_books(heads: DataFrame, ask: Callable[[str], str] | None = None, replies: str = "", **asking) -> DataFrame:
    """heads (key, raw_input, input_ord, head, title, author, created, …) with ``folder``, ``bib`` and ``tier``: document info, then
    a reply if ``ask`` is given, then the text, then the file's name. Only books without descriptive info are asked about."""
    info = bib.doc_info(F.col("title"), F.col("author"), F.expr("try_cast(created AS timestamp)"))
    rows = heads.withColumn("info", info).withColumn("found", bib.text_info(F.col("head")))
    if ask:
        need = ~bib.descriptive(F.col("info.title"), F.col("info.author"))
        rows = memo.with_replies(rows, need, "head", ask, replies, **asking).withColumn("reply", bib.reply_info(F.col("reply")))
    known = bib.cascade(rows, "info", "found", "reply" if ask else None)
    b = F.col("bib")
    folder = names.output_name(b["title"], b["author"], b["year"], names.stem("raw_input"), bib.descriptive(b["title"], b["author"]))
    return known.withColumn("folder", folder)


def assembled(spark: SparkSession, ledger: Ledger, ranges: DataFrame) -> DataFrame:
    """The chunks of the kept ranges, which make up the books, each once: key, start_page, end_page, text, meta, images."""
    live = checkpoint.live_chunks(spark, ledger.chunks)
    rows = live.join(ranges.withColumnRenamed("end_page", "_end"), ["key", "start_page"]).where(F.col("end_page") == F.col("_end"))
    return rows.select("key", "start_page", "end_page", "text", "meta", "images").dropDuplicates(["key", "start_page"])


def publish_books(spark: SparkSession, chunks: DataFrame, books: DataFrame, output: str, run: str) -> DataFrame:
    """Writes the text, its index, the images and the rows of the books to a folder of the run, then switches to it. The
    text goes from the chunks to its files range by range; no book is put together in one row."""
    at = publish.version_path(output, run)
    narrow = chunks.select("key", "start_page", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    places = publish.with_offsets(narrow.join(books.select("key", "folder"), "key")).select("folder", "key", "start_page", "offset", "first", "n_bytes")
    segments = places.drop("n_bytes").join(chunks.select("key", "start_page", "text"), ["key", "start_page"])
    publish.write_text(segments, f"{at}/text").write.parquet(f"{at}/index")
    pictures = checkpoint.image_rows(chunks).join(books.select("key", "folder"), "key")
    sinks.write_images(pictures, f"{at}/images").write.parquet(f"{at}/image_files")
    sizes = places.groupBy("folder").agg(F.max(F.col("offset") + F.col("n_bytes") + F.when(F.col("first"), 0).otherwise(len(assemble.PLAIN_BREAK))).cast("long").alias("n_bytes"))
    rows = books.join(sizes, "folder").select("folder", "key", "metadata", "n_bytes", "n_chunks")
    rows.write.parquet(f"{at}/books")
    publish.switch(spark, output, run, rows)
    publish.sweep_old(spark, output)
    return rows


def report(inputs: DataFrame, folders: DataFrame, problems: DataFrame, lacking: DataFrame, output: str, n: int) -> DataFrame:
    """input_ord, raw_input, input_key, digest, status, detail, missing_pages, position. OK: the input's own content is published, and
    ``detail`` says where; else ``detail`` is the cause."""
    rows = inputs.join(folders, "input_ord", "left").join(problems.select(F.col("key").alias("digest"), F.col("cause").alias("_why")), "digest", "left")
    rows = rows.join(lacking.select(F.col("key").alias("digest"), "missing_pages"), "digest", "left")
    ok = F.col("folder").isNotNull()
    detail = F.when(ok, names.destination(F.lit(output), "folder")).otherwise(F.coalesce("cause", "_why", F.lit("ValueError: it has no pages")))
    return rows.select(
        "input_ord", "raw_input", "input_key", "digest", F.when(ok, "OK").otherwise("FAILED").alias("status"), detail.alias("detail"),
        F.when(ok, F.coalesce("missing_pages", F.lit(0))).alias("missing_pages"), F.concat("input_ord", F.lit(f"/{n}")).alias("position"),
    )


def convert_batch(
    spark: SparkSession, inputs: list[str], output: str, manifest: str, converter: convert.Converter,
    splitter: Callable[[bytes], list[str]] = form_feeds, size: int = chunking.CHUNK_SIZE, mode: str = "fallback",
    info: Callable[[bytes], dict[str, str]] | None = None, ask: Callable[[str], str] | None = None, asking: Mapping[str, object] | None = None,
    needs: Mapping[str, bool] | None = None, tries: int = attempts.TRIES, limits: tuple[float | None, float | None] = (1800, 240), purge: bool = False,
) -> DataFrame:
    """Converts what isn't converted yet and publishes the books of the batch, see ``publish``; the result is that of ``report``.

    An input is what it holds: files of one name and other bytes are two books (the later one's folder ends in its digest), a
    file with new bytes is converted anew, and files of equal bytes are converted once and named each. Chunks of
    any size that the manifest has for a content stay; only pages that none has are planned, ``size`` at a
    time. Failures of the splitter, of a chunk that is dropped and of replies are rows of the log with their cause. What has
    failed ``tries`` times isn't tried again with these pages. A run that stops is run again with the same manifest:
    what its tasks had finished stays.

    Text files whose pages end at form feeds, in a store that tasks reach, are indexed once and then only their due pages are
    read; files of other kinds go through ``splitter`` whole.

    ``needs`` names capabilities (a GPU, a model) and whether they are there; if one isn't, nothing begins. ``info`` gives a
    file's title, author and created; ``ask`` gets the beginning of a book without such info and returns a
    JSON reply, once for each beginning (``asking``: see ``memo.with_replies``). ``limits`` are the seconds of a chunk and
    of a page. With ``purge`` the manifest forgets the published books' chunks. In mode ``fail_fast`` a
    failed chunk ends the run before anything is published.
    """
    config.require(**(needs or {}))
    if mode not in convert.MODES:
        raise ValueError(f"mode must be one of {convert.MODES}")
    run, ledger = uuid.uuid4().hex, Ledger(manifest)
    batch = stored(identity.identify(spark, inputs, ledger.index), "inputs")
    found = identity.readers(batch)
    keys = found.select(F.col("digest").alias("key"))
    due = stored(unread(spark, ledger, found, size, tries), "due")
    mine = lambda: known_sources(spark, ledger).join(keys, "key", "left_semi")
    if splitter is form_feeds and info is None and all(map(page_ranges.reachable, inputs)):
        index = index_due(spark, ledger, found, due, run)
        planned = stored(plan(spark, ledger, mine(), size, tries), "planned")
        pages = page_ranges.read(index, planned)
    else:
        split = split_due(spark, ledger, found, due, splitter, info, run)
        planned = stored(plan(spark, ledger, mine(), size, tries).join(split.select("key").distinct(), "key", "left_semi"), "planned")
        pages = split.join(intervals.pages_of(planned, "key"), ["key", "page_no"])
    pages = pages.select("key", "page_no", "body", "start_page")
    convert_due(spark, ledger, pages, planned, planned.count(), converter, mode, limits, run)

    ranges = stored(intervals.kept_ranges(checkpoint.live_chunks(spark, ledger.chunks).join(keys, "key", "left_semi"), "key"), "ranges")
    chunks = assembled(spark, ledger, ranges)
    sizes = ranges.groupBy("key").agg(F.count("*").alias("n_chunks"), F.sum(F.col("end_page") - F.col("start_page")).alias("_have"))
    place = F.col("start_page")
    tops = chunks.groupBy("key").agg(assemble.first_metadata(F.col("meta"), place).alias("meta"), F.min_by(memo.prompt_of(F.col("text")), place).alias("head"))
    heads = sizes.join(tops, "key").join(mine().drop("cause", "run"), "key")
    heads = batch.select(F.col("digest").alias("key"), "raw_input", "input_ord").join(heads, "key")
    heads = stored(heads, "heads") if ask else heads  # the prompts are read several times
    books = named_books(heads, ask, ledger.replies, **(asking or {}))
    text_of = lambda c: F.to_json(F.col(c))
    meta = sinks.metadata_json(
        total_pages_processed=F.col("n_pages"), n_chunks=F.col("n_chunks"), naming=F.col("tier"), parsed_info=text_of("bib"), source_info=text_of("info"), source_meta=F.col("meta")
    )
    wanted = stored(books.select("folder", "key", "input_ord", "n_chunks", meta.alias("metadata")), "wanted")
    rows = stored(identity.own_folders(wanted, "folder", "key", "input_ord"), "books")
    publish_books(spark, chunks, rows, output, run)

    # an input's folder is the one that its content got among those of its wish
    own = wanted.select("input_ord", "key", F.col("folder").alias("_wish"))
    got = rows.select("key", "folder")
    folders = own.join(got, "key").where((F.col("folder") == F.col("_wish")) | (F.col("folder") == F.concat("_wish", F.lit("_"), F.substring("key", 1, 8)))).select("input_ord", "folder")
    problems = attempts.last_cause(attempts_so_far(spark, ledger).join(keys, "key", "left_semi"))
    lacking = sizes.join(mine().select("key", "n_pages"), "key").select("key", (F.col("n_pages") - F.col("_have")).cast("int").alias("missing_pages"))
    result = stored(report(batch, folders, problems, lacking, output, len(inputs)), "report")
    if purge:
        checkpoint.forget(spark, rows.select("key"), ledger.chunks)
    discard(due, planned, ranges, wanted, rows, batch, *([heads] if ask else []))
    return result
