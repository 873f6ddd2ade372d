"""Helpers for long documents. The rules of the five tools are this library's own."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.names import lower, strip

LONG_PAGES = 30
SAMPLE = 200
TOC_WORDS = "(?i)contents|chapter|index"


def route(pages: Column, has_chapters: Column) -> Column:
    return F.when(pages <= LONG_PAGES, "direct").when(has_chapters, "chapter_file").otherwise("page_blocks")


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    return pages.where(F.col("page_no") < n)


def toc_scan(pages: DataFrame, words: str = TOC_WORDS, n: int = LONG_PAGES) -> DataFrame:
    return first_pages(pages, n).where(F.col("body").rlike(words))


def text_layer(pages: DataFrame, key: str) -> DataFrame:
    """Per book: has it searchable text, the first page that has some, and how that begins."""
    text = strip(F.coalesce("body", F.lit("")))
    some = text != ""
    first = F.when(some, F.col("page_no"))
    return pages.groupBy(key).agg(
        F.coalesce(F.bool_or(some), F.lit(False)).alias("searchable"),
        F.min(first).cast("long").alias("first_text_page"),
        F.min_by(F.substring(text, 1, SAMPLE), first).alias("sample"),
    )


def outline(md: Column) -> Column:
    """Array of (level, title), one per Markdown heading line."""
    heads = F.regexp_extract_all(md, F.lit(r"(?md)^(#{1,6} .+)$"), F.lit(1))
    return F.transform(
        heads,
        lambda h: F.struct(
            F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.regexp_replace(h, "^#+ ", "").alias("title")
        ),
    )


def split_chapters(pages: DataFrame, key: str, heading: str = r"^#{1,2} ") -> DataFrame:
    """Pages with the number of the chapter they belong to; page windows are per book."""
    w = Window.partitionBy(key).orderBy("page_no")
    return pages.withColumn("chapter_no", F.sum(F.col("body").rlike(heading).cast("int")).over(w).cast("int"))


def chapter_manifest(pages: DataFrame, key: str, heading: str = r"^#{1,2} ") -> DataFrame:
    """One row a chapter: key, chapter_no, title (the first line of its first page), first_page,
    last_page and the text as a piece of its own. Pages before the first heading are chapter 0."""
    at = split_chapters(pages, key, heading)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("body", F.lit("")).alias("t")))), lambda x: x["t"])
    title = F.regexp_replace(F.split_part(F.coalesce(F.min_by("body", "page_no"), F.lit("")), F.lit("\n"), F.lit(1)), "^#+ ", "")
    return at.groupBy(key, "chapter_no").agg(
        title.alias("title"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.concat_ws("\n", parts).alias("text")
    )


def find_chapters(requests: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """requests (request, key, wanted) with the chapters they mean: that number, or a title that has
    the wanted words, whatever their case. Joined by book; a request that finds none has a null chapter."""
    wanted = F.lower(F.trim("wanted"))
    by_number = F.col("chapter_no").cast("string") == wanted
    by_title = (wanted != "") & F.contains(F.lower("title"), wanted)
    hit = requests.join(chapters.select(key, "chapter_no", "title"), key).where(by_number | by_title).select("request", "chapter_no", "title")
    return requests.join(hit, "request", "left").select("request", key, "wanted", "chapter_no", "title")


#: Characters of a gram, and the most edits between what is wanted and a title.
GRAM, MOST_EDITS = 2, 3


def edits_allowed(wanted: Column) -> Column:
    """One for every four characters, MOST_EDITS at most; then grams that are compared can't all be edited away."""
    return F.least(F.floor(F.length(wanted) / 4), F.lit(MOST_EDITS)).cast("int")


def _grams(text: Column) -> Column:
    """Grams of the text between blanks, each with its number among equal ones."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    all_ = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substring(padded, i, F.lit(GRAM)))
    return F.transform(all_, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(all_, 1, i), lambda x: x == g)).alias("no")))


def _rarest(texts: DataFrame, text: str, frequency: DataFrame, n: Column) -> DataFrame:
    """text, gram, no: the n + 1 rarest grams of each text times GRAM, one order for all texts."""
    rows = texts.select(text, n.alias("_n"), F.inline(_grams(F.col(text)))).join(frequency, ["gram", "no"], "left")
    order = Window.partitionBy(text).orderBy(F.coalesce("f", F.lit(0)), "gram", "no")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_n") * GRAM + 1).select(text, "gram", "no")


def _bytes(text: str) -> Column:
    """A character for each byte of the text's UTF-8 form."""
    return F.decode(F.col(text).cast("binary"), "ISO-8859-1")


def nearest_titles(requests: DataFrame, titles: DataFrame, wanted: str, title: str, n: int = 3, in_bytes: bool = False) -> DataFrame:
    """requests (…, wanted) and titles (title) → requests' rows with near titles: title, distance, rank (from 1, ties by title),
    n at most; a request that finds none has none.

    Case, letter by letter, and white space at the ends don't count. An edit is of a character, or ``in_bytes`` of a byte in UTF-8; as
    many edits of bytes change no more characters than that, so candidates are the same. Exact for up to ``edits_allowed`` edits: two
    texts that near share one of their rarest grams (GRAM for each edit and one more), so only titles that do, and of a length that
    fits, are measured.
    Equal titles, and equal requests, are one before anything is joined.
    """
    low = lambda c: lower(strip(F.coalesce(c, F.lit(""))))
    asked = requests.withColumn("_w", low(F.col(wanted)))
    have = titles.select(low(F.col(title)).alias("_t")).distinct().where("_t <> ''")
    want = asked.select("_w").distinct().where("_w <> ''")
    frequency = have.select(F.inline(_grams(F.col("_t")))).groupBy("gram", "no").agg(F.count("*").alias("f"))
    left = _rarest(want, "_w", frequency, edits_allowed(F.col("_w")))
    right = _rarest(have, "_t", frequency, F.lit(MOST_EDITS))
    k = edits_allowed(F.col("_w"))
    pairs = left.join(right, ["gram", "no"]).where(F.abs(F.length("_w") - F.length("_t")) <= k).select("_w", "_t").distinct()
    measured = (_bytes("_w"), _bytes("_t")) if in_bytes else ("_w", "_t")
    found = pairs.withColumn("distance", F.levenshtein(*measured, MOST_EDITS)).where((F.col("distance") >= 0) & (F.col("distance") <= k))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("_w").orderBy("distance", "_t"))).where(F.col("rank") <= n)
    return asked.join(best, "_w").select(*requests.columns, F.col("_t").alias("title"), "distance", "rank")


def compare_extractors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    same = F.col("a.body").eqNullSafe(F.col("b.body"))
    return a.alias("a").join(b.alias("b"), [key, "page_no"], "full_outer").select(key, "page_no", same.alias("same"))


def formula_links(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(r"!\[Mathematical Formula Reference\]\((\./formulas/math_page_\d+\.png)\)"), F.lit(1))
