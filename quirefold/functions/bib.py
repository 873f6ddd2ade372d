"""Bibliographic inference: document info, text rules, ordered cascade."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.names import blank, strip
from quirefold.functions.patterns import COPYRIGHT, EMPHASIS, HEADING, TAG, YEAR_SIGN, YEAR_WORD

#: Author strings that toolchains leave behind.
GENERIC_AUTHORS = [
    "latex", "tex", "pdftex", "pdflatex", "xelatex", "lualatex",
    "miktex", "texlive", "microsoft word", "writer", "unknown", "",
]
TEXT_WINDOW = 4000
FIELDS = ("title", "author", "year")


def doc_info(title: Column, author: Column, created: Column) -> Column:
    return F.struct(
        blank(strip(title)).alias("title"),
        blank(strip(author)).alias("author"),
        blank(F.year(created).cast("string")).alias("year"),
    )


def descriptive(title: Column, author: Column) -> Column:
    generic = F.lower(strip(blank(author))).isin(GENERIC_AUTHORS)
    return (strip(blank(title)) != "") | ~generic


def heading_title(md: Column) -> Column:
    """The first level 1 or 2 heading in the window, tags and emphasis removed."""
    raw = F.regexp_extract(F.substring(blank(md), 1, TEXT_WINDOW), HEADING, 1)
    return strip(F.regexp_replace(F.regexp_replace(raw, TAG, ""), EMPHASIS, ""))


def copyright_fields(md: Column) -> Column:
    """Year and author of a copyright line, else a bare year."""
    text = F.substring(blank(md), 1, TEXT_WINDOW)
    year, author = F.regexp_extract(text, COPYRIGHT, 1), F.regexp_extract(text, COPYRIGHT, 2)
    sign, word = F.regexp_instr(text, F.lit(YEAR_SIGN)), F.regexp_instr(text, F.lit(YEAR_WORD))
    by_sign, by_word = F.regexp_extract(text, YEAR_SIGN, 1), F.regexp_extract(text, YEAR_WORD, 1)
    bare = F.when((sign > 0) & ((word == 0) | (sign <= word)), by_sign).otherwise(by_word)
    return F.struct(
        F.when(year != "", year).otherwise(bare).alias("year"),
        strip(F.split_part(author, F.lit("\n"), F.lit(1))).alias("author"),
    )


def text_info(md: Column) -> Column:
    c = copyright_fields(md)
    return F.struct(heading_title(md).alias("title"), c["author"].alias("author"), c["year"].alias("year"))


def reply_info(reply: Column) -> Column:
    """Three string fields of a JSON object; other JSON types count as missing."""
    v = F.try_parse_json(reply)

    def field(name: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING"
        return F.when(is_text, strip(F.try_variant_get(v, f"$.{name}", "string"))).otherwise("")

    return F.struct(*[blank(field(k)).alias(k) for k in FIELDS])


def merge(first: Column, second: Column) -> Column:
    """Field by field, the first that is not blank."""
    return F.struct(*[
        F.when(strip(first[k]) != "", first[k]).otherwise(second[k]).alias(k) for k in FIELDS
    ])


def cascade(df: DataFrame, info: str, text: str, reply: str | None = None) -> DataFrame:
    """Adds ``tier`` and ``bib``: document info, then a reply, then text, then the file name.

    A reply that is not descriptive is replaced whole by the text rules, and
    document info that is not descriptive still donates the fields it has.
    """
    i, t = F.col(info), F.col(text)
    use_reply = F.lit(False)
    later = t
    if reply:
        r = F.col(reply)
        use_reply = descriptive(r["title"], r["author"])
        later = F.when(use_reply, r).otherwise(t)
    own = descriptive(i["title"], i["author"])
    bib = F.when(own, i).otherwise(merge(i, later))
    tier = (
        F.when(own, "info")
        .when(use_reply, "reply")
        .when(descriptive(t["title"], t["author"]), "text")
        .otherwise("file")
    )
    return df.withColumn("tier", tier).withColumn("bib", bib)


def with_replies(df: DataFrame, need: Column, text: str, ask: Callable, many: bool = False) -> DataFrame:
    """Calls ``ask`` only for rows that need it: ``when`` would call it for all.

    The filtered branch runs the Python callable in Arrow batches; a failing
    call gives an empty reply, so the text rules take over. With ``many`` the callable gets
    the texts of a batch as a list and returns as many replies; if it fails, the batch has none.
    """
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def one(x):
        try:
            return ask(x)
        except Exception:  # noqa: BLE001  any failure degrades to the text rules
            return None

    def all_of(texts):
        try:
            got = list(ask(texts))
            return got if len(got) == len(texts) else [None] * len(texts)
        except Exception:  # noqa: BLE001
            return [None] * len(texts)

    @pandas_udf("string")
    def replies(s: pd.Series) -> pd.Series:
        return pd.Series(all_of(s.tolist()) if many else [one(x) for x in s], dtype="object")

    asked = df.where(need).withColumn("reply", replies(F.substring(blank(F.col(text)), 1, 6000)))
    return asked.unionByName(df.where(~F.coalesce(need, F.lit(False))).withColumn("reply", F.lit(None).cast("string")))
