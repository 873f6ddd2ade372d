"""Naming rules: sanitized keys, chunk tags, image names, output folders, letter case."""

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.patterns import EDGES, EXTENSION, NOT_NAME, RUNS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null reads as the empty string, which means "missing" everywhere here."""
    return F.coalesce(_c(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Unicode white space removed at both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(_c(c), EDGES, "")


def _capital(letter: str) -> str:
    """One letter: the title case where the capital is several (ᾳ: ᾼ), the letter itself where that is too (ﬁ)."""
    return "ẞ" if letter == "ß" else next((x for x in (letter.upper(), letter.title()) if len(x) == 1), letter)


@cache
def _letters() -> dict[str, tuple[str, str]]:
    """Letters and what stands for them in ``upper`` and ``lower``; none is beyond U+1FFFF."""
    all_ = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    both = {"upper": _capital, "lower": lambda x: x.lower()[0]}
    return {k: tuple(map("".join, zip(*[(x, f(x)) for x in all_ if f(x) != x], strict=True))) for k, f in both.items()}


def upper(c: Column | str) -> Column:
    """Letter by letter, so that the length stays (``F.upper`` makes SS of ß)."""
    return F.translate(_c(c), *_letters()["upper"])


def lower(c: Column | str) -> Column:
    """Letter by letter, whatever stands beside it (``F.lower`` ends words with ς, and makes two characters of İ)."""
    return F.translate(_c(c), *_letters()["lower"])


def sanitize(c: Column | str) -> Column:
    """Delete what is no word character, space or hyphen; strip; join runs by ``_``."""
    return F.regexp_replace(strip(F.regexp_replace(blank(c), NOT_NAME, "")), RUNS, "_")


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(blank(c), "([^/]*)$", 1)


def stem(c: Column | str) -> Column:
    """The last path part without its last extension; leading dots belong to the name."""
    return F.regexp_replace(base_name(c), EXTENSION, "$1")


def input_key(c: Column | str) -> Column:
    return F.coalesce(F.nullif(sanitize(stem(c)), F.lit("")), F.lit("untitled_input"))


def is_object_uri(c: Column | str) -> Column:
    return F.startswith(blank(c), F.lit("gs://"))


def chunk_tag(start: Column | str, end: Column | str) -> Column:
    """Zero-padded to five digits at least; longer numbers stay whole."""
    return F.format_string("%05d_%05d", _c(start), _c(end))


def image_name(page: Column | str, key: Column | str) -> Column:
    return F.concat(F.lit("pg_"), _c(page).cast("string"), F.lit("_"), _c(key))


def _last_word(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(strip(c), "[ \\t-\\r]+"), F.lit(-1)), F.lit(""))


def last_name(author: Column | str) -> Column:
    """``Last, First`` and ``First Last`` of the first author; none before the comma: UnknownAuthor."""
    first = F.split_part(F.split_part(blank(author), F.lit(","), F.lit(1)), F.lit(" and "), F.lit(1))
    return F.when(strip(first) == "", F.lit("UnknownAuthor")).otherwise(sanitize(_last_word(first)))


def legacy_last_name(author: Column | str) -> Column:
    """The older rule: the last word after the last comma."""
    tail = F.split_part(blank(author), F.lit(","), F.lit(-1))
    return F.when(strip(blank(author)) == "", F.lit("UnknownAuthor")).otherwise(sanitize(_last_word(tail)))


def output_name(title: Column, author: Column, year: Column, fallback: Column, descriptive: Column) -> Column:
    """``Last_Title_Year``; without descriptive fields the file stem serves."""
    named = F.concat_ws(
        "_",
        last_name(author),
        F.coalesce(F.nullif(sanitize(title), F.lit("")), sanitize(fallback)),
        F.coalesce(F.nullif(blank(year), F.lit("")), F.lit("0000")),
    )
    plain = F.coalesce(F.nullif(sanitize(fallback), F.lit("")), F.lit("converted_textbook"))
    return F.when(descriptive, named).otherwise(plain)


def destination(output: Column | str, folder: Column | str) -> Column:
    return F.concat(F.regexp_replace(_c(output), "/+$", ""), F.lit("/"), _c(folder))


def region_of_zone(zone: Column | str) -> Column:
    return F.regexp_replace(_c(zone), "-[^-]*$", "")


def duration_text(seconds: Column | str) -> Column:
    s = _c(seconds).cast("long")
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def session_ids(listing: Column | str) -> Column:
    return F.regexp_extract_all(_c(listing), F.lit("([a-f0-9]{6,8})"), F.lit(1))


def session_of_message(message: Column | str) -> Column:
    return F.regexp_extract(_c(message), "session '([a-f0-9]+)'", 1)


def nothing_to_replace(stderr: Column | str) -> Column:
    """A failed delete that only says there was nothing to delete."""
    return F.lower(blank(stderr)).rlike("not found|no urls matched|no matches")


def cache_dir(path: Column | str) -> Column:
    return F.concat(stem(path), F.lit("_extracted_cache"))
