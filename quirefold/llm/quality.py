"""Quality rules: a threshold table compiled into one projection without user functions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = [
    "the", "and", "of", "to", "in", "that", "is", "with", "a", "be",
    "le", "la", "les", "de", "et", "des", "une", "un", "que", "en", "est",
    "der", "die", "und", "das", "den", "zu", "ist", "ein", "für", "von",
    "el", "los", "las", "y", "del", "por", "con", "se", "una", "no",
]

#: metric, comparison, threshold: a document that a row holds for is rejected.
RULES = [
    ("n_words", "<", 50),
    ("n_words", ">", 1_000_000),
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 15.0),
    ("symbols_per_word", ">", 0.3),
    ("stop_words_per_word", "<", 0.02),
    ("dup_line_ratio", ">", 0.3),
    ("repeat_word_ratio", ">", 0.5),
    ("alpha_ratio", "<", 0.5),
]
WORD = r"[^\x20\x09-\x0D]+"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts. Null counts as a text without words; counts cover the whole text.

    Repeated 3-word windows are found by sorting the 64-bit hashes of a row's own windows, so
    nothing is shuffled and memory is bounded by one text. Empty texts have no word; rows that
    stand twice are measured each.
    """
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_lines", F.size("_l").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_l")))
    chars = F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", ""))
    d = d.withColumn("word_chars", chars.cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_alpha", F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long"))
    d = d.withColumn("n_stop", F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"))
    windows = F.expr(
        "sort_array(transform(if(n_words >= 3, sequence(1, int(n_words) - 2), array()), "
        "i -> struct(xxhash64(_w[i - 1], _w[i], _w[i + 1]) AS g, i AS i)))"
    )
    d = d.withColumn("_s", windows)
    twice = F.expr(
        "sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[greatest(k - 1, 0)].g = x.g) "
        "OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].g = x.g)), x -> x.i))"
    )
    d = d.withColumn("_p", twice)
    cover = F.expr(
        "aggregate(transform(_p, (x, k) -> if(k < size(_p) - 1, least(3, _p[least(k + 1, size(_p) - 1)] - x), 3)), 0L, (a, x) -> a + x)"
    )
    return d.withColumn("n_repeat_words", cover).drop("_t", "_w", "_l", "_s", "_p")


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_words_per_word": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / n,
        "alpha_ratio": F.col("n_alpha") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def compiled(rules=RULES) -> Column:
    """The table as one boolean: is no rule broken?"""
    r = ratios()
    broken = [r[m] < t if op == "<" else r[m] > t for m, op, t in rules]
    return ~reduce(lambda a, b: a | b, broken, F.lit(False))


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs (doc_id, text) → doc_id, the measures, ``base_failed`` and ``kept``; other columns end here. Null and empty texts have no
    words and fail; rows that stand twice are judged each; a text of any length is read whole. An empty table gives no rows."""
    d = measures(docs.select("doc_id", text), text).drop(text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))
