"""Language ID by rank-order profiles (out-of-place distance of frequent n-grams).

Null texts and texts without a letter are ``und`` with score 0, as is every text
where nothing could be learned. Ties between languages go to the first by name.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, batch, binaries, free, raw_text, without

PROFILE = 400
ORDERS = (1, 2, 3)
SPACE = 1
#: Labels that a column of languages may have.
MAX_LANGUAGES = 1000
#: n-grams that a training task holds before it hands its counts on.
HOLD = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, ascending, and their counts. Runs of other
    characters read as one space; an n-gram of code points is one integer."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where(letter_table()[points], points, SPACE).astype(np.int64)
    a = np.concatenate([[SPACE], a, [SPACE]])
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != SPACE) | (a[:-1] != SPACE)
    a = a[keep]
    if len(a) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    return np.unique(np.concatenate([a[a != SPACE], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent, by count, then by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def count_by_lang(batches):
    """Arrow batches of (lang, raw) → (lang, gram, n), summed within the task."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = defaultdict(list)
    size = 0

    def flush():
        for lang, parts in held.items():
            g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield batch(schema, [[lang] * len(g), g, n])
        held.clear()

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), binaries(b["raw"]), strict=True):
            g, n = ngrams(text)
            if len(g):
                held[lang].append((g, n))
                size += len(g)
            if size > HOLD:
                yield from flush()
                size = 0
    yield from flush()


def train(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """docs (text, lang) → profile of each language: its ``size`` most frequent n-grams.

    Counts cover all documents given; a row that stands twice counts twice, and null texts and
    labels are left out. The driver gets ``size`` rows a language, of MAX_LANGUAGES at most: a
    column with more labels is no column of languages, and an error.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", raw_text().alias("raw"))
    counts = rows.transform(arrow(count_by_lang, "lang string, gram long, n long"))
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    found: dict[str, list] = defaultdict(list)
    rows = top.select("lang", "gram", "r").limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for r in rows:
        found[r.lang].append((r.r, r.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(found.items())}


class Ranker:
    """All profiles in one table: n-gram to its rank in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.rank = np.full((len(self.grams) + 1, len(profiles)), -1, np.int32)
        for k, p in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.grams, p), k] = np.arange(len(p))

    def predict(self, text: bytes) -> tuple[str, float]:
        """Score: 1 less the mean distance of an n-gram, as a part of the largest one."""
        top = ranked(*ngrams(text), self.size)
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = len(self.grams)
        hit = np.zeros(len(top), bool)
        hit[at < len(self.grams)] = self.grams[at[at < len(self.grams)]] == top[at < len(self.grams)]
        rank = self.rank[np.where(hit, at, len(self.grams))]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None]))
        total = away.sum(0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.size * len(top)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """Columns of docs but those named so, then lang_pred and score. The profiles are broadcast:
    ``size`` integers a language. Repeated rows are judged each; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    keep, raw = without(docs, "lang_pred", "score"), free(docs, "_raw")
    schema = docs.select(keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        ranker = Ranker(shared.value, size)
        for b in batches:
            found = [ranker.predict(t) for t in binaries(b[raw])]
            cols = [b[c] for c in keep]
            out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, *out], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, raw_text().alias(raw)).transform(arrow(run, schema))
