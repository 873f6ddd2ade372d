"""Importance resampling towards a target: hashed n-gram gains, and the highest scores drawn exactly.

Every text is read twice: once for the counts of the buckets, once for its weight, which is the sum of
an array of gains over its features. Scores are whole numbers, so a histogram of them is exact: how many documents score
higher is the suffix sum of its counts, which gives the cutoff and the rank that each surviving score begins with.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import ITEM_WORDS, arrow, batch, binaries, raw_text, runs, stored
from quirefold.llm.crc import joined, of_words
from quirefold.llm.spans import Spans

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42


def buckets(words: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of one word, two and three from each word on, and where the longer two stay in one text."""
    size = words.end - words.start
    one = of_words(words.bytes, words.start, words.end)
    two = joined(one[:-1], one[1:], size[1:])
    three = joined(two[:-1], one[2:], size[2:])
    m = np.uint32(BUCKETS)
    return one % m, two % m, three % m, words.owner[:-1] == words.owner[1:], words.owner[:-2] == words.owner[2:]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """docs (text) → features in each bucket, over all rows. A task sends a row a bucket, the driver gets BUCKETS sums."""
    kinds = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            texts = binaries(b["raw"])
            for lo, hi in runs(texts):
                one, two, three, in_two, in_three = buckets(Spans(texts[lo:hi], ITEM_WORDS))
                for x in (one, two[in_two], three[in_three]):
                    total += np.bincount(x, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield batch(kinds, [some.astype(np.int32), total[some]])

    rows = docs.select(raw_text().alias("raw")).transform(arrow(run, "bucket int, n long"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = [(b + 1.0) * s / ((a + 1.0) * t) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id) -> F.Column:
    """Gumbel noise in thousandths, by the hash of the id."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs (doc_id, text) → doc_id, n_words, n_features, weight, score. The gains are broadcast: BUCKETS numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = docs.select("doc_id").withColumns({k: F.lit(0).cast("long") for k in ("n_words", "n_features", "weight")}).schema

    def run(batches):
        gain = shared.value
        for b in batches:
            texts = binaries(b["raw"])
            n, weight = [], []
            for lo, hi in runs(texts):
                words = Spans(texts[lo:hi], ITEM_WORDS)
                one, two, three, in_two, in_three = buckets(words)
                own = gain[one]
                own[: len(two)] += np.where(in_two, gain[two], 0)
                own[: len(three)] += np.where(in_three, gain[three], 0)
                total = np.concatenate([[0], np.cumsum(own)])
                weight.append(total[words.first[1:]] - total[words.first[:-1]])
                n.append(np.diff(words.first))
            n, weight = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (n, weight))
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", raw_text().alias("raw")).transform(arrow(run, schema))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def suffix_counts(histogram: DataFrame) -> DataFrame:
    """histogram (score, n), a row a score → with ``above``: the sum of n over all higher scores.

    Ranges of scores are stored sorted; each adds up its own rows, after the sum of the ranges above it (a row each).
    """
    high = F.desc("score")
    ranges = stored(histogram.repartitionByRange(high).sortWithinPartitions(high).withColumn("range", F.spark_partition_id()), "histogram")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("range").orderBy(high).rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = ranges.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inner.join(F.broadcast(first), "range").select("score", "n", (F.col("first") + F.col("inner")).alias("above"))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Stored rows (doc_id, n_words, score, …) with ``rank``: 1, 2, 3… for the highest scores among those of enough words,
    floor(percent * N / 100) of N; null for all others. Ties go to the smaller doc_id, a null one first. Rows that are
    equal are numbered from their count, so that no task sorts the copies."""
    enough = F.col("n_words") >= min_words
    above = suffix_counts(scored.where(enough).groupBy("score").agg(F.count("*").alias("n")))
    total = above.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    n = percent * total // 100
    cutoff = above.where(F.col("above") < n).agg(F.min("score").alias("s")).first().s
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = enough & (F.col("score") >= cutoff)
    copies = scored.where(high).groupBy(*scored.columns).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy("doc_id", *[c for c in scored.columns if c not in ("doc_id", "score")])
    first = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = copies.withColumn("first", first).join(above.where(F.col("above") < n).select("score", "above"), "score")
    each = placed.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.col("above") + F.col("first") + F.col("i")
    drawn = each.select(*scored.columns, F.when(rank <= n, rank).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) and target (text) → doc_id, n_words, n_features, weight, score, rank: one row a row of docs.

    Null and empty texts have no features, weight 0 and are never drawn; a null id has the noise of an empty one. Rows
    that stand twice count twice, in the counts and in the draw. A text of any length is weighed whole.
    An empty table gives no rows, an empty target is a uniform one. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    gain = gains(bucket_counts(docs), bucket_counts(target.select("text")))
    return draw(stored(weigh(docs, gain), "scores"), percent)
