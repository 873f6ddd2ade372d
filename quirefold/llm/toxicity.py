"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text, hashed to 2**BITS bins. A bin's
feature value is its log-count ratio between toxic and other training texts; a
logistic regression with L2 penalty weighs these values.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, binaries, free, least_hashes, raw_text, without
from quirefold.llm.langid import SPACE, letter_table

ORDERS = (3, 4, 5)
BITS = 20
#: The fit sees at most so many labelled texts of either kind, those of least id hash.
MAX_TOXIC, MAX_OTHER = 3000, 6000
#: Bins that fewer of these texts have are left out of the fit.
LEAST_TEXTS = 4
THRESHOLD = 0.3


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct bins of the whole text. ``seen``: a work array of 2**BITS int32."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where(letter_table()[points], points, np.uint32(SPACE))
    a = np.concatenate([np.array([SPACE], np.uint32), a, np.array([SPACE], np.uint32)])
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != SPACE) | (a[:-1] != SPACE)
    a = a[keep]
    parts, h = [], a.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(a) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + a[n - 1 :]
        if n in ORDERS:
            g = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            g ^= g >> np.uint32(15)
            g *= np.uint32(0xC2B2AE35)
            parts.append(g >> np.uint32(32 - BITS))
    if not parts:
        return np.empty(0, np.uint32)
    f = np.concatenate(parts)
    order = np.arange(len(f), dtype=np.int32)
    seen[f] = order
    return f[seen[f] == order]


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, epochs: int = 8, least_steps: int = 500, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """rows: the features of each text → weights by bin (ratio times coefficient) and the intercept,
    shifted to ``prior``.

    Batches have 128 texts; few texts are gone over more often, for ``least_steps`` batches.
    """
    counts = np.zeros((2, 1 << BITS), np.int32)
    for f, y in zip(rows, toxic, strict=True):
        counts[int(y), f] += 1
    used = np.flatnonzero(counts.sum(0) >= LEAST_TEXTS)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    p, q = (counts[1, used] + 1.0) / (n1 + 2), (counts[0, used] + 1.0) / (n0 + 2)
    ratio = np.log(p / q).astype(np.float32)
    at = np.full(1 << BITS, -1, np.int32)
    at[used] = np.arange(len(used))
    rows = [k[k >= 0] for k in (at[f] for f in rows)]
    w = np.full(len(used), 0.05, np.float64)
    b, m, v, mb, vb, step = 0.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0
    order = np.random.default_rng(7)
    parts = max(1, len(rows) // 128)
    for _ in range(max(epochs, -(-least_steps // parts))):
        for part in np.array_split(order.permutation(len(rows)), parts):
            sizes = np.array([len(rows[i]) for i in part])
            idx = np.concatenate([rows[i] for i in part]) if len(part) else np.empty(0, np.int32)
            owner = np.repeat(np.arange(len(part)), sizes)
            z = np.bincount(owner, (w * ratio)[idx], len(part)) + b
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[part]
            g = np.bincount(idx, err[owner], len(used)) * ratio / max(1, len(part)) + l2 * w
            gb = err.mean() if len(part) else 0.0
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= 0.01 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    out = np.zeros(1 << BITS, np.float32)
    out[used] = w * ratio
    shift = np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return out, float(b + shift)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> tuple[np.ndarray, float]:
    """docs (doc_id, text), labels (doc_id, toxic): the rows to learn from.

    A document with several labels counts as toxic if one says so; null labels and null
    texts are left out. The fit is one task on the bounded sample, of which it holds the distinct
    features and not the texts, and gives 4 MB.
    Without labels of both kinds all weights are 0.
    """
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    count = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return np.zeros(1 << BITS, np.float32), 0.0
    h = F.xxhash64("doc_id")
    # a threshold first: no task sorts more than a few rows, and the least n are the same
    picked = [one.where((F.col("y") == y) & least_hashes(h, 2 * n, count[y])).orderBy(h).limit(n) for y, n in ((1, max_toxic), (0, max_other))]
    ids = picked[0].unionByName(picked[1])  # at most max_toxic + max_other rows
    sample = docs.where("text is not null").select("doc_id", raw_text().alias("raw")).join(F.broadcast(ids), "doc_id")
    prior = count[1] / (count[0] + count[1])

    def run(batches):
        rows, seen = [], np.zeros(1 << BITS, np.int32)
        for b in batches:
            for i, t, toxic in zip(b["doc_id"].to_pylist(), binaries(b["raw"]), b["y"].to_pylist(), strict=True):
                rows.append((i, zlib.crc32(t), toxic, features(t, seen)))
        rows.sort(key=lambda r: r[:2])
        w, b0 = fit([r[3] for r in rows], np.array([r[2] for r in rows], np.float64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b0], pa.float64())], names=["w", "b"])

    row = sample.repartition(1).transform(arrow(run, "w binary, b double")).first()
    return np.frombuffer(bytes(row.w), np.float32), row.b


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Columns of docs but those named so, then score and predicted. Null and empty texts get the intercept's score; rows
    that stand twice are scored each; a text of any length is read whole. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, raw = without(docs, "score", "predicted"), free(docs, "_raw")
    schema = docs.select(keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(1)}).schema

    def run(batches):
        w, b0 = shared.value
        seen = np.zeros(1 << BITS, np.int32)
        for b in batches:
            z = np.array([w[features(t, seen)].sum(dtype=np.float64) for t in binaries(b[raw])]) + b0
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in keep], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return docs.select(*keep, raw_text().alias(raw)).transform(arrow(run, schema))
