"""Sharding over fixed virtual slots.

A record's slot is a hash of its id and never changes. A versioned map sends each
slot to a shard; rebalancing edits the map, so only the rows of the moved slots
move. The map has ``n_slots`` rows whatever the data's size, so the driver holds
and broadcasts it.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.llm.common import scratch, stored

N_SLOTS = 4096
#: Parts that the rows of a slot are numbered in.
PARTS = 16
ROW_BYTES = 8
MAP = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("long")


def virtual_slot(n_slots: int = N_SLOTS) -> Column:
    """Rows without an id are dealt by their text, so that they don't share one slot."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return F.pmod(key, F.lit(n_slots)).cast("int")


def slot_sizes(docs: DataFrame, n_slots: int = N_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot, summed on the map side before the shuffle."""
    found = docs.groupBy(virtual_slot(n_slots).alias("s")).agg(
        F.sum(record_size()).alias("b"), F.count("*").alias("n")
    ).collect()
    size, rows = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    for r in found:
        size[r.s], rows[r.s] = r.b, r.n
    return size, rows


def even_map(n_slots: int, n_shards: int) -> np.ndarray:
    return np.arange(n_slots) % n_shards


def rebalance(shard_of: np.ndarray, size: np.ndarray, n_shards: int, tolerance: float = 0.001) -> np.ndarray:
    """Edits a map until the fullest and the emptiest shard differ by ``tolerance`` of the
    mean, or no move or swap between these two brings them nearer. Slots of a shard
    number that is gone go to the emptiest shards first."""
    out = shard_of.copy()
    load = np.zeros(n_shards, np.int64)
    np.add.at(load, out[out < n_shards], size[out < n_shards])
    for s in sorted(np.flatnonzero(out >= n_shards), key=lambda s: -size[s]):
        out[s] = load.argmin()
        load[out[s]] += size[s]
    mean = max(1, size.sum() / n_shards)
    for _ in range(4 * len(out)):
        hi, lo = load.argmax(), load.argmin()
        gap = load[hi] - load[lo]
        if gap <= tolerance * mean:
            break
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        b = b[np.argsort(size[b], kind="stable")]
        # the smaller side may give nothing: then it is a move, else a swap
        other = np.concatenate([[0], size[b]])
        want = size[a] - gap / 2
        k = np.clip(np.searchsorted(other, want), 1, len(other)) - 1
        best = None
        for kk in (k, np.minimum(k + 1, len(other) - 1)):
            left = np.abs(size[a] - other[kk] - gap / 2)
            i = int(left.argmin())
            delta = size[a[i]] - other[kk[i]]
            if 0 < delta < gap and (best is None or left[i] < best[0]):
                best = (left[i], a[i], kk[i], delta)
        if best is None:
            break
        _, x, j, delta = best
        out[x] = lo
        if j:
            out[b[j - 1]] = hi
        load[hi] -= delta
        load[lo] += delta
    return out


def write_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray, size: np.ndarray, rows: np.ndarray) -> None:
    """Appends a version; older ones stay readable."""
    table = [(version, i, int(s), int(size[i]), int(rows[i])) for i, s in enumerate(shard_of)]
    spark.createDataFrame(table, MAP).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map; by default the last."""
    maps = spark.read.schema(MAP).parquet(path)
    v = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == v)


def assign(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, gapless from 0), virtual_slot.

    The narrow rows are stored once with the part of the table that they were in. A row's
    place is its number within its slot and part, after the rows of the slots and parts before; so
    rows of one id, or equal ones, are numbered in PARTS tasks, and text isn't shuffled.
    """
    at = F.monotonically_increasing_id()
    rows = docs.select(
        "doc_id", record_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(n_slots).alias("virtual_slot"), at.alias("at"),
    )
    # rows of one file partition spread over the parts, whatever the number of partitions
    part = F.pmod(F.shiftright("at", 33) + F.col("at"), F.lit(PARTS)).cast("int")
    rows = stored(rows, "sizes").withColumn("part", part)
    counts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "at")
    return (
        rows.withColumn("i", F.row_number().over(inner))
        .join(F.broadcast(places), ["virtual_slot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("i") - 1).cast("long").alias("slot"), "virtual_slot",
        )
    )


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Version 1 deals slots evenly; version 2 is that map rebalanced by bytes.

    Null texts count as empty. An empty table gives no rows. Repeated rows share a virtual slot;
    their places follow the table's order.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "slot-map")
    size, rows = slot_sizes(docs, n_slots)
    first = even_map(n_slots, n_shards)
    write_map(spark, path, 1, first, size, rows)
    write_map(spark, path, 2, rebalance(first, size, n_shards), size, rows)
    return assign(docs, read_map(spark, path), n_slots)
