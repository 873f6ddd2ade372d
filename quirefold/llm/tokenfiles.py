"""Token files: documents in ascending id order, as blocks of the range coder.

A file is Parquet with one row a block: the range partition it is of, its number
there, its first document's offset in the partition, and the block's bytes. A lost
task writes its partition again; nothing is kept outside the shared folder.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import arrow, batch, binaries, raw_text, runs
from quirefold.llm.rangecoder import BLOCK_TOKENS, crc, read_block, write_block
from quirefold.llm.tokens import encoder

FILE = "part int, block int, n_docs long, n_tokens long, before long, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """docs (doc_id, text): ids of each whole text, then ``end_id``.

    Null texts count as empty. Null ids come first; rows with one id follow the hash of
    their text. A block holds whole documents and closes at ``block_tokens`` ids, so a
    task's memory is bounded by that and by its longest document. An empty table gives an empty file.
    """
    rows = docs.select("doc_id", raw_text().alias("raw")).withColumn("h", F.xxhash64("raw"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        vocabulary = max(enc.vocabulary, end_id + 1)
        end = np.array([end_id], enc.kind)
        ids, names, number, before = [], [], 0, 0

        def close():
            flat = np.concatenate([x for pair in ids for x in (pair, end)])
            block = write_block(names, [len(x) + 1 for x in ids], flat, vocabulary)
            return batch(kinds, [[part], [number], [len(names)], [len(flat)], [before], [block]]), len(flat)

        size = 0
        for b in batches:
            doc_ids, texts = b["doc_id"].to_pylist(), binaries(b["raw"])
            for lo, hi in runs(texts, 1 << 19):
                for d, x in zip(doc_ids[lo:hi], enc.ids(texts[lo:hi]), strict=True):
                    names.append(d)
                    ids.append(x)
                    size += len(x) + 1
                    if size >= block_tokens:
                        out, n = close()
                        yield out
                        number, before, size = number + 1, before + n, 0
                        ids, names = [], []
        if names:
            yield close()[0]

    ordered.select("doc_id", "raw").transform(arrow(run, FILE)).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, and if asked ``ids`` as bytes of u32.

    A block with a wrong checksum is an error. A document's start is its offset in its
    partition plus the ids of all partitions before; those sums are one row a partition.
    """
    files = spark.read.schema(FILE).parquet(path)
    kinds = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches):
        for b in batches:
            for part, before, payload in zip(b["part"].to_pylist(), b["before"].to_pylist(), b["payload"].to_pylist(), strict=True):
                names, sizes, ids = read_block(payload)
                ids = np.ascontiguousarray(ids, "<u4")
                end = np.cumsum(sizes)
                start = end - sizes
                pieces = [ids[a:z] for a, z in zip(start, end, strict=True)]
                yield batch(kinds, [[part] * len(names), names, start + before, sizes, [crc(p) for p in pieces]] + [[p.tobytes() for p in pieces]] * with_ids)

    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, sofar = [], 0
    for r in totals:
        base.append((r.part, sofar))
        sofar += r.n
    bases = spark.createDataFrame(base, "part int, base long")
    found = files.select("part", "before", "payload").transform(arrow(run, f"part int, doc_id long, at long, n_tokens long, ids_crc32 long{", ids binary" if with_ids else ""}"))
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
