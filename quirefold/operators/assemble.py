"""Putting books together: ordered text, first metadata, link rewriting."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.sources.scratch import stored

PLAIN_BREAK = "\n\n"
MARKED_BREAK = "\n\n<!-- CHUNK BREAK -->\n\n"


def ordered_concat(text: Column, order: Column, sep: str = PLAIN_BREAK) -> Column:
    """Aggregate: the texts of a group in order. A group is one book."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.concat_ws(sep, F.transform(pairs, lambda x: x["t"]))


def first_metadata(meta: Column, order: Column) -> Column:
    """Aggregate: the first metadata object with an entry, in order; else null."""
    fields = F.json_object_keys(meta)
    good = F.coalesce(F.size(fields) > 0, F.lit(False))
    return F.min_by(F.when(good, meta), F.when(good, order))


def running_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based number over the whole table in ``order``, without a one-task window.

    The rows are range-partitioned, sorted and stored once with their partition and place; both
    the partitions' counts (one row each) and the numbers come from that table, so they can't
    differ. Ties follow the hash of all columns that have one (maps have none); they spread over
    partitions. Nulls come first. An empty table gives no rows.
    """
    ranked = [F.col(c) for c in order]
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = df.withColumn("__tie", F.xxhash64(*plain))
    ranged = keyed.repartitionByRange(*ranked, "__tie").sortWithinPartitions(*ranked, "__tie").drop("__tie")
    at = F.monotonically_increasing_id()  # partition in the upper 31 bits, place in the lower 33
    rows = stored(ranged.withColumn("__at", at), "ranged").withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "__part").select(*df.columns, number.cast("long").alias(name))


def rewrite_links(text: Column, pairs: Column) -> Column:
    """Every ``old`` of an array of (old, new) structs replaced, in array order."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["old"], p["new"]))


def flatten_images(chunks: DataFrame, links: DataFrame, images: DataFrame, dedupe: bool = False) -> DataFrame:
    """links (chunk_no, pos, link) whose file is in images (chunk_no, link) get global names.

    ``dedupe``: a link named twice in a chunk counts once; otherwise each mention
    takes a number and the first mention's name is the one in the text.
    """
    found = links.join(images.select("chunk_no", "link").distinct(), ["chunk_no", "link"], "left_semi")
    if dedupe:
        found = found.groupBy("chunk_no", "link").agg(F.min("pos").alias("pos"))
    numbered = running_number(found, ["chunk_no", "pos"], "n")
    first = numbered.groupBy("chunk_no", "link").agg(F.min("n").alias("n"))
    pair = F.struct("n", F.col("link").alias("old"), F.format_string("all_graphs/graph_%04d.png", "n").alias("new"))
    pairs = first.groupBy("chunk_no").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    text = F.when(F.col("pairs").isNull(), F.col("md")).otherwise(rewrite_links(F.col("md"), F.col("pairs")))
    return chunks.join(pairs, "chunk_no", "left").select("chunk_no", text.alias("md"))
