"""Connected components by contraction: each round hands a graph of fewer nodes on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), either direction, → node, label: one node of its component.

    In a round each node that has a lesser neighbour moves to the least of them, and the edges
    between nodes that differ after that are the next round's. Nodes should be digests, so
    that runs of descending neighbours stay short: then a share of the nodes goes in each round,
    and all rounds together read little more than the first. At the end every node follows the moves
    of all rounds, one join a round. Neighbours are aggregated before each shuffle; nothing
    is collected but whether edges are left. Loops give their node itself; no edges, no rows.
    """
    rest = first = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves = []
    while True:
        up = stored(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "moves")
        moves.append(up)
        moved = rest
        for end in "ab":
            to = up.where("up < node").select(F.col("node").alias(end), F.col("up").alias("to"))
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = stored(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if rest is not first:
            discard(rest)
        if left.isEmpty():
            break
        rest = left
    labels = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    for up in moves:
        to = up.where("up < node").select(F.col("node").alias("label"), F.col("up").alias("to"))
        labels = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = stored(labels, "labels")
    discard(first, left, *moves)
    return out
