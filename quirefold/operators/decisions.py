"""Decision tables for workspaces: what to create, update, skip or overwrite."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale(local: str, remote: str) -> Column:
    """True also for a repository that is ahead."""
    return (F.col(remote) != "") & (F.col(local) != F.col(remote))


def write_actions(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """desired (path, policy) → action: create, overwrite or keep."""
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    action = (
        F.when(F.col("there").isNull(), "create")
        .when(F.col("policy") == "always", "overwrite")
        .otherwise("keep")
    )
    return desired.join(there, "path", "left").select("path", "policy", action.alias("action"))


def setup_decision(marker: Column, version: str, healthy: Column) -> Column:
    """marker: ``key=value`` lines or null. full, rebuild, skip or fatal."""
    recorded = F.str_to_map(marker, F.lit("\n"), F.lit("="))["setup_version"]
    return (
        F.when(marker.isNull(), "full")
        .when(F.coalesce(recorded, F.lit("none")) != version, "rebuild")
        .when(healthy, "skip")
        .otherwise("fatal")
    )


def sync_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    state = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").otherwise("both")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


#: What a synchronisation does with a key. ``record``: both sides agree already, only the snapshot changes.
ACTIONS = ("none", "record", "copy_right", "copy_left", "delete_right", "delete_left", "conflict")


def sync_three_way(base: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """base (key, digest, deleted) is what both sides held when they were last synchronised, or what a key held before it was
    deleted; left and right (key, digest) are what they hold now → key, ``action``, and ``digest``, ``deleted`` of the next snapshot.

    A side that holds what the snapshot says hasn't moved, and follows the other. A side that still holds a deleted key's old
    content missed the deletion, and one with other content made the key anew. Where both moved, to different contents
    or one away, it is a conflict and the snapshot stays. Keys are unique in each table. One full join of narrow rows.
    """
    b = base.select(key, F.col("digest").alias("_b"), "deleted")
    a, c = left.select(key, F.col("digest").alias("_l")), right.select(key, F.col("digest").alias("_r"))
    rows = b.join(a, key, "full_outer").join(c, key, "full_outer")
    deleted, old, l, r = F.coalesce("deleted", F.lit(False)), F.col("_b"), F.col("_l"), F.col("_r")
    live = F.when(~deleted, old)  # what an unmoved side of a live key holds; null: nothing
    missed = deleted & old.isNotNull()  # then a side with the old content is one that missed the deletion
    still_l, still_r = l.eqNullSafe(live) | (missed & (l == old)), r.eqNullSafe(live) | (missed & (r == old))
    still_l, still_r = F.coalesce(still_l, F.lit(False)), F.coalesce(still_r, F.lit(False))
    gone = missed & (l.eqNullSafe(old) | r.eqNullSafe(old)) & (l.isNull() | r.isNull())
    action = (
        F.when(l.eqNullSafe(r), F.when(l.eqNullSafe(live), "none").otherwise("record"))
        .when(gone, F.when(l.isNull(), "delete_right").otherwise("delete_left"))
        .when(still_l, F.when(r.isNull(), "delete_left").otherwise("copy_left"))
        .when(still_r, F.when(l.isNull(), "delete_right").otherwise("copy_right"))
        .otherwise("conflict")
    )
    rows = rows.withColumn("action", action)
    came = F.when(F.col("action").isin("copy_left"), r).when(F.col("action") == "copy_right", l).when(F.col("action") == "record", l)
    away = F.col("action").isin("delete_left", "delete_right") | ((F.col("action") == "record") & l.isNull())
    kept = F.col("action").isin("none", "conflict")
    return rows.select(key, "action", F.when(kept | away, old).otherwise(came).alias("digest"), F.when(kept, deleted).otherwise(away).alias("deleted"))


#: Paths below a workspace's base folder that it never tracks.
IGNORED_PREFIXES = [
    "academic-hub/01-resources/",
    "research/journal-articles/",
    "research/independent-research/notes/",
    "academic-hub/02-academic-notes-code/",
    "personal-website/",
    "research/independent-research/projects/",
]
IGNORED_NAMES = [".env", ".idea", ".DS_Store", "Thumbs.db"]


def ignored(path: Column, base: str) -> Column:
    """Paths are relative to the workspace; ``base`` is the folder there that has the prefixes."""
    hit = F.endswith(path, F.lit(".log"))
    for p in IGNORED_PREFIXES:
        hit = hit | F.startswith(path, F.lit(f"{base}/{p}"))
    return hit | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_NAMES)))


def mount_fields(spec: Column) -> Column:
    return F.struct(*[F.split_part(spec, F.lit(":"), F.lit(i)).alias(n) for i, n in enumerate(("host", "container", "mode"), 1)])


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")
