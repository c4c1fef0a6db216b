"""Catalogs of sessions and topics: rollups with status precedence, listings by keyset, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cuts import cut
from ..sources.tables import read


def session_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as catalog rows of sessions."""
    o, k = read(spark, folder, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.col("o_orderpriority").alias("scope"),
        (F.col("o_custkey") % 200).alias("topic"),
        F.rint(F.col("o_totalprice") / 1000).cast("long").alias("turns"),
        F.when(k % 29 == 0, "corrupt").when(k % 31 == 0, "unknown").otherwise("valid").alias("turns_state"),
        (k % 4 == 0).alias("recovered"),
        F.when(k % 12 == 0, "preferred").when(k % 12 == 4, "diverged").when(k % 12 == 8, "covered_copy").otherwise("").alias("role"),
        F.when(k % 37 == 0, "corrupt").when(k % 41 == 0, "missing").otherwise("ok").alias("health"),
        F.col("o_orderdate").alias("activity"),
    )


def topics(rows: DataFrame) -> DataFrame:
    """Per scope and topic: turns (the normal ones' sum or the longest recovered one, whichever is more), states and health by
    precedence, the last activity. Covered copies only count for recency."""
    own = F.col("role") != "covered_copy"
    valid = F.col("turns_state") == "valid"
    some = lambda test: F.count_if(test) > 0
    turns = F.greatest(F.sum(F.when(~F.col("recovered") & valid, F.col("turns")).otherwise(0)), F.max(F.when(F.col("recovered") & own & valid, F.col("turns")).otherwise(0)))
    role = lambda r: some(F.col("recovered") & (F.col("role") == r))
    return rows.groupBy("scope", "topic").agg(
        turns.alias("turns"),
        F.when(some(own & (F.col("turns_state") == "corrupt")), "corrupt").when(some(own & (F.col("turns_state") == "unknown")), "unknown").otherwise("valid").alias("turns_state"),
        F.max("activity").alias("activity"),
        F.when(role("preferred"), "preferred").when(role("diverged"), "diverged").when(~some(own), "recovery_only").otherwise("").alias("recovery"),
        F.when(some(own & (F.col("health") == "corrupt")), "corrupt").when(some(own & (F.col("health") == "missing")), "missing").otherwise("ok").alias("health"),
    )


def page(rows: DataFrame, size: int, after: tuple[bool, str, int] | None = None) -> DataFrame:
    """The next page in the order pinned first, latest activity, id: the rows after a key, so pages neither skip nor repeat."""
    if after:
        pinned, activity, key = F.lit(after[0]), F.lit(after[1]).cast("timestamp_ntz"), F.lit(after[2])
        same = F.col("pinned") == pinned
        later = (pinned & ~F.col("pinned")) | (same & ((F.col("activity") < activity) | ((F.col("activity") == activity) & (F.col("id") > key))))
        rows = rows.filter(later)
    return rows.orderBy(F.desc("pinned"), F.desc("activity"), "id").limit(size)


def preferred(rows: DataFrame) -> DataFrame:
    """The leaf of each topic's recovered sessions: by role, turns, activity, id."""
    rank = F.when(F.col("role") == "preferred", 2).otherwise(1)
    order = Window.partitionBy("topic").orderBy(F.desc(rank), F.desc("turns"), F.desc("activity"), "id")
    return rows.filter("recovered").withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")


def lineage(rows: DataFrame, most: int) -> DataFrame:
    """(id, root, depth) of sessions (id, parent) by following parents at most `most` times; cycles end there. Each step is a join of the
    sessions reached last with their children, cut by a checkpoint, for any number of rows."""
    children = cut(rows.filter("parent is not null").select(F.col("id").alias("child"), F.col("parent").alias("id")))
    last = cut(rows.filter("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth")))
    out = last
    for depth in range(1, most + 1):
        last = cut(last.join(children, "id").select(F.col("child").alias("id"), "root", F.lit(depth).alias("depth")))
        if last.isEmpty():
            break
        out = out.unionAll(last)
    return out


def covers(leaf: str, copy: str):
    """Whether the message hashes of `copy` are a prefix of those of `leaf`."""
    return F.slice(F.col(leaf), F.lit(1), F.size(copy)) == F.col(copy)


def missing_sources(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Known paths that the current listing lacks."""
    return known.join(listing.select("path"), "path", "left_anti")
