"""Merkle fixity audit of web archives: record hashes and ordered offset ranges form a tree per archive file, replicas are
compared at their roots and only mismatching branches are descended.

A range is a fixed stretch of offsets, so a node's inputs are bounded by its stretch, however large a file is, and the tree
of a replica can be built without seeing the other. All of it is DataFrame code; hashing happens map-side, and what is
exchanged is one hash per record and below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RANGE_BYTES = 1 << 16
FANOUT = 8
#: Pages of one archive file when pages are laid out as archives.
ARCHIVE_PAGES = 256
#: Archive files over which pages without an id are spread; negative page ids are not expected.
NULL_ARCHIVES = 4096


def page_records(pages: DataFrame, replica: Column | None = None) -> DataFrame:
    """`pages` laid out as archive files: page_id, archive, offset, length and hash of each record; with `replica` (the page as
    another copy of the archives holds it) also replica_length and replica_hash of the record at the same place.

    A record is the header and the page; files take pages in the order of page_id. Null ids go to NULL_ARCHIVES files of their
    own, by the hash of the record; null urls and pages are empty; repeated rows and ids are records one after the other. The
    body does not pass the exchange that orders records.
    """

    def record(body: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
            F.coalesce(F.col("url"), F.lit("")),
            F.lit("\r\nWARC-Record-ID: <urn:page:"),
            F.coalesce(F.col("page_id").cast("string"), F.lit("")),
            F.lit(">\r\nContent-Length: "),
            F.octet_length(body).cast("string"),
            F.lit("\r\n\r\n"),
            body,
            F.lit("\r\n\r\n"),
        )

    def measured(body: Column, name: str) -> list[Column]:
        r = record(F.coalesce(body, F.lit("")))
        return [F.octet_length(r).cast("long").alias(f"{name}length"), F.sha2(r, 256).alias(f"{name}hash")]

    both = ["replica_length", "replica_hash"] if replica is not None else []
    rows = pages.select("page_id", *measured(F.col("html"), ""), *(measured(replica, "replica_") if both else []))
    nameless = -1 - F.pmod(F.xxhash64("hash"), F.lit(NULL_ARCHIVES))
    rows = rows.withColumn("archive", F.coalesce(F.expr(f"floor(page_id / {ARCHIVE_PAGES}D)").cast("long"), nameless))
    before = Window.partitionBy("archive").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "archive", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "hash", *both)


def _node_hash(order: str, parts: str) -> F.Column:
    """The hash over the children in order; each enters with its place, so a lost child cannot hide behind the next."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(parts).alias("h"))))
    return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["o"].cast("string"), x["h"])), ";"), 256)


def merkle_tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Level 0: ranges of RANGE_BYTES; each further level joins FANOUT neighbours; the last has one root per archive.

    Each level: archive, node, hash. `records`: archive, offset, length, hash; a record belongs to the range it starts in.
    """
    leaf = records.select("archive", F.expr(f"offset div {RANGE_BYTES}").alias("node"), "offset", F.concat_ws("+", F.col("length").cast("string"), "hash").alias("part"))
    tree = [leaf.groupBy("archive", "node").agg(_node_hash("offset", "part").alias("hash"))]
    for _ in range(levels - 1):
        below = tree[-1].select("archive", F.expr(f"node div {FANOUT}").alias("up"), "node", "hash")
        tree.append(below.groupBy("archive", "up").agg(_node_hash("node", "hash").alias("hash")).withColumnRenamed("up", "node"))
    return [materialize(level, "merkle") for level in tree]


def tree_levels(*replicas: DataFrame) -> int:
    """Levels that a tree needs so that the longest archive of any replica has one root."""
    top = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // RANGE_BYTES
    levels = 1
    while top:
        top //= FANOUT
        levels += 1
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one side lacks."""
    both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["archive", "node"], "full_outer")
    return both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("archive", "node")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records on which two replicas disagree: archive, offset and status: corrupt, missing (only in a) or extra (only in b).

    Replicas are tables of archive, offset, length and hash. Archives that one side lacks altogether differ at the root.
    Empty replicas agree. Only children of differing nodes are compared.
    """
    levels = tree_levels(a, b)
    trees = merkle_tree(a, levels), merkle_tree(b, levels)
    wanted = _differing(trees[0][-1], trees[1][-1])
    for level in range(levels - 2, -1, -1):
        wanted = materialize(wanted, "branches").withColumnRenamed("node", "up")
        own = [t[level].withColumn("up", F.expr(f"node div {FANOUT}")).join(wanted, ["archive", "up"], "left_semi").drop("up") for t in trees]
        wanted = _differing(*own)
    wanted = materialize(wanted, "branches")
    at = [r.withColumn("node", F.expr(f"offset div {RANGE_BYTES}")).join(wanted, ["archive", "node"], "left_semi").select("archive", "offset", F.struct("length", "hash").alias(n)) for r, n in ((a, "ra"), (b, "rb"))]
    both = at[0].join(at[1], ["archive", "offset"], "full_outer").filter(~F.col("ra").eqNullSafe(F.col("rb")))
    return both.select("archive", "offset", F.when(F.col("rb").isNull(), "missing").when(F.col("ra").isNull(), "extra").otherwise("corrupt").alias("status"))
