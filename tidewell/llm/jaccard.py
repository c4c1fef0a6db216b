"""Exact Jaccard join of documents over five-word shingles, as a metric-space join.

Jaccard distances between unrelated documents are all 1, where no window of the triangle inequality separates anything. So the
outermost regions are not cells of global pivots but of an inverted index: of a set of n shingles, in any fixed order, the
first n - ceil(0.75 n) + 1 must hold one that a linked set also has among its first, and documents that share such a shingle
form a region, where distances are graded. Inside regions, pivots, Voronoi cells, replication windows and recursion do the rest
(see metricjoin).

The order: shingles are ranked by hash, and those that more than COMMON distinct sets hold move behind the others, so that a
passage or line that many documents share makes no region unless a document has little else. Shingles with the upper
1 - LOW of hashes rank last and are not counted: a document's first shingles hardly ever reach them.

What is exchanged: a row per low shingle and distinct set, once to count (with partial counts before) and once to join the counts,
where a shingle that very many sets hold can be split. Copies are dropped before, by the digests of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packaging import ship
from . import kernel, metricjoin
from .common import KEY_BYTES, broadcast_checked, materialize, release

LOW = 0.45
COMMON = 16
CLASSES = 64
#: Sets of so many shingles get a second sketch of so many classes.
LARGE, WIDE = 600, 1024
_CUT = int(LOW * 2**63)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _text_key() -> Column:
    """A 128-bit digest of the text: with the id it names a row, save for rows that repeat both."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles as non-negative 63-bit numbers."""
    words = kernel.Words(*kernel.bytes_of(part.column("text")), kernel.LOWER)
    values, at = kernel.shingles(words.hashes(), words.at)
    return kernel.sort_distinct(values >> np.uint64(1), at)


def _digests(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw, ends = values.tobytes(), (at * 8).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:], strict=False)]


def _heads(n: np.ndarray) -> np.ndarray:
    """How many shingles a linked set must meet at least one of."""
    return np.where(n > 0, n - -(-n * 3 // 4) + 1, 0)


def set_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, low, digest, sketch, wide): a digest of the text, size of the set, how many of its shingles are low,
    a 128-bit digest of the set and its counts by class of hash, of large sets also by finer classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                values, at = _sets(part)
                below = np.concatenate([[0], np.cumsum(values < _CUT)])[at]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n": pa.array(np.diff(at)), "low": pa.array(np.diff(below)), "digest": pa.array(_digests(values, at), pa.binary()), "sketch": kernel.sketches(values, at, CLASSES), "wide": kernel.sketches(values, at, WIDE, LARGE)}
                )

    ship(docs.sparkSession)
    return _documents(docs).withColumn("text_key", _text_key()).mapInArrow(kernel.lean(run), "doc_id long, text_key binary, n long, low long, digest binary, sketch array<tinyint>, wide array<tinyint>")


def _ranked(keyed: DataFrame) -> DataFrame:
    """(shingle, node, place): each set's low shingles by hash, more only where these are too few. `keyed`: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                values, at = _sets(part)
                n = np.diff(at)
                below = np.concatenate([[0], np.cumsum(values < _CUT)])[at]
                take = np.maximum(np.diff(below), _heads(n))
                place = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
                picked = values[np.repeat(at[:-1], take) + place]
                nodes = part.column("node").take(pa.array(np.repeat(np.arange(len(n)), take)))
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(picked.view(np.int64)), "node": nodes, "place": pa.array(place.astype(np.int32))})

    return keyed.mapInArrow(kernel.lean(run), "shingle long, node long, place int")


def _members(keyed: DataFrame) -> DataFrame:
    """(node, members): the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                values, at = _sets(part)
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "members": kernel.list_array(values, at)})

    return keyed.mapInArrow(kernel.lean(run), "node long, members array<long>")


def _number(digest: str = "digest") -> Column:
    """A negative key for sets whose documents have no id of their own."""
    return -F.pmod(F.xxhash64(digest), F.lit(2**61)) - F.lit(2**61)


def _keyed(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    """(node, text): documents under their id; where it is null or belongs to several texts, under their set's number."""
    rows = _documents(docs)
    if odd is None:
        return rows.select(F.col("doc_id").alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                values, at = _sets(part)
                yield pa.RecordBatch.from_pydict({"text": part.column("text"), "digest": pa.array(_digests(values, at), pa.binary())})

    plain = rows.join(odd, rows["doc_id"].eqNullSafe(odd["odd_id"]), "left_anti").select(F.col("doc_id").alias("node"), "text")
    strange = rows.join(odd, rows["doc_id"].eqNullSafe(odd["odd_id"]), "left_semi").select("text").mapInArrow(kernel.lean(run), "text string, digest binary")
    return plain.union(strange.select(_number().alias("node"), "text"))


def _components(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, text_key, n, and of rows whose set is not empty the component's `root` (a number that no other
    component has) and component_id."""
    sets = materialize(set_digests(docs), "sets")
    odd = sets.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b or doc_id is null").select(F.col("doc_id").alias("odd_id"))
    odd = materialize(odd, "odd-ids")
    if odd.limit(1).count():
        joined = sets.join(odd, sets["doc_id"].eqNullSafe(odd["odd_id"]), "left")
        key = F.when(F.col("doc_id").isNull() | F.col("odd_id").isNotNull(), _number()).otherwise(F.col("doc_id"))
        sets = materialize(joined.withColumn("key", key).drop("odd_id"), "keyed-sets")
    else:
        odd, sets = None, sets.withColumn("key", F.col("doc_id"))
    # One node per set: one of its documents stands for the others.
    reps = sets.filter("n > 0").groupBy("digest", "n", "low").agg(F.max("key").alias("node"), F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    reps = materialize(reps, "representatives")
    others = sets.join(reps.select(F.col("node").alias("key")), "key", "left_anti").select(F.col("key").alias("node")).distinct()
    keyed = _keyed(docs, odd)
    alone = keyed.join(broadcast_checked(materialize(others, "copies"), KEY_BYTES), "node", "left_anti")

    counts = _ranked(alone).groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = materialize(_ranked(alone).join(counts, "shingle"), "shared")
    release(docs.sparkSession)
    rows = shared.join(reps.select("node", "n", "low"), "node")
    heads = F.expr("n - (n * 3 + 3) div 4 + 1")
    by_node = Window.partitionBy("node")
    by_place = by_node.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("common", ((F.col("held") > COMMON) & (F.col("place") < F.col("low"))).cast("int"))
    rows = rows.withColumn("before", F.coalesce(F.sum("common").over(by_place), F.lit(0))).withColumn("commons", F.sum("common").over(by_node))
    rank = F.when(F.col("place") >= F.col("low"), F.col("place")).when(F.col("common") == 1, F.col("low") - F.col("commons") + F.col("before")).otherwise(F.col("place") - F.col("before"))
    rows = materialize(rows.filter(rank < heads).select(F.col("shingle").alias("region"), "node", (F.col("commons") / F.col("n")).alias("weight")), "prefixes")
    release(docs.sparkSession)
    weights = rows.groupBy("node").agg(F.max("weight").alias("weight"))
    nodes = materialize(reps.select("node", "n", "sketch", "wide").join(weights, "node"), "nodes")

    def fetch(asked: DataFrame) -> DataFrame:
        return _members(keyed.join(broadcast_checked(asked, KEY_BYTES), "node", "left_semi")).dropDuplicates(["node"])

    roots = metricjoin.link(rows.select("region", "node"), nodes, fetch)
    labels = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(labels.join(least, "root").select("digest", "root", "component_id"), "labels")
    return sets.select("doc_id", "text_key", "n", "digest").join(labels, "digest", "left").drop("digest")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles and component_id: the smallest doc_id reachable by links, itself included.

    A null or empty text has an empty set and links with nothing; equal texts and repeated rows have one set and link with
    each other unless it is empty; rows with a null doc_id take part, and their component is that of the smallest id
    reachable (null if there is none); rows that share an id but not the text are joined each by its own text; an empty
    table gives an empty result. Other columns are not read.
    """
    out = _components(docs)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of `docs` of each component: of the rows with the smallest id (null ids come last) that with the smallest
    digest of the text, of equal ones the first by the digest of all columns. Rows with empty sets link with nothing and all stay.
    """
    found = materialize(_components(docs).filter("n > 0").select("doc_id", "text_key", "root"), "rows")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    equal = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("equal"))
    best = equal.groupBy("root").agg(F.min(F.struct(*[row[x].alias(x) for x in ("unnamed", "doc_id", "text_key")], "equal")).alias("best"))
    best = materialize(best.select(F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__text"), F.col("best.equal").alias("__equal")), "kept")

    key = _text_key()
    same = docs["doc_id"].cast("long").eqNullSafe(best["__id"]) & (key == best["__text"])
    out = docs.join(broadcast_checked(best.filter("__equal = 1"), 64), same, "left_semi")
    empty = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    out = out.union(empty)
    often = best.filter("__equal > 1")
    if often.limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        rows = docs.join(broadcast_checked(often, 64), same).groupBy("__id", "__text").agg(F.min_by(F.struct(*columns), F.sha2(F.to_json(F.struct(*columns)), 256)).alias("row"))
        out = out.union(rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
    return out
