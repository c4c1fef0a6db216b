"""Two-pass external shuffle: records are scattered by a seeded hash into memory-sized buckets, each bucket is shuffled by
Fisher-Yates and the buckets, laid end to end, are cut into shards of equal row counts.

Plan: one scan for the total bytes, one scan of the key for the bucket sizes, then a single exchange of the records. The
only global step is a running sum over bucket counts (one small row per bucket). No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize

BUCKET_BYTES = 16 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _ordinals(df: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """Adds `__ordinal`: 0 where no `key` repeats. Equal rows are interchangeable, so repeated rows are counted and dealt
    out again as numbered copies; a row that fills a third of the table thus spreads over all buckets."""
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").limit(1).take(1):
        return df.withColumn("__ordinal", F.lit(0).cast("long")), False
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__ordinal")), True


def external_shuffle(df: DataFrame, shards: int = 16, seed: int = 20_26, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of `df` in a random order, cut into shards; adds `shard` (int) and `slot` (long).

    The order is a function of the rows, the seed and the number of buckets, which follows from the bytes; shard row counts
    differ by one at most and slots run from 0 without gaps. A null key is one more key, a null text is an empty one; equal
    rows are spread as if they were distinct; rows that share the key but differ elsewhere are told apart by all their
    columns; an empty table gives an empty result. Columns of `df` named shard or slot are replaced, names starting with
    ``__`` are reserved.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*columns)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(record_size(F.col(text))).alias("b")).first()
    rows, buckets = max(1, total["n"]), max(1, -(-(total["b"] or 0) // bucket_bytes))
    numbered, repeats = _ordinals(df, key)
    identity = [F.col(f"`{key}`"), F.col("__ordinal"), *([F.xxhash64(*columns)] if repeats else [])]
    placed = numbered.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(buckets)).cast("int"))

    # Where each bucket starts in the global order: a running sum over one row per bucket.
    counts = materialize(placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__rows")), "bucket-counts")
    before = F.sum("__rows").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    if buckets * 16 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)

    # Pass one scatters, pass two sorts each bucket (so that a retry sees the same array) and shuffles it: F.shuffle is a
    # seeded Fisher-Yates over the array's indices.
    row = F.struct(F.xxhash64(F.lit(seed + 1), *identity).alias("__order"), F.col("__ordinal"), F.struct(*columns).alias("__record"))
    gathered = (
        placed.select("__bucket", row.alias("__row"))
        .repartition(buckets, "__bucket")
        .sortWithinPartitions("__bucket")
        .groupBy("__bucket")
        .agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
        .join(offsets, "__bucket")
    )
    dealt = gathered.select("__start", F.posexplode(F.shuffle("__rows", F.lit(seed))).alias("__at", "__row"))
    dealt = dealt.select("__row.__record.*", (F.col("__start") + F.col("__at")).alias("__position"))
    dealt = dealt.withColumn("shard", F.expr(f"cast(__position * {shards} div {rows} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    return dealt.select(*columns, "shard", (F.col("__position") - first).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write one folder per shard. A bucket lies in neighbouring shards, so each task writes few files and nothing is
    exchanged again; `slot` stays in the rows as the order within the shard."""
    shuffled.write.partitionBy("shard").parquet(path)
