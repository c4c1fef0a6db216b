"""Cutting lineage, and positions in a global order without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of `df` in the folder that ``spark.checkpoint.dir`` names; only where that is unset, as in tests, in a
    temporary one."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` as Parquet in that folder, read back. For rounds of joins: a checkpoint keeps the size that was estimated for it, a join's
    is the product of its sides', and so a number whose length doubles with each round."""
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_position(rows: DataFrame, *order) -> DataFrame:
    """Adds `at`, 1 for the first row in `order`, and `n`, the number of rows. Rows are dealt by ranges of the order and sorted there;
    what a range is ahead of is a sum over one row a range. Rows that are equal in `order` are placed in any way."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("__place", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("__place", 33).alias("__range")).agg(F.count(F.lit(1)).alias("__rows"))
    ahead = Window.orderBy("__range")  # one row a partition
    starts = ranges.select("__range", (F.sum("__rows").over(ahead) - F.col("__rows")).alias("__start"), F.sum("__rows").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    within = F.col("__place").bitwiseAND((1 << 33) - 1)
    joined = placed.withColumn("__range", F.shiftright("__place", 33)).join(F.broadcast(starts), "__range")
    return joined.select(*rows.columns, (F.col("__start") + within + 1).alias("at"), "n")
