"""What the operators of this package share: materialised tables, size-checked broadcasts and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \x09-\x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"

#: A broadcast side may have this many bytes at most (rows times a bound on a row); beyond it a shuffled join is used.
BROADCAST_BYTES = 32 << 20
#: What a row of one long takes in the hash relation of a broadcast join, at most.
KEY_BYTES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
            found = context._jsc.sc().getCheckpointDir()
        folder = found.get()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM find out which exchanges are no longer referenced, so that Spark deletes their files: it does so
    when objects are collected, which on an idle driver may be long after a large table was materialised."""
    spark.sparkContext._jvm.System.gc()


def broadcast_checked(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint if counting shows that `df` (a materialised table) stays within BROADCAST_BYTES, else `df` as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and bind it in `body`: a lambda variable, which the optimizer cannot inline again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters other than WORD_SPACE, in order; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_SPACE[1:], " " * (len(WORD_SPACE) - 1))
    return F.array_remove(F.split(spaced, " "), "")
