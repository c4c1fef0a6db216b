"""An incremental rollup of usage records for foreachBatch, safe to repeat from any point.

A batch writes the receipts of its new records into its own partition, then makes the days that they touch anew from all
receipts. Both writes overwrite what an earlier attempt at the same batch left, and what a batch holds depends on earlier batches
alone, so a batch that broke off anywhere is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["file", "offset"]
MEASURES = ("total",)


def _receipts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_rollup(batch: DataFrame, batch_id: int, receipts: str, rollup: str) -> None:
    """Fold the records (file, offset, day, source, model, measures) of one batch into sums per day, source and model.

    A record whose receipt is there already changes nothing. If its content differs from the receipt, its file was written anew:
    the record takes the place of the old one, and the days of both are made again. Records that repeat within the batch count
    once (the least one, should they differ). Readers of `rollup` see one row per day, source and model.
    """
    spark = batch.sparkSession
    measures = [c for c in batch.columns if c not in (*KEY, "day", "source", "model")]
    content = F.xxhash64("day", "source", "model", *measures)
    once = batch.groupBy(*KEY).agg(F.min(F.struct("day", "source", "model", *measures)).alias("r")).select(*KEY, "r.*")
    new = once.withColumn("content", content).withColumn("replaces", F.lit(False)).withColumn("batch", F.lit(batch_id).cast("long"))
    old = _receipts(spark, receipts, new)
    if old is not None:
        earlier = old.filter(F.col("batch") < batch_id)
        latest = earlier.groupBy(*KEY).agg(F.max_by("content", "batch").alias("known"))
        new = new.join(latest, KEY, "left").filter(F.col("known").isNull() | (F.col("known") != F.col("content"))).withColumn("replaces", F.col("known").isNotNull()).drop("known")
    _overwrite(new.select(*KEY, "day", "source", "model", *measures, "content", "replaces", "batch"), receipts, "batch")

    now = spark.read.schema(new.select(*KEY, "day", "source", "model", *measures, "content", "replaces", "batch").schema).parquet(receipts).filter(F.col("batch") <= batch_id)
    mine = now.filter(F.col("batch") == batch_id)
    replaced = now.filter("replaces").groupBy(*KEY).agg(F.max("batch").alias("last"))
    again = mine.filter("replaces").select(*KEY).join(now.select(*KEY, "day"), KEY).select("day")
    days = [r[0] for r in mine.select("day").unionByName(again).distinct().collect()]  # a calendar, whatever the batch's size
    if days:
        touched = now.filter(F.col("day").isin(days)).join(replaced, KEY, "left").filter("last is null or batch = last")
        sums = touched.groupBy("day", "source", "model").agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("requests"))
        # A day whose records all moved elsewhere keeps a row of nothing, so that its partition is overwritten too.
        empty = spark.createDataFrame([(d,) for d in days], f"day {dict(batch.dtypes)['day']}").join(sums, "day", "left_anti")
        nothing = empty.select("day", F.lit("").alias("source"), F.lit("").alias("model"), *[F.lit(0).cast(sums.schema[m].dataType).alias(m) for m in measures], F.lit(0).cast("long").alias("requests"))
        _overwrite(sums.unionByName(nothing), rollup, "day")


def _overwrite(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_rollup(spark: SparkSession, rollup: str) -> DataFrame:
    return spark.read.parquet(rollup).filter("requests > 0")
