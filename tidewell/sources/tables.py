"""The supplied tables as the entities of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as slices: scope (language), id, content."""
    return read(spark, folder, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("id"), F.col("text").alias("content"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as queries: query_id, query."""
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in their properties as `k`."""
    return read(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
