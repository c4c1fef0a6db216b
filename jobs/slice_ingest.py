"""Takes new turns of conversations into a library of slices, as a stream that stops when nothing new is left.

    python jobs/slice_ingest.py SOURCE OUTPUT CHECKPOINT [--config jobs/slice_ingest.toml]

SOURCE is a Parquet folder, or a pattern of files, of (conv_id, turn, role, text) to which files are added. OUTPUT gets two tables:
``turns`` (conv_id, turn, kind, slice_id; partitioned by batch and kind) and ``slices`` (slice_id, content, its version and
sizes; partitioned by batch and type), where each content is once. A batch overwrites its own partitions only and leaves out
the slices of the batches before it, so a batch that is run again after a crash writes what it wrote before; which files are
taken is in CHECKPOINT.
"""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidewell.functions import text  # noqa: E402
from tidewell.sources import transcripts  # noqa: E402

LOG = logging.getLogger("slice_ingest")
CONFIG = Path(__file__).with_suffix(".toml")
#: The type of slice that each kind of text becomes.
TYPE = {"user_text": "prompt", "assistant_text": "result"}
TURNS = "conv_id bigint, turn bigint, slice_id string, batch bigint, kind string"
SLICES = "slice_id string, content string, content_version string, n_chars int, n_terms int, batch bigint, type string"


def load_config(path: str | Path = CONFIG) -> dict:
    return tomllib.loads(Path(path).read_text())


def _by_type(type_: Column, value) -> Column:
    return reduce(lambda chain, t: chain.when(type_ == t, value(t)), TYPE.values(), F.when(F.lit(False), F.lit("")))


def to_slices(rows: DataFrame, config: dict) -> DataFrame:
    """conv_id, turn, kind, type, slice_id, content of the rows that have a role of TYPE and a text with a letter or digit."""
    lines = rows.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("line"), F.trim("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("tool_calls"),
    )
    found = transcripts.documents(lines).filter(F.col("kind").isin(*TYPE))
    content = text.strip_terminal(F.col("text")) if config["strip_terminal"] else F.col("text")
    content = text.redact_home(content) if config["redact_home"] else content
    typed = found.select(F.col("session").alias("conv_id"), F.col("line").alias("turn"), "kind", reduce(lambda c, k: c.when(F.col("kind") == k, TYPE[k]), TYPE, F.when(F.lit(False), "")).alias("type"), text.normalize_space(content).alias("content"))
    kept = typed.filter(F.char_length("content") >= config["least_chars"])
    return kept.withColumn("slice_id", _by_type(F.col("type"), lambda t: text.slice_id("content", t, config["scope"])))


def take_batch(rows: DataFrame, batch: int, output: str, config: dict) -> dict:
    """Write what batch number `batch` adds; safe to repeat. Returns counts."""
    spark = rows.sparkSession
    read, taken = Observation(f"read-{batch}"), Observation(f"taken-{batch}")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    seen = rows.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(blank("role") | blank("text")).alias("blank"))
    turns = to_slices(seen, config).observe(taken, F.count(F.lit(1)).alias("turns"))
    _put(turns.select("conv_id", "turn", "slice_id", F.lit(batch).cast("long").alias("batch"), "kind"), f"{output}/turns", "kind")

    # Copies of a content are merged before the exchange; then slices of earlier batches go.
    distinct = to_slices(rows, config).groupBy("slice_id", "type").agg(F.first("content").alias("content"))
    if batch > 0:
        known = spark.read.schema(SLICES).parquet(f"{output}/slices").filter(F.col("batch") < batch).select("slice_id", "type")
        distinct = distinct.join(known, ["slice_id", "type"], "left_anti")
    new = Observation(f"new-{batch}")
    fresh = distinct.observe(new, F.count(F.lit(1)).alias("slices"))
    columns = ["slice_id", "content", text.content_version("content").alias("content_version"), F.char_length("content").alias("n_chars"), F.size(text.tokens("content")).alias("n_terms")]
    _put(fresh.select(*columns, F.lit(batch).cast("long").alias("batch"), "type"), f"{output}/slices", "type")
    counts = {"batch": batch, **read.get, **taken.get, **new.get}
    LOG.info("batch %(batch)d: read %(rows)d rows, %(blank)d without role or text; wrote %(turns)d turns and %(slices)d new slices", counts)
    return counts


def _put(df: DataFrame, path: str, kind: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", kind).parquet(path)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> list[dict]:
    """Take all files of `source` that were not taken before; returns the counts of each batch, none if nothing was new."""
    config = config or load_config()
    done: list[dict] = []
    stream = (
        spark.readStream.schema(spark.read.parquet(source).schema)
        .option("maxFilesPerTrigger", config["files_per_batch"])
        .parquet(source)
        .writeStream.foreachBatch(lambda rows, batch: done.append(take_batch(rows, batch, output, config)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    LOG.info("%s: %d batches of %s taken into %s", "ended", len(done), source, output)
    return done


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """Every turn with its slice."""
    slices = spark.read.schema(SLICES).parquet(f"{output}/slices").drop("batch", "type")
    return spark.read.schema(TURNS).parquet(f"{output}/turns").drop("batch").join(slices, "slice_id")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("source", "output", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config", default=CONFIG)
    options = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("slice_ingest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, options.source, options.output, options.checkpoint, load_config(options.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
