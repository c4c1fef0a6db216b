"""Rolls a growing table of usage events up by day, source and model, with costs; only days that have new events are made anew.

    python jobs/usage_rollup.py SOURCE OUTPUT MARK [--config jobs/usage_rollup.toml] [--full]

SOURCE is Parquet whose sequence column ascends with arrival; events may be late, so a new event can be of any day. The high-water
mark is the largest sequence that was taken, a row a run in the Parquet folder MARK. A run finds the days of the events above the
mark, sums those days over all of their events and overwrites their partitions in OUTPUT, then adds its mark: a run that ends
between the two is made good by the next, which makes the same days anew. With --full all days are made anew.
"""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidewell.functions import numeric  # noqa: E402
from tidewell.operators import usage  # noqa: E402

LOG = logging.getLogger("usage_rollup")
CONFIG = Path(__file__).with_suffix(".toml")
MARK = "sequence bigint, days bigint"
OUTPUT = "source string, model string, prompt bigint, completion bigint, cache_hit bigint, total bigint, requests bigint, turns bigint, provider string, cost double, day date"


def load_config(path: str | Path = CONFIG) -> dict:
    return tomllib.loads(Path(path).read_text())


def high_water(spark: SparkSession, mark: str) -> int | None:
    """The largest sequence taken so far; none before the first run."""
    try:
        return spark.read.schema(MARK).parquet(mark).agg(F.max("sequence")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def records(events: DataFrame, config: dict) -> DataFrame:
    """One statistics record per sequence: an event that was delivered twice counts once."""
    columns = [F.expr(e).alias(name) for name, e in config["columns"].items()]
    once = events.groupBy(F.col(config["sequence"]).alias("__sequence")).agg(F.min(F.struct(*columns)).alias("__r"))
    return once.select("__r.*")


def priced(rolled: DataFrame, config: dict) -> DataFrame:
    """Adds provider and cost: each provider's prices for a million tokens, else those of the provider ``*``."""
    prices = {p["provider"]: p for p in config["prices"]}
    provider = numeric.provider_of(F.col("model"))

    def price(kind: str) -> F.Column:
        chain = F.when(F.lit(False), F.lit(0.0))
        for name, p in prices.items():
            chain = chain if name == "*" else chain.when(F.col("provider") == name, F.lit(float(p[kind])))
        return chain.otherwise(float(prices["*"][kind]))

    cost = ((F.col("prompt") - F.col("cache_hit")) * price("miss") + F.col("cache_hit") * price("hit") + F.col("completion") * price("output")) / 1e6
    return rolled.withColumn("provider", provider).withColumn("cost", F.round(cost, 9))


def run(spark: SparkSession, source: str, output: str, mark: str, config: dict | None = None, full: bool = False) -> dict:
    """Bring `output` up to date with `source`; returns what was read and written."""
    config = config or load_config()
    sequence, day = F.col(config["sequence"]), F.expr(config["columns"]["day"])
    events = spark.read.parquet(source)
    before = None if full else high_water(spark, mark)
    usable = events.filter(sequence.isNotNull() & day.isNotNull())
    fresh = usable if before is None else usable.filter(sequence > before)
    # One row a day: a calendar, whatever the size of the table.
    news = fresh.groupBy(day.alias("day")).agg(F.max(sequence).alias("last"), F.count(F.lit(1)).alias("events")).collect()
    done = {"mark_before": before, "new_events": sum(r["events"] for r in news), "days": len(news), "mark": max((r["last"] for r in news), default=before), "events": 0, "rows": 0}
    if news:
        read, wrote = Observation("read"), Observation("wrote")
        touched = usable.filter(day.isin([r["day"] for r in news])).observe(read, F.count(F.lit(1)).alias("events"))
        rolled = priced(usage.daily(records(touched, config)), config).observe(wrote, F.count(F.lit(1)).alias("rows"))
        rolled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(output)
        done |= read.get | wrote.get
        spark.createDataFrame([(done["mark"], len(news))], MARK).coalesce(1).write.mode("append").parquet(mark)
    LOG.info("%s above %s: %d new events on %d days; summed %d events of these days into %d rows of %s", source, before, done["new_events"], done["days"], done["events"], done["rows"], output)
    return done


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(output)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("source", "output", "mark"):
        parser.add_argument(name)
    parser.add_argument("--config", default=CONFIG)
    parser.add_argument("--full", action="store_true")
    options = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("usage_rollup").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, options.source, options.output, options.mark, load_config(options.config), options.full)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
