"""JSON-lines logs in lenient reading: what a line is, is a column, so bad lines are skipped and counted in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Longer lines are skipped, in bytes. Fixed value.
MOST_BYTES = 8 << 20
STATUSES = ("ok", "blank", "long", "corrupt", "no_key")


def scan(lines: DataFrame, schema: str, key: str | None = None, value: str = "value", most: int = MOST_BYTES) -> DataFrame:
    """Adds `record` (of `schema`) and `status` to raw lines: blank, long, corrupt (no JSON object of these types), no_key (no
    value, or an empty one, in the field `key`) or ok. `record` is null but for ok; fields that the schema lacks are ignored."""
    raw = F.coalesce(F.col(value), F.lit(""))
    fits = F.octet_length(raw) <= most
    parsed = F.from_json(F.when(fits, raw), f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.withColumn("__parsed", parsed)
    bad = F.col("__parsed").isNull() | F.col("__parsed.__corrupt").isNotNull()
    missing = (F.coalesce(F.col(f"__parsed.{key}").cast("string"), F.lit("")) == "") if key else F.lit(False)
    status = F.when(F.trim(raw) == "", "blank").when(~fits, "long").when(bad, "corrupt").when(missing, "no_key").otherwise("ok")
    return rows.withColumn("status", status).withColumn("record", F.when(F.col("status") == "ok", F.col("__parsed").dropFields("__corrupt"))).drop("__parsed")


def read_log(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """`scan` of the text files under `path`."""
    return scan(spark.read.text(path), schema, key)


def records(scanned: DataFrame) -> DataFrame:
    return scanned.filter("status = 'ok'").select("record.*")


def skipped(status: Column | str = "status") -> list[Column]:
    """Counts of lines that a scan skips; blank ones are no lines."""
    status = F.col(status) if isinstance(status, str) else status
    return [F.count_if(status == s).alias(s) for s in STATUSES if s != "blank"]


def export(scanned: DataFrame, path: str) -> dict[str, int]:
    """Write the records as JSON lines, lossless to their schema; returns how many lines were written and why others were not. The
    counts are observed by the write itself."""
    seen = Observation()
    records(scanned.observe(seen, *skipped())).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get
