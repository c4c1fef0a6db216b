"""Session transcripts: JSON lines, one file per session, in lenient reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line of a transcript.
LINE = "role string, content string, name string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:string>>"
#: Longer lines are skipped, in bytes.
MOST_BYTES = 4 << 20


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, line, role, content, name, tool_calls) of all *.jsonl files; blank, malformed, too long and role-less lines are
    skipped, line numbers are those of the file. The file is read whole, so that its order is certain."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = files.select(F.regexp_replace("file", "\\.jsonl$", "").alias("session"), "modified", F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    return parse_lines(rows)


def parse_lines(rows: DataFrame) -> DataFrame:
    """Parse `raw`; keeps the other columns."""
    keep = [c for c in rows.columns if c != "raw"]
    parsed = rows.filter((F.trim("raw") != "") & (F.octet_length("raw") <= MOST_BYTES)).withColumn("m", F.from_json("raw", LINE))
    return parsed.filter(F.coalesce(F.col("m.role"), F.lit("")) != "").select(*keep, "m.role", F.coalesce("m.content", F.lit("")).alias("content"), "m.name", "m.tool_calls")


def tool_error(content: F.Column) -> F.Column:
    low = F.lower(F.trim(content))
    return low.startswith("error:") | low.startswith("blocked:") | low.contains("permission denied")


def documents(lines: DataFrame) -> DataFrame:
    """One row per searchable text: session, line, part, role, kind, tool, text. Tool results give an output and, if they are
    errors, an error."""
    base = ["session", "line"]
    none, zero = F.lit("").alias("tool"), F.lit(0).alias("part")
    user = lines.filter("role = 'user'").select(*base, zero, "role", F.lit("user_text").alias("kind"), none, F.col("content").alias("text"))
    said = lines.filter("role = 'assistant'").select(*base, zero, "role", F.lit("assistant_text").alias("kind"), none, F.col("content").alias("text"))
    called = lines.filter("role = 'assistant'").select(*base, "role", F.posexplode("tool_calls").alias("part", "call"))
    called = called.select(*base, "part", "role", F.lit("tool_input").alias("kind"), F.coalesce("call.name", F.lit("")).alias("tool"), F.concat_ws(" ", "call.name", "call.arguments").alias("text"))
    results = lines.filter("role = 'tool'").select(*base, zero, "role", F.explode(F.when(tool_error(F.col("content")), F.array(F.lit("tool_error"), F.lit("tool_output"))).otherwise(F.array(F.lit("tool_output")))).alias("kind"), F.coalesce("name", F.lit("")).alias("tool"), F.concat_ws(" ", "name", "content").alias("text"))
    return user.unionByName(said).unionByName(called).unionByName(results).filter(F.col("text").rlike("[\\p{L}\\p{Nd}_]"))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Oracle rows: tab-separated, # comments and blank lines left out; lines of another width raise an error when read."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t", -1)
    bad = F.raise_error(F.concat(F.lit("wrong number of columns: "), F.col("value")))
    checked = F.when(F.size(parts) == len(columns), parts).otherwise(bad.cast("array<string>"))
    return lines.select(checked.alias("p")).select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])


def write_jsonl(df: DataFrame, path: str) -> None:
    """Lossless export, one JSON object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_daily(df: DataFrame, path: str) -> None:
    """Append statistics by day; readers of some days open those folders only."""
    df.write.mode("append").partitionBy("day").parquet(path)


def read_daily(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
