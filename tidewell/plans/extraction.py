"""Registered queries of extraction over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction
from ..sources import transcripts
from ..sources.tables import read
from .sessions import lines


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as transcript lines; assistants call a tool or two on some lines."""
    call = lambda name: F.struct(F.lit("c").alias("id"), name.alias("name"), F.lit("{}").alias("arguments"))
    names = F.when(F.col("line") % 2 == 1, F.lit("read")).otherwise(F.lit("bash"))
    calls = F.when((F.col("role") == "assistant") & (F.col("session") % 3 == 0), F.array(call(names), call(F.lit("edit")))).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    return lines(spark, folder).withColumn("tool_calls", calls).withColumn("name", F.lit(None).cast("string"))


def r16_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(_lines(spark, folder)).select("session", "kind", "slice_id", "position", F.octet_length("content").alias("bytes"))


def r16_tool_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(_lines(spark, folder)).filter("kind = 'tool_pattern'").groupBy("content").agg(F.count(F.lit(1)).alias("sessions"))


def _working_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations whose assistants call tools with paths and commands on every line."""
    n = F.col("line")
    call = lambda name, arguments: F.struct(F.lit("c").alias("id"), F.lit(name).alias("name"), arguments.alias("arguments"))
    path = F.concat(F.lit("src/m"), (F.col("session") % 4).cast("string"), F.lit("/f"), (n % 4 + F.col("session") % 2).cast("string"), F.lit(".py"))
    read = F.to_json(F.struct(path.alias("file_path"), F.array(F.lit("docs/./guide.md"), F.lit("/etc/hosts")).alias("paths")))
    run = F.to_json(F.struct(F.when(F.col("session") % 3 == 0, "git status -s").otherwise(F.concat(F.lit("make test"), (n % 4).cast("string"))).alias("command")))
    calls = F.when((F.col("role") == "assistant") & (F.col("session") % 5 != 0), F.array(call("read", read), call("Bash", run)))
    return lines(spark, folder).withColumn("tool_calls", F.coalesce(calls, F.array().cast("array<struct<id:string,name:string,arguments:string>>"))).withColumn("name", F.lit(None).cast("string"))


def r16_context(spark: SparkSession, folder: str) -> DataFrame:
    """The contexts of all sessions, as slices."""
    return extraction.extract(_working_lines(spark, folder)).filter("kind = 'context'").select("session", "slice_id", "content")


def a09_context_entries(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.context_entries(_working_lines(spark, folder)).select("session", "section", "value", "count", "rank")


def s10_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = transcripts.documents(_lines(spark, folder))
    return found.groupBy("kind", "tool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


def f18_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Excerpts of conversations around a word."""
    return lines(spark, folder).select("session", "line", text.snippet("content", F.lit("of the"), 60).alias("snippet"))


def f21_cells(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "conversations").select("conv_id", "turn", text.tsv_cell("text").alias("cell"))


def f16_versions(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents")
    return d.select("doc_id", text.content_version("text").alias("version"), text.replay_id("text", "e-").alias("replay"), text.slice_id("text", "memory").alias("slice_id"), F.size(text.tokens("text")).alias("n_tokens"))


QUERIES = {f.__name__: f for f in (r16_extract, r16_tool_patterns, r16_context, a09_context_entries, s10_documents, f18_snippets, f21_cells, f16_versions)}

_ENTRIES = """l AS (SELECT conv_id AS session, 'src/m' || (conv_id % 4) || '/f' || (turn % 4 + conv_id % 2) || '.py' AS p, CASE WHEN conv_id % 3 = 0 THEN 'git status' ELSE 'make test' || (turn % 4) END AS c, conv_id % 4 AS m FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0),
v AS (SELECT session, 'paths' AS section, unnest([p, 'docs/guide.md']) AS value FROM l UNION ALL SELECT session, 'directories', unnest(['src/m' || m, 'docs']) FROM l UNION ALL SELECT session, 'commands', c FROM l),
n AS (SELECT session, section, value, count(*) AS "count" FROM v GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT *, row_number() OVER (PARTITION BY session, section ORDER BY "count" DESC, value)::INT AS rank FROM n QUALIFY rank <= 5)"""

SQL = {
    "a09_context_entries": f"WITH {_ENTRIES} SELECT * FROM e",
    "r16_context": f"""WITH {_ENTRIES}, s AS (SELECT session, section, string_agg('- ' || value || ' (' || "count" || ')', chr(10) ORDER BY rank) AS body FROM e GROUP BY ALL),
t AS (SELECT session, concat_ws(chr(10), 'Project context observed from repeated tool calls:', max(CASE WHEN section = 'paths' THEN 'Frequent paths:' || chr(10) || body END), max(CASE WHEN section = 'directories' THEN 'Frequent directories:' || chr(10) || body END),
    max(CASE WHEN section = 'commands' THEN 'Common command heads:' || chr(10) || body END)) AS content FROM s GROUP BY session)
SELECT session, substr(sha256('\\x01\\x01'::BLOB || encode(content)), 1, 16) AS slice_id, content FROM t""",
    "r16_tool_patterns": """WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS tn FROM conversations),
c AS (SELECT conv_id, tn, string_agg(CASE WHEN turn % 2 = 1 THEN 'read edit' ELSE 'bash edit' END, ' ' ORDER BY turn) AS content FROM t WHERE role = 'assistant' AND conv_id % 3 = 0 GROUP BY ALL)
SELECT content, count(DISTINCT conv_id) AS sessions FROM c GROUP BY content""",
    "s10_documents": """WITH b AS (SELECT *, role = 'assistant' AND conv_id % 3 = 0 AS calls FROM conversations), d AS (
SELECT 'user_text' AS kind, '' AS tool, text FROM b WHERE role = 'user' UNION ALL SELECT 'assistant_text', '', text FROM b WHERE role = 'assistant'
UNION ALL SELECT 'tool_input', CASE WHEN turn % 2 = 1 THEN 'read' ELSE 'bash' END, CASE WHEN turn % 2 = 1 THEN 'read {}' ELSE 'bash {}' END FROM b WHERE calls UNION ALL SELECT 'tool_input', 'edit', 'edit {}' FROM b WHERE calls)
SELECT kind, tool, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM d WHERE regexp_matches(text, '[\\p{L}\\p{Nd}_]') GROUP BY ALL""",
    "f21_cells": """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS cell FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(cell, '^[=+@-]') THEN '''' || cell ELSE cell END AS cell FROM c""",
    "f16_versions": """SELECT doc_id, sha256(text) AS version, 'e-' || substr(sha256(text), 1, 16) AS replay, substr(sha256('\\x04\\x01'::BLOB || encode(text)), 1, 16) AS slice_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+'))::INT AS n_tokens FROM documents""",
}
