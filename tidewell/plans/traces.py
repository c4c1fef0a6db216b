"""Registered query of the trace converter: conversations as traces of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import traces
from ..sources.tables import read


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn as a step (raw JSON, line): the user's message before it, its text, two tool calls in every third
    conversation, and one more exchange in every fourth turn."""
    turns = read(spark, folder, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.withColumn("user", F.when(F.lag("role").over(order) == "user", F.char_length(F.lag("text").over(order)))).filter("role = 'assistant'")
    size = F.char_length("text")
    event = lambda kind, chars=None, call=None, name=None: F.struct(
        F.lit(kind).alias("event_type"), (chars if chars is not None else F.lit(None)).cast("long").alias("content_chars"), (call if call is not None else F.lit(None)).cast("string").alias("tool_call_id"), F.lit(name).cast("string").alias("tool_name")
    )
    none = F.array().cast("array<struct<event_type:string,content_chars:bigint,tool_call_id:string,tool_name:string>>")
    first = F.concat(F.lit("c"), F.col("turn").cast("string"))
    when = lambda test, *events: F.when(test, F.array(*events)).otherwise(none)
    tooled = F.col("conv_id") % 3 == 0
    events = F.concat(
        when(F.col("user").isNotNull(), event("user_message", F.col("user"))),
        F.array(event("text", size)),
        when(tooled, event("tool_call", None, first, "read"), event("tool_call", None, F.lit("e"), "edit"), event("text", F.col("turn"))),
        when(F.col("turn") % 4 == 3, event("user_message", F.lit(3)), event("reasoning", F.lit(9))),
    )
    tool = lambda call, chars: F.struct(call.alias("tool_call_id"), chars.cast("long").alias("result_chars"))
    tools = F.when(tooled, F.array(tool(first, size % 97), tool(F.lit("e"), F.lit(5))))
    step = F.struct(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("round_index"), events.alias("timing_events"), tools.alias("tools"))
    return asked.select(F.to_json(step).alias("raw"), F.col("turn").alias("line"))


def s11_trace_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = traces.convert(_steps(spark, folder))
    return rows.select("session", "round", "part", "role", "content", "name", "tool_call_id", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"))


QUERIES = {"s11_trace_rows": s11_trace_rows}
SQL = {
    "s11_trace_rows": """WITH t AS (SELECT *, CASE WHEN lag(role) OVER w = 'user' THEN length(lag(text) OVER w) END AS u, length(text) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id::VARCHAR AS session, turn AS round, list_concat(CASE WHEN u IS NOT NULL THEN [{'role': 'user', 'content': '(chars=' || u || ')', 'name': NULL::VARCHAR, 'call': NULL::VARCHAR, 'n': 0}] ELSE [] END,
    CASE WHEN conv_id % 3 = 0 THEN [{'role': 'assistant', 'content': '(chars=' || n || ')(chars=' || turn || ')', 'name': NULL, 'call': NULL, 'n': 2}, {'role': 'tool', 'content': '(chars=' || (n % 97) || ')', 'name': 'read', 'call': 'c' || turn, 'n': 0}, {'role': 'tool', 'content': '(chars=5)', 'name': 'edit', 'call': 'e', 'n': 0}]
    ELSE [{'role': 'assistant', 'content': '(chars=' || n || ')', 'name': NULL, 'call': NULL, 'n': 0}] END,
    CASE WHEN turn % 4 = 3 THEN [{'role': 'user', 'content': '(chars=3)', 'name': NULL, 'call': NULL, 'n': 0}, {'role': 'assistant', 'content': '(chars=9)', 'name': NULL, 'call': NULL, 'n': 0}] ELSE [] END) AS l FROM t WHERE role = 'assistant'),
x AS (SELECT session, round, unnest(range(len(l)))::INT AS part, unnest(l) AS s FROM r) SELECT session, round, part, s.role AS role, s.content AS content, s.name AS name, s.call AS tool_call_id, s.n AS n_calls FROM x"""
}
