"""External traces of agents, one JSON object a step, as transcript rows: user and assistant turns in the order of the step's
events, and each tool result behind the assistant row that called it.

A step is converted inside its row, from a VARIANT, so nothing is exchanged and fields that are not used cost nothing; a step
that is no JSON object gives no rows. Traces hold the sizes of texts, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "array<struct<event_type:string,tool_call_id:string,tool_name:string,content_chars:bigint,result_chars:bigint>>"
TOOL = "array<struct<tool_call_id:string,content_chars:bigint,result_chars:bigint>>"
CALLS = "array<struct<id:string,name:string>>"
ROW = f"struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:{CALLS}>"


def _marker(x: Column) -> Column:
    """The size that stands for a text: of its content, else of its result, else 0."""
    chars = F.coalesce(F.nullif(x["content_chars"], F.lit(0)), F.nullif(x["result_chars"], F.lit(0)), F.lit(0))
    return F.concat(F.lit("(chars="), chars.cast("string"), F.lit(")"))


def _row(role: str, content: Column, name: Column | None = None, call: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    values = (F.lit(role), content, name if name is not None else none, call if call is not None else none, calls if calls is not None else none)
    return F.struct(*values).cast(ROW)


def step_rows(events: Column, tools: Column) -> Column:
    """The rows (ROW) of one step. Calls and texts between two user messages are one assistant row; of equal tool_call_ids the last
    tool and the last name count, and the result comes once, behind the first call."""
    texts, calls = ("text", "reasoning"), "tool_call"
    is_user = lambda e: e["event_type"] == "user_message"
    known = F.filter(events, lambda e: e["event_type"].isin("user_message", *texts, calls))
    # Every event with the number of user messages up to it: its segment.
    users = lambda known: F.filter(F.transform(known, lambda e, i: F.when(is_user(e), i)), lambda i: i.isNotNull())

    def segments(known: Column, at: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), at, F.array(F.size(known)))
        parts = F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.slice(known, F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1))
        return F.flatten(F.transform(parts, lambda part, k: F.concat(F.when(k > 0, F.array(_row("user", _marker(F.get(known, F.get(at, k - 1)))))).otherwise(F.array().cast(f"array<{ROW}>")), assistant(known, part, F.get(bounds, k)))))

    def assistant(known: Column, part: Column, before: Column) -> Column:
        said = F.transform(F.filter(part, lambda e: e["event_type"].isin(*texts)), _marker)
        called = F.filter(part, lambda e: e["event_type"] == calls)
        listed = F.when(F.size(called) > 0, F.transform(called, lambda e: F.struct(e["tool_call_id"].alias("id"), e["tool_name"].alias("name"))))
        row = _row("assistant", F.when(F.size(said) > 0, F.array_join(said, "")), calls=listed)
        earlier = F.slice(known, F.lit(1), before + 1)
        first = F.filter(called, lambda e, i: ~F.exists(F.slice(called, F.lit(1), i), lambda x: x["tool_call_id"].eqNullSafe(e["tool_call_id"])) & ~F.exists(earlier, lambda x: (x["event_type"] == calls) & x["tool_call_id"].eqNullSafe(e["tool_call_id"])))
        return F.when(F.size(part) > 0, F.concat(F.array(row), F.flatten(F.transform(first, lambda e: result(known, e["tool_call_id"]))))).otherwise(F.array().cast(f"array<{ROW}>"))

    def result(known: Column, call: Column) -> Column:
        own = F.filter(tools, lambda t: t["tool_call_id"].eqNullSafe(call))
        name = F.element_at(F.filter(known, lambda e: (e["event_type"] == calls) & e["tool_call_id"].eqNullSafe(call)), -1)["tool_name"]
        return F.when(F.size(own) > 0, F.array(_row("tool", _marker(F.element_at(own, -1)), name, call))).otherwise(F.array().cast(f"array<{ROW}>"))

    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return bind(known, lambda k: bind(users(k), lambda at: segments(k, at)))


def convert(traces: DataFrame, raw: str = "raw", order: str = "line") -> DataFrame:
    """(session, round, line, part, role, content, name, tool_call_id, tool_calls) of traces (raw JSON, line). Rows of a session are
    ordered by round, line and part; a step without a session belongs to ``unknown``, one without a round to round 0."""
    parsed = traces.select(F.col(order).alias("line"), F.try_parse_json(raw).alias("v")).filter("v is not null")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    events, tools = F.coalesce(get("$.timing_events", EVENT), F.array().cast(EVENT)), F.coalesce(get("$.tools", TOOL), F.array().cast(TOOL))
    steps = parsed.select(F.coalesce(get("$.session_id", "string"), F.lit("unknown")).alias("session"), F.coalesce(get("$.round_index", "bigint"), F.lit(0)).alias("round"), "line", events.alias("events"), tools.alias("tools"))
    rows = steps.select("session", "round", "line", F.posexplode(step_rows(F.col("events"), F.col("tools"))).alias("part", "row"))
    return rows.select("session", "round", "line", "part", "row.*")
