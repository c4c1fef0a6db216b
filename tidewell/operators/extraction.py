"""Transcripts into slices: prompts, tool patterns, contexts and final results."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.packaging import ship
from .sessions import turns

PROMPT_BYTES, RESULT_BYTES, TOP, LEAST = 4000, 8000, 5, 2
MARKER = "\n[... compacted ...]\n"

#: Keys of tool arguments that hold paths, and tools that run commands. Fixed values.
PATH_KEYS = ("path", "paths", "file", "files", "file_path", "file_paths", "source_path", "destination_path", "directory", "directories", "dir", "dirs", "cwd", "workdir")
SHELLS = ("bash", "shell", "exec_command", "run_command")


def compact(content: str, most: int) -> str:
    """A text without trailing blanks, decoration lines, repeated blank and equal neighbouring lines (outside code fences), cut
    to `most` bytes by keeping its head and tail around a marker; characters stay whole."""
    kept: list[str] = []
    fence = ""
    for line in content.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.rstrip(" \t")
        bare = line.strip()
        opener = bare[0] if bare[:3] in ("```", "~~~") else ""
        if opener:
            kept.append(line)
            fence = opener if not fence else ("" if fence == opener else fence)
        elif fence:
            kept.append(line)
        elif len(bare) >= 3 and not set(bare) - set("-*_=~#"):
            continue
        elif kept and ((not bare and not kept[-1].strip()) or (bare and line == kept[-1])):
            continue
        else:
            kept.append(line)
    raw = "\n".join(kept).strip().encode()
    if len(raw) <= most:
        return raw.decode()
    room = most - len(MARKER.encode())
    if room <= 0:
        return raw[:most].decode(errors="ignore")
    head, tail = raw[: room // 2].decode(errors="ignore"), raw[len(raw) - (room - room // 2) :].decode(errors="ignore")
    return head + MARKER + tail


def compacted(df: DataFrame, column: str, most: int) -> DataFrame:
    """`df` with `column` compacted, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: [compact(x or "", most) for x in b[column]]})

    ship(df.sparkSession)
    return df.mapInPandas(run, df.schema)


def argument_paths(arguments: str | None) -> list[str]:
    """Relative paths in a tool call's arguments: under known keys, at any depth, also where the JSON is a string of JSON."""
    try:
        value = json.loads(arguments or "null")
        value = json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return []
    found: list[str] = []

    def strings(x) -> list[str]:
        return [x] if isinstance(x, str) else [s for y in x for s in strings(y)] if isinstance(x, list) else []

    def walk(x) -> None:
        if isinstance(x, dict):
            for key, field in x.items():
                if key.lower() in PATH_KEYS:
                    found.extend(strings(field))
                for item in field if isinstance(field, list) else [field]:
                    walk(item)

    walk(value)
    out = []
    for raw in found:
        p = raw.strip("\"'").strip().replace("\\", "/")
        if p in ("", ".") or p[0] in "/~" or "://" in p or p[1:2] == ":":
            continue
        p = posixpath.normpath(p)
        if p not in (".", "..") and not p.startswith("../"):
            out.append(p)
    return out


def context_entries(lines: DataFrame) -> DataFrame:
    """(session, section, value, count, rank): the paths, folders and command heads that a session's tool calls repeat, the
    most frequent of each section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for session, name, arguments in zip(b["session"], b["name"], b["arguments"], strict=True):
                for p in argument_paths(arguments):
                    rows.append((session, "paths", p))
                    if posixpath.dirname(p):
                        rows.append((session, "directories", posixpath.dirname(p)))
            yield pd.DataFrame(rows, columns=["session", "section", "value"])

    ship(lines.sparkSession)
    calls = lines.select("session", F.explode("tool_calls").alias("c")).select("session", F.coalesce("c.name", F.lit("")).alias("name"), "c.arguments")
    paths = calls.mapInPandas(run, f"session {dict(lines.dtypes)['session']}, section string, value string")
    inner = F.coalesce(F.get_json_object("arguments", "$.command"), F.get_json_object(F.get_json_object("arguments", "$"), "$.command"))
    heads = calls.filter(F.lower("name").isin(*SHELLS)).select("session", F.lit("commands").alias("section"), text.command_head(inner).alias("value")).filter("value <> ''")
    counted = paths.union(heads).groupBy("session", "section", "value").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= LEAST)
    order = Window.partitionBy("session", "section").orderBy(F.desc("count"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


#: The first line of a context, and the titles of its sections in their order. Fixed values.
CONTEXT, TITLES = "Project context observed from repeated tool calls:", {"paths": "Frequent paths:", "directories": "Frequent directories:", "commands": "Common command heads:"}


def contexts(lines: DataFrame) -> DataFrame:
    """(session, content): what a session's tool calls repeat, as text; sessions that repeat nothing have none.

    Values are counted before they are exchanged, and the best TOP of a section are all that is gathered of a session.
    """
    entries = context_entries(lines).withColumn("entry", F.concat(F.lit("- "), "value", F.lit(" ("), F.col("count").cast("string"), F.lit(")")))
    listed = entries.groupBy("session", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("e"))
    texts = listed.select("session", "section", F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("body"))
    parts = texts.groupBy("session").agg(*[F.max(F.when(F.col("section") == k, F.concat(F.lit(t + "\n"), "body"))).alias(k) for k, t in TITLES.items()])
    return parts.select("session", F.concat_ws("\n", F.lit(CONTEXT), *TITLES).alias("content"))


def extract(lines: DataFrame) -> DataFrame:
    """(session, kind, slice_id, content, position) of transcript lines (session, line, role, content, tool_calls).

    Per session what its tool calls repeat, as a context of project scope, placed behind all lines. Per turn a prompt (its first user line, compacted) and, with two calls or more, the sequence of tool names; per session
    the last assistant line without calls as the result. Of equal ids in a session the first stays.
    """
    numbered = turns(lines)
    first = numbered.filter("role = 'user'").groupBy("session", "turn_no").agg(F.min_by("content", "line").alias("content"), F.min("line").alias("position"))
    prompts = compacted(first, "content", PROMPT_BYTES).select("session", F.lit("prompt").alias("kind"), "content", "position")
    names = numbered.select("session", "turn_no", "line", F.posexplode("tool_calls").alias("at", "c")).filter(F.coalesce(F.col("c.name"), F.lit("")) != "")
    seen = names.groupBy("session", "turn_no").agg(F.array_sort(F.collect_list(F.struct("line", "at", "c.name"))).alias("n"), F.min("line").alias("position"))
    patterns = seen.filter(F.size("n") >= LEAST).select("session", F.lit("tool_pattern").alias("kind"), F.array_join(F.transform("n", lambda x: x["name"]), " ").alias("content"), "position")
    last = lines.filter((F.col("role") == "assistant") & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)).groupBy("session").agg(F.max_by("content", "line").alias("content"), F.max("line").alias("position"))
    results = compacted(last, "content", RESULT_BYTES).select("session", F.lit("result").alias("kind"), "content", "position")
    repeated = contexts(lines).select("session", F.lit("context").alias("kind"), "content", F.lit(None).cast(dict(results.dtypes)["position"]).alias("position"))
    rows = prompts.unionByName(patterns).unionByName(results).unionByName(repeated).filter("content <> ''")
    ids = F.when(F.col("kind") == "context", text.slice_id("content", "context")).when(F.col("kind") == "prompt", text.slice_id("content", "prompt")).when(F.col("kind") == "tool_pattern", text.slice_id("content", "tool_pattern")).otherwise(text.slice_id("content", "result"))
    order = Window.partitionBy("session", "slice_id").orderBy("position")
    return rows.withColumn("slice_id", ids).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
