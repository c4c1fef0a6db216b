"""Registered queries of text and record functions, several to a query, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, text
from ..operators import usage
from ..sources import logs
from ..sources.tables import events, read


def _one_of(key: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


COMMANDS = ("git status -s", "git -C x log", '"make" all', "./run.sh now", "  ls  -la", "")
PATHS = ("src/./a.py", "a/../b.txt", "../up", "/abs", "'q/r'", "C:\\x", "a\\b", ".")


def f10_message_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation: its last user text (F-10), parts joined (F-12), markers escaped (F-19), terminal codes stripped (F-20), a path
    (F-22) and a command (F-23), a home redacted (F-25), a header cut (F-27), tools sorted (F-28) and a prefix found (F-29)."""
    turns = read(spark, folder, "conversations")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    c = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"), F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    key = F.col("conv_id")
    part = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("text"))
    tool = lambda name, n: F.struct(name.alias("name"), F.lit(n).alias("n"))
    tools = text.sort_tools(F.array(tool(F.lit(None).cast("string"), 0), tool(_one_of(key, ("write", "ask")), 1), tool(F.lit("read"), 2), tool(F.lit(""), 3), tool(F.lit("read"), 4)))
    digest = lambda value: F.sha2(value, 256)
    return c.select(
        "conv_id",
        digest(F.coalesce(text.last_user_text(F.col("m")), F.lit("none"))).alias("last_user"),
        digest(text.content_text(F.array(part("text", F.col("first")), part("image", F.col("first")), part("text", F.col("last"))))).alias("parts"),
        digest(text.escape_markers(F.concat(F.lit("[REUSE]a[/Reuse] "), "first", F.lit("[/reuse]")))).alias("escaped"),
        digest(text.strip_terminal(F.concat(F.lit("\x1b[31;1m"), "first", F.lit("\x1b[0m\x1b]0;title\x07")))).alias("stripped"),
        text.relative_path(_one_of(key, PATHS)).alias("path"),
        text.command_head(_one_of(key, COMMANDS)).alias("command"),
        text.redact_home(F.concat(F.lit("see /home/u"), key.cast("string"), F.lit("/x and C:\\Users\\me\\y"))).alias("redacted"),
        digest(records.strip_head(F.concat(F.lit("x-bill: 1\n\n x-bill: 2\n"), "first"), ("x-bill:",))).alias("headless"),
        F.concat_ws(",", F.transform(tools, lambda t: t["n"].cast("string"))).alias("tools"),
        text.subsequence_rank(F.col("first"), "de").alias("found"),
    )


def n14_record_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Per event: a currency (N-14), usage from one of three wire forms (N-16), buckets (N-17), a task's state (N-25), forms of money and
    time (N-26) and two time filters (N-28)."""
    key, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")
    count = lambda form, value: F.when(key % 4 == form, value)
    wire = F.struct(
        count(0, k + 1).alias("prompt_tokens"), count(0, k * 2).alias("completion_tokens"), count(0, k).alias("prompt_cache_hit_tokens"), count(1, k).alias("cached_tokens"), count(2, k * 3).alias("input_tokens"), count(2, k).alias("output_tokens"),
        count(2, F.lit(5).cast("long")).alias("cache_creation_input_tokens"), count(2, k + 7).alias("cache_read_input_tokens"), F.when(key % 9 == 0, "bytes").alias("estimator"),
    )
    use = records.wire_usage(wire)
    seen = records.reconciled(_one_of(key, ("running", "failed", "waiting")), _one_of(key, ("alive", "exited")), F.when(key % 5 > 0, k), F.lit(50))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return events(spark, folder).select(
        "event_id",
        records.currency(_one_of(key, ("rmb", "US$", "Euro", "chf", "credits", None, "￥"))).alias("currency"),
        use["prompt"].alias("prompt"), use["completion"].alias("completion"), use["cache_hit"].alias("cache_hit"),
        records.cache_bucket(k, F.when(key % 3 == 0, F.lit(0)).otherwise(99 - k)).alias("cache_bucket"),
        records.tool_error_bucket(_one_of(key, ("Access denied", "deadline passed", "Cancelled", "no such file", "boom"))).alias("error_bucket"),
        records.language_bucket(_one_of(key, ("zh-CN", "EN", "auto", "fr"))).alias("language_bucket"),
        records.finish_bucket(_one_of(key, ("Stop", "length", "", "odd"))).alias("finish_bucket"),
        seen["state"].alias("state"), seen["runtime"].alias("runtime"),
        records.valid_transition(_one_of(key, ("queued", "running", "failed")), _one_of(key, ("running", "waiting", "odd", "cancelled"))).alias("allowed"),
        records.format_duration(F.col("value") * 20).alias("duration"),
        records.active_since(F.col("ts").cast("timestamp"), "yesterday", now).alias("yesterday"), records.active_since(F.col("ts").cast("timestamp"), "36h", now).alias("hours"),
        kind.alias("kind"),
    )


MODES = ("Manual", "acceptEdits", "dontask", "plan ", "YOLO", "", "root")


def a25_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Every event counts for its tool by safe name, its permission mode, its value, and a signal without a name."""
    e = events(spark, folder)
    key = F.col("event_id")
    pair = lambda signal, bucket, n: F.struct(F.lit(signal).alias("signal"), bucket.alias("bucket"), n.cast("long").alias("count"))
    tool = records.safe_bucket(F.concat(F.lit(" Tool/"), "event_type", F.lit("--"), (key % 3).cast("string"), F.lit("! ")), "unknown")
    ended = records.exit_bucket(key % 11 == 0, F.when(key % 13 > 0, key % 7 == 0), F.when(F.col("event_type") == "error", F.lit("boom")))
    failed = records.provider_error_bucket(F.when(key % 3 > 0, _one_of(key, ("api", "auth", "network", "odd"))), F.when(key % 17 > 0, key % 600))
    extra = [pair("exit", ended, F.lit(1)), pair("latency", records.latency_bucket(F.pow(F.col("value"), 2.2)), F.lit(1)), pair("provider_error", failed, F.lit(2))]
    pairs = F.array(*extra, pair("tool", tool, F.lit(1)), pair("mode", records.permission_bucket(_one_of(key, MODES)), F.lit(1)), pair("value", records.safe_bucket(_one_of(key, ("?!", "A b", None)), "none"), F.floor("value") * 100 - 500), pair("", F.lit("x"), F.lit(1)))
    return usage.counters(e.select(F.inline(pairs)))


def s06_usage_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a usage log with damaged, blank and nameless lines: what each line is, and the tokens of good ones."""
    key = F.col("event_id")
    line = F.to_json(F.struct(F.when(key % 23 > 0, F.col("event_type")).alias("provider"), (F.col("k") * 10).alias("tokens_in"), F.lit(1).alias("unknown")))
    raw = F.when(key % 17 == 0, F.substring(line, 1, 14)).when(key % 19 == 0, "  ").when(key % 29 == 0, "[1, 2]").otherwise(line)
    scanned = logs.scan(events(spark, folder).select(raw.alias("value")), "provider string, tokens_in bigint", "provider")
    return scanned.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("record.tokens_in").alias("tokens_in"))


QUERIES = {f.__name__: f for f in (f10_message_forms, n14_record_forms, a25_counters, s06_usage_scan)}
SQL = {
    "f10_message_forms": rf"""WITH n AS (SELECT *, trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g')) AS t FROM conversations),
c AS (SELECT conv_id, arg_max(t, turn) FILTER (role = 'user' AND t <> '') AS u, arg_min(text, turn) AS f, arg_max(text, turn) AS l FROM n GROUP BY conv_id)
SELECT conv_id, sha256(coalesce(u, 'none')) AS last_user, sha256(f || l) AS parts, sha256('[\reuse]a[\/reuse] ' || f || '[\/reuse]') AS escaped, sha256(f) AS stripped,
 ['src/a.py', 'b.txt', NULL, NULL, 'q/r', NULL, 'a/b', NULL][conv_id % 8 + 1] AS path, ['git status', 'git', 'make all', '', 'ls', ''][conv_id % 6 + 1] AS command, 'see <local-home>/x and <local-home>\y' AS redacted, sha256(f) AS headless,
 CASE WHEN conv_id % 2 = 0 THEN '2,4,1,0,3' ELSE '1,2,4,0,3' END AS tools, CASE WHEN lower(f) LIKE 'de%' THEN 0 WHEN regexp_matches(lower(f), '(?s)d.*e') THEN 1 END AS found FROM c""",
    "n14_record_forms": """WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events),
u AS (SELECT *, CASE event_id % 4 WHEN 0 THEN k + 1 WHEN 2 THEN 4 * k + 12 ELSE 0 END AS p, CASE event_id % 4 WHEN 0 THEN k * 2 WHEN 2 THEN k ELSE 0 END AS o, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k + 7 ELSE 0 END AS h FROM e),
w AS (SELECT *, event_id % 9 <> 0 AND (p <> 0 OR o <> 0 OR h <> 0) AS known, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 99 - k END AS m, floor(value * 20 + 5e-1)::BIGINT AS s, event_id % 2 = 0 AND event_id % 5 > 0 AND 50 >= k AS over FROM u)
SELECT event_id, ['CNY', 'USD', 'EUR', 'CHF', 'credits', '', 'CNY'][event_id % 7 + 1] AS currency, CASE WHEN known THEN p END AS prompt, CASE WHEN known THEN o END AS completion, CASE WHEN known THEN h END AS cache_hit,
 CASE WHEN k + m = 0 THEN 'unknown' WHEN k * 100 // (k + m) = 0 THEN '0' WHEN k * 100 // (k + m) < 25 THEN '1_24' WHEN k * 100 // (k + m) < 50 THEN '25_49' WHEN k * 100 // (k + m) < 75 THEN '50_74' WHEN k * 100 // (k + m) < 90 THEN '75_89' ELSE '90_100' END AS cache_bucket,
 ['permission', 'timeout', 'cancelled', 'not_found', 'other'][event_id % 5 + 1] AS error_bucket, ['zh', 'en', 'auto', 'other'][event_id % 4 + 1] AS language_bucket, ['stop', 'length', 'unknown', 'other'][event_id % 4 + 1] AS finish_bucket,
 CASE WHEN over AND event_id % 3 <> 1 THEN 'stale' ELSE ['running', 'failed', 'waiting'][event_id % 3 + 1] END AS state, CASE WHEN over OR event_id % 2 = 1 THEN 'exited' ELSE 'alive' END AS runtime,
 CASE event_id % 3 WHEN 0 THEN event_id % 4 <> 1 WHEN 1 THEN event_id % 4 <> 0 ELSE false END AS allowed,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE (s // 3600) || 'h' || (s % 3600 // 60) || 'm' END AS duration,
 ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15' AS yesterday, ts >= TIMESTAMP '2024-01-14 00:00:00' AS hours, event_type AS kind FROM w""",
    "a25_counters": """WITH e AS (SELECT *, event_id AS i FROM events),
s AS (SELECT 'tool' AS signal, 'tool_' || event_type || '_' || (i % 3) AS bucket, 1 AS n FROM e UNION ALL SELECT 'mode', ['ask', 'auto', 'dont_ask', 'plan', 'yolo', 'other', 'other'][i % 7 + 1], 1 FROM e
 UNION ALL SELECT 'value', ['none', 'a_b', 'none'][i % 3 + 1], floor(value)::BIGINT * 100 - 500 FROM e
 UNION ALL SELECT 'exit', CASE WHEN i % 11 = 0 THEN 'cancelled' WHEN i % 13 > 0 AND i % 7 = 0 THEN 'recovery_paused' WHEN event_type = 'error' THEN 'error' ELSE 'success' END, 1 FROM e
 UNION ALL SELECT 'latency', CASE WHEN v < 1000 THEN 'lt_1s' WHEN v < 5000 THEN 's_1_5' WHEN v < 15000 THEN 's_5_15' WHEN v < 60000 THEN 's_15_60' WHEN v < 300000 THEN 'm_1_5' WHEN v < 900000 THEN 'm_5_15' ELSE 'm_15_plus' END, 1 FROM (SELECT pow(value, 22e-1) AS v FROM e)
 UNION ALL SELECT 'provider_error', CASE WHEN i % 3 = 0 THEN '' WHEN i % 4 = 0 THEN CASE WHEN i % 17 = 0 THEN 'http' WHEN i % 600 = 429 THEN 'rate_limit' WHEN i % 600 >= 500 THEN 'server' WHEN i % 600 >= 400 THEN 'request' ELSE 'http' END WHEN i % 4 = 1 THEN 'auth' WHEN i % 4 = 2 THEN 'network' ELSE '' END, 2 FROM e)
SELECT signal, bucket, least(sum(n), 1000000)::BIGINT AS count FROM s WHERE bucket <> '' AND n > 0 GROUP BY ALL""",
    "s06_usage_scan": """WITH e AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'corrupt' WHEN event_id % 19 = 0 THEN 'blank' WHEN event_id % 29 = 0 THEN 'corrupt' WHEN event_id % 23 = 0 THEN 'no_key' ELSE 'ok' END AS status, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT status, count(*) AS n, CASE WHEN status = 'ok' THEN sum(k * 10)::BIGINT END AS tokens_in FROM e GROUP BY status""",
}
