"""Registered queries of usage, cost, statistics and lifecycle. Events stand for usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import lifecycle, usage
from ..sources.tables import events, read

COST_MISS, COST_HIT = 0.27, 0.07


def usage_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as usage records: tokens, cache hits, reuse and judge decisions follow from ids, values and properties."""
    e = events(spark, folder)
    verdicts = F.array(*map(F.lit, ("approved", "declined", "fail_closed", "skipped")))
    judge = F.when(
        F.col("event_id") % 7 == 0,
        F.array(F.struct(F.element_at(verdicts, (F.col("event_id") % 4 + 1).cast("int")).alias("verdict"), (F.col("event_id") % 2 == 0).alias("called"), (F.col("k") * 3).alias("latency_ms"), (F.col("k") + 40).alias("prompt_tokens"))),
    )
    return e.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.to_date("ts").alias("day"),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("provider"),
        (F.col("event_id") % 3 != 0).alias("exact"),
        (F.col("k") * 10 + 1000).alias("tokens_in"),
        (F.col("event_id") % 50 + 100).alias("tokens_out"),
        F.when(F.col("event_type") == "click", F.col("k") * 8).otherwise(F.col("k") * 2).alias("cache_hit_tokens"),
        F.when(F.col("event_id") % 5 == 0, 200).otherwise(0).cast("long").alias("injected_tokens"),
        (F.col("event_id") % 4).alias("slice_hits"),
        (F.col("event_id") % 11 == 0).alias("l3_reuse"),
        (F.col("event_id") % 110 == 0).alias("l3_false_hit"),
        judge.alias("judge"),
    )


_U = """u AS (SELECT user_id AS session_id, event_id AS seq, ts::DATE AS day, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'p' || (user_id % 4) END AS provider, event_id % 3 <> 0 AS exact, k * 10 + 1000 AS tokens_in,
 event_id % 50 + 100 AS tokens_out, CASE WHEN event_type = 'click' THEN k * 8 ELSE k * 2 END AS cache_hit_tokens, CASE WHEN event_id % 5 = 0 THEN 200 ELSE 0 END AS injected_tokens, event_id % 4 AS slice_hits,
 event_id % 11 = 0 AS l3_reuse, event_id % 110 = 0 AS l3_false_hit, event_id % 7 = 0 AS judged, CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'declined' WHEN 2 THEN 'fail_closed' ELSE 'skipped' END AS verdict, event_id % 2 = 0 AS called, k
 FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events))"""


def a02_usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = usage.summarize(usage_records(spark, folder), COST_MISS, COST_HIT)
    money = ("cost_paid", "cost_paid_strict", "cost_no_cache", "savings", "savings_rate", "inject_roi")
    return s.select(*[c for c in s.columns if c not in money], *[F.round(c, 9).alias(c) for c in money])


def a03_by_provider(spark: SparkSession, folder: str) -> DataFrame:
    return usage.by_provider(usage_records(spark, folder))


def a04_provider_savings(spark: SparkSession, folder: str) -> DataFrame:
    prices = spark.createDataFrame([("p1", 0.5, 0.1), ("p2", 0.3, 0.05)], "provider string, price_miss double, price_hit double")
    return usage.provider_savings(usage_records(spark, folder), prices, COST_MISS, COST_HIT)


def r22_usage_report(spark: SparkSession, folder: str) -> DataFrame:
    prices = spark.createDataFrame([("p1", 0.5, 0.1), ("p2", 0.3, 0.05)], "provider string, price_miss double, price_hit double")
    return usage.report(usage_records(spark, folder), prices, COST_MISS, COST_HIT)


def r23_l1_check(spark: SparkSession, folder: str) -> DataFrame:
    return usage.l1_check(usage_records(spark, folder))


def stats_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as daily statistics records; sign-ups are turn markers."""
    return events(spark, folder).select(
        F.to_date("ts").alias("day"),
        F.when(F.col("user_id") % 2 == 0, "cli").otherwise("gateway").alias("source"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))).otherwise(F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"), F.lit("/m"), (F.col("user_id") % 4).cast("string"))).alias("model"),
        F.col("k").alias("prompt"),
        (F.col("k") * 2).alias("completion"),
        F.floor(F.col("k") / 2).alias("cache_hit"),
        (F.col("k") * 3).alias("total"),
        (F.col("event_type") == "signup").alias("turn"),
    )


_D = """s AS (SELECT ts::DATE AS day, CASE WHEN user_id % 2 = 0 THEN 'cli' ELSE 'gateway' END AS source, CASE WHEN user_id % 5 = 0 THEN 'm' || (user_id % 3) ELSE 'v' || (user_id % 3) || '/m' || (user_id % 4) END AS model,
 k AS prompt, k * 2 AS completion, k // 2 AS cache_hit, k * 3 AS total, event_type = 'signup' AS turn FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)),
d AS (SELECT day, source, model, (sum(CASE WHEN turn THEN 0 ELSE prompt END))::BIGINT AS prompt, (sum(CASE WHEN turn THEN 0 ELSE completion END))::BIGINT AS completion, (sum(CASE WHEN turn THEN 0 ELSE cache_hit END))::BIGINT AS cache_hit,
 (sum(CASE WHEN turn THEN 0 ELSE total END))::BIGINT AS total, count(*) FILTER (NOT turn) AS requests, count(*) FILTER (turn) AS turns FROM s GROUP BY ALL)"""


def a07_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return usage.daily(stats_records(spark, folder))


def a06_range_stats(spark: SparkSession, folder: str) -> DataFrame:
    rolled = usage.daily(stats_records(spark, folder)).filter("day between date'2024-01-05' and date'2024-01-20'")
    return usage.range_totals(rolled)


def a06_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    rolled = usage.daily(stats_records(spark, folder)).withColumn("provider", numeric.provider_of(F.col("model")))
    days, sums = F.col("day"), [F.sum("total").alias("total"), F.sum("requests").alias("requests")]
    grouped = rolled.groupingSets([[days, F.col("model")], [days, F.col("provider")], [F.col("model")], [F.col("provider")], []], days, F.col("model"), F.col("provider"))
    return grouped.agg(F.grouping_id().alias("level"), *sums)


def j18_day_spine(spark: SparkSession, folder: str) -> DataFrame:
    rare = stats_records(spark, folder).filter("model = 'm0' and prompt < 3")
    return usage.day_spine(usage.daily(rare))


def a22_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select(
        F.concat_ws("|", "event_type", (F.col("user_id") % 10).cast("string")).alias("key"),
        F.when((F.col("user_id") % 10 == 3) & (F.col("event_id") % 2 == 0), "EUR").otherwise("USD").alias("currency"),
        F.col("k").cast("decimal(18,9)").alias("amount"),
    )
    out = usage.ledger(rows.withColumn("amount", F.col("amount") / 1000))
    return out.select("key", "currencies", "entries", F.col("amount").cast("double").alias("amount"))


def a23_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Costs by model; of some models prices are unknown for some or all rows."""
    e = events(spark, folder)
    cost = numeric.token_cost(F.floor(F.col("k") / 2), F.col("k"), F.col("k") * 2, F.lit(0.07), F.lit(0.27), F.lit(1.1)).cast("double")
    known = ~((F.col("user_id") % 6 == 0) | ((F.col("user_id") % 6 == 1) & (F.col("event_id") % 2 == 0)))
    rows = e.select(F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")).alias("model"), F.when(known, cost).alias("cost"))
    return usage.quotes(rows).select("model", F.round("cost", 6).alias("cost"), "complete", "rows", "priced", "status")


def t11_quota(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage.quota(usage_records(spark, folder), 20_000, 40_000)
    return rows.groupBy("session_id", "mode").agg(F.count(F.lit(1)).alias("n"), F.max("used_before").alias("used"))


def a27_startup_p99(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select(F.col("user_id").alias("plugin"), F.col("event_id").alias("seq"), F.round(F.col("value") * 10).cast("long").alias("ms"))
    out = usage.nearest_rank(rows, "plugin", "ms")
    return out.select("plugin", "p99", "n", (F.col("least_recent") >= 100).alias("demote"))


def w17_rolling_startup(spark: SparkSession, folder: str) -> DataFrame:
    """Every startup with the 99th percentile of its plugin's last twenty as of then."""
    rows = events(spark, folder).select((F.col("user_id") % 50).alias("plugin"), F.col("event_id").alias("seq"), F.round(F.col("value") * 10).cast("long").alias("ms"))
    return usage.rolling_ranks(rows, "plugin", "ms", budget=400).select("plugin", "seq", "n", "p99", "demote")


def r17_gc_plan(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.gc_plan(lifecycle.library(spark, folder), now=200 * 86400, retention_days=180, min_weight=0.02, most=300).select("id", "type", F.round("weight", 9).alias("weight"), "reason")


def a19_evicted_by_type(spark: SparkSession, folder: str) -> DataFrame:
    plan = lifecycle.gc_plan(lifecycle.library(spark, folder), now=200 * 86400, retention_days=180, min_weight=0.02, most=300)
    return plan.filter("reason = 'over_cap'").groupBy("type").agg(F.count(F.lit(1)).alias("evicted"))


def a16_stats_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of each slice merged from its events: sums, the latest use."""
    e = events(spark, folder).withColumn("slice", F.col("k"))
    return e.groupBy("slice").agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.count_if(F.col("event_type") == "error").alias("rejected"), F.count_if(F.col("event_type") == "view").alias("injected"), F.max("event_id").alias("last_used"))


def s04_journal_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a journal: views put, errors delete, others add to the counters."""
    e = events(spark, folder)
    op = F.when(F.col("event_type") == "view", "put").when(F.col("event_type") == "error", "del").otherwise("stat")
    return lifecycle.replay(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("position"), op.alias("op"), F.col("k").alias("body"), F.lit(1).alias("hits")))


QUERIES = {
    f.__name__: f
    for f in (a02_usage_summary, a03_by_provider, a04_provider_savings, r22_usage_report, r23_l1_check, a07_rollup, a06_range_stats, a06_grouping_sets, j18_day_spine, a22_ledger, a23_quotes, t11_quota, a27_startup_p99, w17_rolling_startup, r17_gc_plan, a19_evicted_by_type, a16_stats_merge, s04_journal_replay)
}

_BP = """b AS (SELECT provider, count(*) AS events, count(*) FILTER (exact) AS exact_events, count(*) FILTER (l3_reuse) AS l3_reuses, (sum(CASE WHEN exact THEN tokens_in ELSE 0 END))::BIGINT AS tokens_in, (sum(CASE WHEN exact THEN tokens_out ELSE 0 END))::BIGINT AS tokens_out,
 (sum(CASE WHEN exact THEN cache_hit_tokens ELSE 0 END))::BIGINT AS cache_hit_tokens FROM u GROUP BY provider), bp AS (SELECT *, round(CASE WHEN tokens_in > 0 THEN 100e0 * cache_hit_tokens / tokens_in ELSE 0e0 END, 6) AS l1_hit_rate FROM b)"""

_GC = """l AS (SELECT d.doc_id AS id, CASE d.doc_id % 5 WHEN 0 THEN 'prompt' WHEN 1 THEN 'context' WHEN 2 THEN 'tool_pattern' WHEN 3 THEN 'result' ELSE 'memory' END AS type, CASE WHEN d.doc_id % 13 = 0 THEN 0 ELSE (d.doc_id * 7 % 199) * 86400 END AS created,
 CASE WHEN d.doc_id % 3 = 0 THEN (d.doc_id * 11 % 200) * 86400 ELSE 0 END AS last_used, n_chars % 9 AS hits, n_chars % 5 AS injected, coalesce(toxic, 0) AS rejected, coalesce(quality::DOUBLE, 0) AS feedback
 FROM documents d LEFT JOIN labels b ON b.doc_id = d.doc_id),
w AS (SELECT *, least(greatest((CASE WHEN greatest(created, last_used) > 0 THEN exp(-0.6931471805599453e0 * greatest(200 * 86400 - greatest(created, last_used), 0) / (30e0 * 86400)) ELSE 5e-1 END) * ((hits + injected) + 5e-1) / ((hits + injected) + 3e0) * (injected + 1e0)
 / (injected + 1e0 + 2e0 * rejected) * least(greatest(1e0 + 5e-1 * feedback, 25e-2), 2e0), 1e-3), 1e0) AS weight FROM l),
t AS (SELECT *, created > 0 AND created < 20 * 86400 AS expired, weight < 2e-2 AS low FROM w),
c AS (SELECT *, row_number() OVER (ORDER BY (created > 0 AND 200 * 86400 - created < 7 * 86400)::INT, CASE type WHEN 'result' THEN 0 WHEN 'tool_pattern' THEN 1 WHEN 'memory' THEN 2 WHEN 'prompt' THEN 3 ELSE 4 END, round(weight, 12), created, id) AS spot, count(*) OVER () AS n FROM t WHERE NOT expired AND NOT low),
g AS (SELECT id, type, weight, CASE WHEN expired THEN 'expired' ELSE 'low_score' END AS reason FROM t WHERE expired OR low UNION ALL SELECT id, type, weight, 'over_cap' FROM c WHERE spot <= n - 300)"""

SQL = {
    "a02_usage_summary": f"""WITH {_U}, a AS (SELECT count(*) AS events, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cache_hit_tokens)::BIGINT AS cache_hit_tokens, sum(injected_tokens)::BIGINT AS injected_tokens, sum(slice_hits)::BIGINT AS slice_hits,
 count(*) FILTER (l3_reuse) AS l3_reuses, count(*) FILTER (l3_false_hit) AS l3_false_hits, count(*) FILTER (judged) AS judge_decisions, count(*) FILTER (judged AND called) AS judge_calls, (sum(k * 3) FILTER (judged))::BIGINT AS judge_latency_ms, (sum(k + 40) FILTER (judged AND called))::BIGINT AS judge_prompt_tokens,
 count(*) FILTER (judged AND verdict = 'approved') AS judge_approved, count(*) FILTER (judged AND verdict = 'declined') AS judge_declined, count(*) FILTER (judged AND verdict = 'fail_closed') AS judge_fail_closed, count(*) FILTER (judged AND verdict = 'skipped') AS judge_skipped,
 (sum(tokens_in) FILTER (l3_reuse))::BIGINT AS l3_in, (sum(tokens_out) FILTER (l3_reuse))::BIGINT AS l3_out, (sum(cache_hit_tokens) FILTER (l3_reuse))::BIGINT AS l3_hit FROM u),
p AS (SELECT *, ((tokens_in - cache_hit_tokens - l3_in) * 27e-2 + cache_hit_tokens * 7e-2 + (tokens_out - l3_out) * 27e-2) / 1e6 AS paid, (tokens_in * 27e-2 + tokens_out * 27e-2) / 1e6 AS none,
 ((tokens_in - l3_in - (cache_hit_tokens - l3_hit)) * 27e-2 + (cache_hit_tokens - l3_hit) * 7e-2 + (tokens_out - l3_out) * 27e-2) / 1e6 AS strict, (injected_tokens * 2e-1 / 1e6 + (l3_in * 27e-2 + l3_out * 27e-2) / 1e6) / injected_tokens * 1e6 AS roi FROM a)
SELECT * EXCLUDE (paid, none, strict, roi), round(paid, 9) AS cost_paid, round(strict, 9) AS cost_paid_strict, round(none, 9) AS cost_no_cache, round(none - paid, 9) AS savings, round((none - paid) / none, 9) AS savings_rate, round(roi, 9) AS inject_roi FROM p""",
    "a03_by_provider": f"WITH {_U}, {_BP} SELECT * FROM bp",
    "a04_provider_savings": f"""WITH {_U}, {_BP} SELECT provider, cache_hit_tokens, round(cache_hit_tokens * (CASE provider WHEN 'p1' THEN 5e-1 - 1e-1 WHEN 'p2' THEN 3e-1 - 5e-2 ELSE 27e-2 - 7e-2 END) / 1e6, 9) AS saved, row_number() OVER (ORDER BY provider = '', provider) AS position FROM bp""",
    "r23_l1_check": f"WITH {_U}, {_BP} SELECT provider, exact_events, l1_hit_rate FROM bp WHERE exact_events >= 20 AND l1_hit_rate < 85",
    "a07_rollup": f"WITH {_D} SELECT * FROM d",
    "a06_range_stats": f"""WITH {_D}, r AS (SELECT model, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(cache_hit)::BIGINT AS cache_hit, sum(total)::BIGINT AS total, sum(requests)::BIGINT AS requests, sum(turns)::BIGINT AS turns, count(DISTINCT day) AS active_days
 FROM d WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY model)
SELECT *, round(100e0 * total / sum(total) OVER (), 6) AS percent, row_number() OVER (ORDER BY total DESC, model) AS rank, CASE WHEN instr(model, '/') > 1 THEN split_part(model, '/', 1) ELSE 'default' END AS provider FROM r""",
    "a06_grouping_sets": f"""WITH {_D}, p AS (SELECT *, CASE WHEN instr(model, '/') > 1 THEN split_part(model, '/', 1) ELSE 'default' END AS provider FROM d)
SELECT day, model, provider, grouping(day, model, provider)::BIGINT AS level, sum(total)::BIGINT AS total, sum(requests)::BIGINT AS requests FROM p GROUP BY GROUPING SETS ((day, model), (day, provider), (model), (provider), ())""",
    "j18_day_spine": f"""WITH {_D}, r AS (SELECT day, (sum(CASE WHEN turn THEN 0 ELSE total END))::BIGINT AS total, count(*) FILTER (NOT turn) AS requests FROM s WHERE model = 'm0' AND prompt < 3 GROUP BY day)
SELECT x.day::DATE AS day, coalesce(total, 0) AS total, coalesce(requests, 0) AS requests FROM (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY)) AS day) x LEFT JOIN r ON r.day = x.day""",
    "a22_ledger": """WITH r AS (SELECT event_type || '|' || (user_id % 10) AS key, CASE WHEN user_id % 10 = 3 AND event_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT key, count(DISTINCT currency) AS currencies, count(*) AS entries, CASE WHEN count(DISTINCT currency) = 1 THEN sum(k) / 1e3 END AS amount FROM r GROUP BY key""",
    "a23_quotes": """WITH r AS (SELECT 'm' || (user_id % 6) AS model, CASE WHEN user_id % 6 = 0 OR (user_id % 6 = 1 AND event_id % 2 = 0) THEN NULL ELSE ((k // 2) * 7e-2 + k * 27e-2 + k * 2 * 11e-1) / 1e6 END AS cost FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events))
SELECT model, round(sum(round(cost, 9)), 6) AS cost, bool_and(cost IS NOT NULL) AS complete, count(*) AS rows, count(cost) AS priced, CASE WHEN bool_and(cost IS NOT NULL) THEN 'complete' WHEN count(cost) > 0 THEN 'partial' ELSE 'unknown' END AS status FROM r GROUP BY model""",
    "t11_quota": f"""WITH {_U}, q AS (SELECT session_id, coalesce(sum(CASE WHEN l3_reuse THEN 0 ELSE tokens_in + tokens_out END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM u)
SELECT session_id, CASE WHEN used < 20000 THEN 'free' WHEN used < 60000 THEN 'paid' ELSE 'blocked' END AS mode, count(*) AS n, max(used) AS used FROM q GROUP BY ALL""",
    "w17_rolling_startup": """WITH r AS (SELECT user_id % 50 AS plugin, event_id AS seq, round(value * 10)::BIGINT AS ms FROM events),
f AS (SELECT plugin, seq, list_sort(list(ms) OVER (PARTITION BY plugin ORDER BY seq ROWS 19 PRECEDING)) AS v, min(ms) OVER w AS m, count(*) OVER w AS k FROM r WINDOW w AS (PARTITION BY plugin ORDER BY seq ROWS 2 PRECEDING))
SELECT plugin, seq, len(v)::INT AS n, v[ceil(len(v) * 99e-2)::INT] AS p99, k = 3 AND m >= 400 AS demote FROM f""",
    "a27_startup_p99": """WITH r AS (SELECT user_id AS plugin, round(value * 10)::BIGINT AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS spot FROM events), l AS (SELECT plugin, list(ms ORDER BY ms) AS v, min(ms) FILTER (spot <= 3) AS m FROM r WHERE spot <= 20 GROUP BY plugin)
SELECT plugin, v[greatest(1, ceil(len(v) * 99e-2)::INT)] AS p99, len(v)::INT AS n, m >= 100 AS demote FROM l""",
    "r17_gc_plan": f"WITH {_GC} SELECT id, type, round(weight, 9) AS weight, reason FROM g",
    "a19_evicted_by_type": f"WITH {_GC} SELECT type, count(*) AS evicted FROM g WHERE reason = 'over_cap' GROUP BY type",
    "a16_stats_merge": """SELECT json_extract(props, '$.k')::BIGINT AS slice, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'view') AS injected, max(event_id) AS last_used FROM events GROUP BY slice""",
    "s04_journal_replay": """WITH l AS (SELECT user_id AS id, max(event_id) FILTER (event_type IN ('view', 'error')) AS spot FROM events GROUP BY user_id),
p AS (SELECT l.id, spot, json_extract(props, '$.k')::BIGINT AS body FROM l JOIN events ON event_id = spot WHERE event_type = 'view')
SELECT p.id, body, (SELECT count(*) FROM events e WHERE e.user_id = p.id AND e.event_id > p.spot AND event_type NOT IN ('view', 'error')) + 1 AS hits FROM p""",
}

_REPORTED = ", ".join(f"('{n}', {i + 1}, {n}::DOUBLE)" for i, n in enumerate(usage.REPORTED))
SQL["r22_usage_report"] = f"""WITH m AS ({SQL["a02_usage_summary"]}), p AS ({SQL["a04_provider_savings"]}), b AS ({SQL["a03_by_provider"]})
SELECT 'totals' AS section, v.position::INT AS position, v.name AS name, round(v.value, 9) AS value, '' AS detail FROM m, LATERAL (SELECT * FROM (VALUES {_REPORTED}) AS x(name, position, value)) v
UNION ALL SELECT 'providers', position::INT, CASE WHEN provider = '' THEN '(unattributed)' ELSE provider END, saved, 'hit ' || CASE WHEN exact_events > 0 THEN printf('%.1f%%', l1_hit_rate) ELSE 'n/a' END || ' exact ' || exact_events || '/' || events || ' reuses ' || l3_reuses FROM p JOIN b USING (provider)"""
