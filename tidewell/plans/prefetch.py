"""Registered queries of the online prefetcher over events as tool steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefetch
from .sessions import steps

#: Smaller than the defaults, so that all channels occur in short sessions.
SETTINGS = prefetch.Settings(min_conf=0.25, epsilon=0.5, probation_interval=3)


def _plans(spark: SparkSession, folder: str) -> DataFrame:
    """All steps of all users; everything but purchases is read-only."""
    return prefetch.online_plans(steps(spark, folder).select("session", "seq", "name", (F.col("name") != "purchase").alias("read_only")), SETTINGS)


def r14_online_plan(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.transform(F.arrays_zip("targets", "channels"), lambda x: F.concat_ws(":", x["targets"], x["channels"]))
    return _plans(spark, folder).select("session", "seq", F.array_join(pairs, ",").alias("plan"), "read_only_call", "covered", "hits", "wastes")


def t04_markov_prefetch(spark: SparkSession, folder: str) -> DataFrame:
    return prefetch.summary(_plans(spark, folder))


#: The fold as a recursion over each user's steps: tools are positions in a list, so state is lists of numbers.
_FOLD = """WITH RECURSIVE tl AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS t, count(DISTINCT event_type) AS k FROM events),
e AS (SELECT user_id AS session, event_id AS seq, event_type AS name, event_type <> 'purchase' AS ro, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
    CAST('0x' || substr(md5(user_id || ':' || event_id), 1, 8) AS BIGINT) / 4294967296e0 AS d FROM events),
f AS (SELECT session, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::VARCHAR AS prev, list_transform(range(k * k), lambda x: 0::BIGINT) AS c, list_transform(t, lambda x: false) AS r, list_transform(t, lambda x: 0e0) AS h, list_transform(t, lambda x: 0e0) AS w,
    list_transform(t, lambda x: 0::BIGINT) AS p, []::VARCHAR[] AS goal, []::VARCHAR[] AS how, false AS called, false AS covered, 0::BIGINT AS hits, 0::BIGINT AS wastes FROM (SELECT DISTINCT user_id AS session FROM events), tl
  UNION ALL SELECT session, i, seq, name, c, r, h, w, p, CASE WHEN len(base) > 0 THEN base WHEN len(rest) > 0 AND d < 5e-1 THEN [rest[1].t] ELSE [] END, CASE WHEN len(base) > 0 THEN list_transform(base, lambda x: CASE WHEN list_contains(bad, x) THEN 'probation' ELSE 'likely' END) WHEN len(rest) > 0 AND d < 5e-1 THEN ['probe'] ELSE [] END,
    called, covered, hits, wastes FROM (SELECT *, CASE WHEN len(bad) > 0 AND turn % 3 = 0 THEN list_append(list_transform(good[1:2], lambda x: x.t), bad[((turn // 3 - 1) % len(bad) + 1)::BIGINT]) ELSE list_transform(good[1:3], lambda x: x.t) END AS base
  FROM (SELECT *, list_sort(list_filter(cand, lambda x: NOT x.bad AND -x.m / total >= 25e-2)) AS good, list_sort(list_filter(cand, lambda x: NOT x.bad AND -x.m / total < 25e-2)) AS rest, list_transform(list_sort(list_filter(cand, lambda x: x.bad)), lambda x: x.t) AS bad, p[pos] AS turn
  FROM (SELECT * EXCLUDE (p), CASE WHEN total > 0 THEN list_transform(p, lambda x, j: x + (j = pos)::BIGINT) ELSE p END AS p, list_filter(list_transform(t, lambda x, j: {'m': -c[(pos - 1) * k + j], 't': x, 'bad': h[j] + w[j] > 0 AND (h[j] + 1) / (h[j] + w[j] + 2) < 25e-2, 'ok': r[j]}), lambda x: x.m < 0 AND x.ok) AS cand
  FROM (SELECT *, list_sum(c[(pos - 1) * k + 1:pos * k])::BIGINT AS total
  FROM (SELECT f.session, e.i, e.seq, e.name, e.d, t, k, list_position(t, e.name) AS pos, f.p, CASE WHEN prev IS NULL THEN c ELSE list_transform(c, lambda x, j: x + (j = (list_position(t, prev) - 1) * k + list_position(t, e.name))::BIGINT) END AS c,
    CASE WHEN prev IS NULL OR NOT ro THEN r ELSE list_transform(r, lambda x, j: x OR j = list_position(t, e.name)) END AS r,
    list_transform(h, lambda x, j: CASE WHEN list_contains(goal, t[j]) THEN 8e-1 * x + (t[j] = e.name)::INT ELSE x END) AS h, list_transform(w, lambda x, j: CASE WHEN list_contains(goal, t[j]) THEN 8e-1 * x + (t[j] <> e.name)::INT ELSE x END) AS w,
    prev IS NOT NULL AND ro AS called, prev IS NOT NULL AND ro AND list_contains(goal, e.name) AS covered, list_contains(goal, e.name)::BIGINT AS hits, len(goal) - list_contains(goal, e.name)::BIGINT AS wastes
  FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1, tl))))))"""

QUERIES = {f.__name__: f for f in (r14_online_plan, t04_markov_prefetch)}
SQL = {
    "r14_online_plan": _FOLD + " SELECT session, seq, array_to_string(list_transform(goal, lambda x, j: x || ':' || how[j]), ',') AS plan, called AS read_only_call, covered, hits, wastes FROM f WHERE i > 0",
    "t04_markov_prefetch": _FOLD
    + """, s AS (SELECT session, count(*) FILTER (called) AS calls, count(*) FILTER (covered) AS covered, sum(hits)::BIGINT AS hits, sum(wastes)::BIGINT AS wastes, (sum(hits) + sum(wastes))::DOUBLE AS n FROM f WHERE i > 0 GROUP BY session),
m AS (SELECT *, (hits + 1e0) / (n + 2) AS mu FROM s)
SELECT session, calls, covered, hits, wastes, CASE WHEN calls > 0 THEN round(covered / calls, 6) ELSE 0 END AS coverage, CASE WHEN n > 0 THEN round(hits / n, 6) ELSE 0 END AS accuracy,
    CASE WHEN n > 0 THEN round((mu + 2.706025 / (2 * n) - 1.645 * sqrt(mu * (1 - mu) / n + 2.706025 / (4 * n * n))) / (1 + 2.706025 / n), 6) ELSE 0 END AS low FROM m""",
}
