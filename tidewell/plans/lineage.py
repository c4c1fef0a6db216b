"""Registered queries of session lineage: conversations with recovered forks that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage
from ..sources.tables import read

#: Version 0 is the conversation itself (lost for some), 1 to 4 are recovered copies: a prefix, a longer one, the same with
#: more or with another end, and an equal of version 2. Some versions 1 and 2 have each other as parents.
_EXISTS = "(v = 0 AND c % 7 <> 3) OR v IN (1, 2) OR (v = 3 AND c % 3 = 0) OR (v = 4 AND c % 4 = 1)"
_PARENT = "CASE WHEN v = 1 AND c % 13 = 5 THEN c * 5 + 2 WHEN v = 1 THEN c * 5 WHEN v = 2 THEN c * 5 + 1 WHEN v = 3 THEN c * 5 + 2 WHEN v = 4 THEN c * 5 END"
_TOPIC = "CASE WHEN v = 0 AND c % 5 <> 0 THEN concat('t', c % 10) WHEN v >= 2 THEN concat('r', c % 6 + v) ELSE '' END"
_COLUMNS = ("c * 5 + v AS id", f"{_PARENT} AS parent", "v > 0 AS recovered", "v = 2 AND c % 11 = 4 AS preferred", f"{_TOPIC} AS topic", "c * 10 - v AS created", "(c * 7 + v * 3) % 10 AS activity", "CAST(v % 3 AS BIGINT) AS turns")


def _forks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    turns = read(spark, folder, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), "role", F.col("text").alias("content"))
    versions = spark.range(5).select(F.col("id").alias("v"))
    forks = turns.groupBy("c").agg(F.max("at").alias("last")).join(F.broadcast(versions), F.expr(_EXISTS))
    rows = forks.selectExpr(*_COLUMNS)
    said = turns.join(forks, "c").filter("v <> 1 OR at < last").select((F.col("c") * 5 + F.col("v")).alias("session"), "at", "role", "content")
    ends = F.expr("CASE WHEN v IN (2, 4) THEN array('and then') WHEN v = 3 AND c % 2 = 0 THEN array('and then', 'more') WHEN v = 3 THEN array('other') END")
    added = forks.select((F.col("c") * 5 + F.col("v")).alias("session"), "last", F.posexplode(ends).alias("k", "content")).select("session", (F.col("last") + 1 + F.col("k")).alias("at"), F.lit("user").alias("role"), "content")
    return rows, said.unionByName(added)


def r31_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.classify(*_forks(spark, folder))


def w16_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Each recovered session with its parent, where that is there, and whether either covers the other."""
    rows, messages = _forks(spark, folder)
    chains = lineage.prefixes(messages)
    whole = lineage.contents(messages, chains).drop("len")
    pairs = rows.filter("recovered").select("id", "parent").join(whole.withColumnRenamed("session", "id"), "id")
    other = whole.select(F.col("session").alias("parent"), F.col("body").alias("body2"), F.col("h").alias("h2"), F.col("g").alias("g2"))
    pairs = pairs.join(other, "parent")
    marks = lambda side, n, h, g, name: chains.select(F.col("session").alias(side), F.col("length").alias(n), F.col("h").alias(h), F.col("g").alias(g), F.lit(True).alias(name))
    pairs = pairs.join(marks("parent", "body", "h", "g", "down"), ["parent", "body", "h", "g"], "left").join(marks("id", "body2", "h2", "g2", "up"), ["id", "body2", "h2", "g2"], "left")
    holds = lambda name, n: F.coalesce(F.col(name), F.lit(False)) | (F.col(n) == 0)
    return pairs.select("id", "parent", holds("down", "body").alias("parent_covers"), holds("up", "body2").alias("covers_parent"))


_FORKS = f"""c AS (SELECT conv_id AS c, list({{'r': role, 't': text}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
f AS (SELECT {', '.join(_COLUMNS)}, CASE WHEN v = 0 THEN m WHEN v = 1 THEN m[1:len(m) - 1] WHEN v IN (2, 4) THEN list_append(m, {{'r': 'user', 't': 'and then'}})
    WHEN c % 2 = 0 THEN list_concat(m, [{{'r': 'user', 't': 'and then'}}, {{'r': 'user', 't': 'more'}}]) ELSE list_append(m, {{'r': 'user', 't': 'other'}}) END AS m FROM c, range(5) AS t(v) WHERE {_EXISTS}),
s AS (SELECT *, len(m) AS n, CASE WHEN m[1].r = 'system' THEN m[2:] ELSE m END AS b FROM f)"""

QUERIES = {f.__name__: f for f in (r31_lineage, w16_coverage)}
SQL = {
    "r31_lineage": f"""WITH RECURSIVE {_FORKS},
w AS (SELECT id, id AS pos, [id] AS path FROM s UNION ALL SELECT w.id, s.parent, list_append(path, s.parent) FROM w JOIN s ON s.id = w.pos WHERE s.recovered AND s.parent IS NOT NULL AND NOT list_contains(path, s.parent)),
o AS (SELECT w.id, s.id IS NOT NULL AND NOT s.recovered AS found, s.id IS NOT NULL AND s.recovered AND s.parent IS NOT NULL AS circ, CASE WHEN circ THEN list_min(path[list_position(path, s.parent):]) ELSE pos END AS origin, circ AND list_position(path, s.parent) = 1 AS in_cycle
    FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) = 1) w LEFT JOIN s ON s.id = w.pos),
g AS (SELECT s.*, o.* EXCLUDE (id), s.recovered AND p.n > 0 AND s.n > 0 AND p.b[1:len(s.b)] = s.b AS early FROM s JOIN o USING (id) LEFT JOIN s p ON p.id = s.parent),
q AS (SELECT *, n > 0 AS there, recovered AND NOT coalesce(early, false) AS member FROM g),
l AS (SELECT a.origin, a.id, a.activity, a.b FROM q a JOIN q m ON m.origin = a.origin AND m.member WHERE a.member AND a.there GROUP BY a.origin, a.id, a.activity, a.b, a.n HAVING a.n = max(m.n) AND bool_and(m.there AND a.b[1:len(m.b)] = m.b)),
lf AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY origin ORDER BY activity DESC, id) = 1),
gr AS (SELECT q.origin, count(*) FILTER (preferred) AS marked, min(id) FILTER (preferred) AS chosen, first(id ORDER BY turns DESC, activity DESC, id) AS fallback FROM q WHERE member GROUP BY origin),
t AS (SELECT origin, first(topic ORDER BY created, id) AS topic FROM q WHERE recovered AND topic <> '' GROUP BY origin),
r AS (SELECT q.*, marked, chosen, fallback, lf.id AS leaf, rt.id IS NOT NULL AND rt.there AND lf.b[1:len(rt.b)] = rt.b AS roots, nullif(rt.topic, '') AS rtopic, t.topic AS ktopic FROM q LEFT JOIN gr ON gr.origin = q.origin LEFT JOIN lf ON lf.origin = q.origin LEFT JOIN q rt ON rt.id = q.origin AND NOT rt.recovered LEFT JOIN t ON t.origin = q.origin),
k AS (SELECT *, coalesce(early, false) OR coalesce(member AND marked <> 1 AND leaf IS NOT NULL AND id <> leaf AND (NOT found OR roots), false) AS copy, CASE WHEN marked = 1 THEN chosen WHEN leaf IS NOT NULL THEN leaf ELSE fallback END AS top FROM r),
z AS (SELECT *, recovered AND NOT copy AND id = top AS canon FROM k)
SELECT id, origin AS group_id, CASE WHEN NOT recovered THEN 'normal' WHEN copy THEN 'covered_copy' WHEN canon AND marked = 1 THEN 'preferred' WHEN canon AND leaf IS NOT NULL AND found AND roots THEN 'adopted' ELSE 'diverged' END AS role,
    canon AS canonical, copy, in_cycle, coalesce(rtopic, ktopic, 'recovery:' || origin) AS logical_topic, NOT recovered OR (canon AND NOT found) AS visible FROM z""",
    "w16_coverage": f"WITH {_FORKS} SELECT s.id, p.id AS parent, p.b[1:len(s.b)] = s.b AS parent_covers, s.b[1:len(p.b)] = p.b AS covers_parent FROM s JOIN s p ON p.id = s.parent WHERE s.recovered AND s.n > 0 AND p.n > 0",
}
