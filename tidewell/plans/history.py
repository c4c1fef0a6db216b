"""Registered query of full-text search over history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..sources.tables import questions, read


def r28_history_search(spark: SparkSession, folder: str) -> DataFrame:
    """Two pages of conversation lines for each benchmark item: its second and third word as a phrase, its fourth to sixth alone."""
    word = F.split(F.regexp_replace("query", '[^\\p{L}]+', " "), " ")
    at = lambda i: F.coalesce(F.get(word, F.lit(i)), F.lit(""))
    asked = questions(spark, folder).select("query_id", F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" '), at(3), F.lit(" "), at(4), F.lit(" "), at(5)).alias("query"))
    lines = read(spark, folder, "conversations").filter("role <> 'system'")
    docs = lines.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("content"))
    found = history.search(asked, docs).select("query_id", F.col("id.conv_id").alias("path"), F.col("id.turn").alias("idx"), "score")
    first = history.page(found)
    last = first.groupBy("query_id").agg(F.max_by(F.struct("score", "path", "idx"), "rank").alias("k")).select("query_id", "k.*")
    second = history.page(found, after=last)
    return first.withColumn("page", F.lit(1)).unionByName(second.withColumn("page", F.lit(2)))


QUERIES = {"r28_history_search": r28_history_search}
SQL = {
    "r28_history_search": r"""WITH q AS (SELECT item_id AS query_id, string_split(regexp_replace(text, '[^\p{L}]+', ' ', 'g'), ' ') AS w FROM benchmark),
p AS (SELECT DISTINCT query_id, ph FROM (SELECT query_id, unnest([list_filter([coalesce(w[2], ''), coalesce(w[3], '')], lambda x: x <> ''), list_filter([coalesce(w[4], '')], lambda x: x <> ''), list_filter([coalesce(w[5], '')], lambda x: x <> ''), list_filter([coalesce(w[6], '')], lambda x: x <> '')]) AS f, list_transform(f, lambda x: lower(strip_accents(x))) AS ph FROM q) WHERE len(ph) > 0),
d AS (SELECT conv_id AS path, turn AS idx, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), lambda x: strip_accents(x)) AS t FROM conversations WHERE role <> 'system'),
st AS (SELECT count(*) AS docs, sum(len(t)) AS total FROM d),
u AS (SELECT path, idx, len(t) AS length, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM d),
dp AS (SELECT DISTINCT ph FROM p),
f AS (SELECT ph, a.path, a.idx, a.length, count(*) AS tf FROM dp JOIN u a ON a.tok = ph[1] LEFT JOIN u b ON b.path = a.path AND b.idx = a.idx AND b.pos = a.pos + 1 AND b.tok = ph[2] WHERE len(ph) = 1 OR b.tok IS NOT NULL GROUP BY ALL),
n AS (SELECT ph, count(*) AS n FROM f GROUP BY ph),
s AS (SELECT query_id, path, idx, round(sum(greatest(ln((docs - n + 5e-1) / (n + 5e-1)), 1e-6) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * length / (total / docs)))), 6) AS score FROM p JOIN f USING (ph) JOIN n USING (ph), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, idx) AS k FROM s)
SELECT query_id, path, idx, score, ((k - 1) % 8 + 1)::INT AS rank, ((k - 1) // 8 + 1)::INT AS page FROM r WHERE k <= 16"""
}
