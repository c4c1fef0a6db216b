"""Registered query of the evolution loop: clicks are prefetch hits, errors waste, purchases rejections, views requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evolution
from ..sources.tables import read

_KIND = "CASE event_type WHEN 'click' THEN 'prefetch_hit' WHEN 'error' THEN 'prefetch_waste' WHEN 'purchase' THEN 'slice_reject' ELSE event_type END"


def t05_evolution_loop(spark: SparkSession, folder: str) -> DataFrame:
    """The parameters that each view of a page used, by groups of users."""
    e = read(spark, folder, "events").select((F.col("user_id") % 10).alias("key"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"))
    found = evolution.as_of(e.filter("kind = 'view'").select("key", "seq"), evolution.ticks(e))
    return found.select("key", "seq", "version", F.round("tau", 6).alias("tau"), F.round("conf", 6).alias("conf"))


QUERIES = {"t05_evolution_loop": t05_evolution_loop}
SQL = {
    "t05_evolution_loop": f"""WITH RECURSIVE e AS (SELECT user_id % 10 AS key, event_id AS seq, {_KIND} AS kind FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM e WHERE kind IN ('prefetch_hit', 'prefetch_waste', 'slice_reject')),
f AS (SELECT key, 0::BIGINT AS i, -1::BIGINT AS seq, 0e0 AS pol, 0e0 AS h, 0e0 AS w, 55e-2 AS tau, 5e-1 AS conf, 0::BIGINT AS frozen, 0::BIGINT AS version, false AS changed FROM (SELECT DISTINCT key FROM s)
  UNION ALL SELECT key, i, seq, pol, h, w, tau2, conf2, CASE WHEN tau2 <> tau OR conf2 <> conf THEN i + 60 ELSE frozen END, version + (tau2 <> tau OR conf2 <> conf)::BIGINT, tau2 <> tau OR conf2 <> conf
  FROM (SELECT *, CASE WHEN live AND pol >= 3e-1 THEN least(greatest(tau + 5e-2, 3e-1), 8e-1) ELSE tau END AS tau2, CASE WHEN NOT live OR h = w THEN conf WHEN w > h THEN least(conf + 5e-2, 95e-2) ELSE greatest(conf - 5e-2, 5e-2) END AS conf2
  FROM (SELECT f.key, s.i, s.seq, CASE kind WHEN 'slice_reject' THEN 1e-1 + 9e-1 * pol ELSE pol END AS pol, CASE kind WHEN 'prefetch_hit' THEN 1e-1 + 9e-1 * h WHEN 'prefetch_waste' THEN 9e-1 * h ELSE h END AS h,
    CASE kind WHEN 'prefetch_waste' THEN 1e-1 + 9e-1 * w WHEN 'prefetch_hit' THEN 9e-1 * w ELSE w END AS w, tau, conf, frozen, version, s.i >= greatest(60, frozen) AS live FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)))
SELECT e.key, e.seq, t.version, round(t.tau, 6) AS tau, round(t.conf, 6) AS conf FROM e ASOF JOIN (SELECT * FROM f WHERE changed OR i = 0) t ON t.key = e.key AND e.seq > t.seq WHERE e.kind = 'view'"""
}
