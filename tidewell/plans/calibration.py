"""Registered queries of calibration by type: events as searches with two best scores, under two snapshots of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TYPES
from ..operators import calibration
from ..sources.tables import events

#: From event 1,000 thresholds of all types and of results; from 6,000 of all types, prompts and results. Before, the defaults.
_SETTINGS = [(1000, None, 0.8, 0.5, 0.6, 0.3), (1000, "result", 0.9, 0.7, 0.8, 0.5), (6000, None, 0.8, 0.6, 0.7, 0.4), (6000, "prompt", 0.7, 0.3, 0.5, 0.2), (6000, "result", 0.95, 0.8, 0.9, 0.6)]


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    types = F.array(*map(F.lit, TYPES))
    rows = events(spark, folder).select(
        F.element_at(types, (F.col("user_id") % 5 + 1).cast("int")).alias("type"),
        F.col("event_id").alias("at"),
        (F.floor("value") % 100 / 100).alias("top1"),
        (F.floor("value") % 100 / 100 * F.col("k") / 100).alias("top2"),
        F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("relevant"),
    )
    settings = spark.createDataFrame(_SETTINGS, "since long, type string, tau_high double, tau_low double, abs_high double, abs_low double")
    return calibration.judged(calibration.with_settings(rows, settings))


def a14_bins_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.bins_by_type(_judged(spark, folder))


def n07_settings_drift(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.drift(_judged(spark, folder))


_ROWS = """z(since, type, tau_low, abs_high, abs_low) AS (VALUES (1000, NULL, 5e-1, 6e-1, 3e-1), (1000, 'result', 7e-1, 8e-1, 5e-1), (6000, NULL, 6e-1, 7e-1, 4e-1), (6000, 'prompt', 3e-1, 5e-1, 2e-1), (6000, 'result', 8e-1, 9e-1, 6e-1)),
e AS (SELECT ['prompt', 'context', 'tool_pattern', 'result', 'memory'][user_id % 5 + 1] AS type, event_id AS pos, (floor(value)::BIGINT % 100)::DOUBLE / 1e2 AS top1, (floor(value)::BIGINT % 100)::DOUBLE / 1e2 * (json_extract(props, '$.k')::BIGINT)::DOUBLE / 1e2 AS top2,
    CASE WHEN event_type <> 'signup' THEN event_type <> 'error' END AS relevant, CASE WHEN event_id >= 6000 THEN 6000 WHEN event_id >= 1000 THEN 1000 END AS since FROM events),
s AS (SELECT e.*, coalesce(o.tau_low, g.tau_low, 55e-2) AS tl, coalesce(o.abs_high, g.abs_high, 7e-1) AS ah, coalesce(o.abs_low, g.abs_low, 45e-2) AS al FROM e LEFT JOIN z o ON o.since = e.since AND o.type = e.type LEFT JOIN z g ON g.since = e.since AND g.type IS NULL),
j AS (SELECT *, CASE WHEN top1 <= 0 OR top1 < al THEN 'miss' WHEN top1 >= ah AND top1 - top2 >= tl * top1 THEN 'hit' ELSE 'grey' END AS zone, CASE WHEN top1 <= 0 OR top1 < 45e-2 THEN 'miss' WHEN top1 >= 7e-1 AND top1 - top2 >= 55e-2 * top1 THEN 'hit' ELSE 'grey' END AS dz,
    CASE WHEN top1 > 0 THEN top2 / top1 ELSE 0e0 END AS ratio FROM s)"""

QUERIES = {f.__name__: f for f in (a14_bins_by_type, n07_settings_drift)}
SQL = {
    "a14_bins_by_type": f"""WITH {_ROWS}, b AS (SELECT *, least(9, floor(ratio * 10))::INT AS bin FROM j), t AS (SELECT type, * EXCLUDE (type) FROM b UNION ALL SELECT '*', * EXCLUDE (type) FROM b),
c AS (SELECT type, bin, count(*) AS n, count(*) FILTER (zone = 'hit') AS hit, count(*) FILTER (zone = 'grey') AS grey, count(*) FILTER (zone = 'miss') AS miss, count(*) FILTER (zone = 'hit' AND NOT relevant) AS wrong, round(avg(top1), 6) AS mean_top1 FROM t GROUP BY type, bin)
SELECT type, bin, n, hit, grey, miss, round(1e2 * hit / n, 6) AS hit_percent, mean_top1, CASE WHEN hit > 0 THEN round(1e2 * (hit - wrong) / hit, 6) END AS precision FROM c""",
    "n07_settings_drift": f"""WITH {_ROWS}, t AS (SELECT type, zone, dz FROM j UNION ALL SELECT '*', zone, dz FROM j),
c AS (SELECT type, count(*) AS n, count(*) FILTER (zone = 'hit') AS hit, count(*) FILTER (zone = 'grey') AS grey, count(*) FILTER (zone = 'miss') AS miss, count(*) FILTER (dz = 'hit') AS default_hit, count(*) FILTER (dz = 'grey') AS default_grey, count(*) FILTER (dz = 'miss') AS default_miss, count(*) FILTER (zone <> dz) AS moved FROM t GROUP BY type)
SELECT *, round(1e2 * (hit - default_hit) / n, 6) AS hit_drift, round(1e2 * (grey - default_grey) / n, 6) AS grey_drift, round(1e2 * (miss - default_miss) / n, 6) AS miss_drift FROM c""",
}
