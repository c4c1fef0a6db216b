"""Calibration under settings that change: thresholds by slice type, as of each row's time, and what they decide against the
defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.numeric import Zones

FIELDS = ("tau_high", "tau_low", "abs_high", "abs_low")
#: Rows of a history of settings, which people change, not events: it is held beside every row, at 64 bytes each.
MOST_SETTINGS = 100_000


def with_settings(rows: DataFrame, settings: DataFrame, at: str = "at", type_: str = "type") -> DataFrame:
    """Adds `zones` (FIELDS) to each row: of the last snapshot that began at or before the row's time, the thresholds of its type,
    else those of all types (type null); the defaults before the first snapshot and where a snapshot has neither. `settings`:
    since, type, FIELDS; a snapshot is all rows of one `since` and takes nothing over from those before. Of rows that repeat
    (since, type) the largest counts.
    """
    unique = settings.groupBy("since", "type").agg(F.max(F.struct(*FIELDS)).alias("z"))
    if unique.count() > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} rows of settings")
    history = unique.agg(F.array_sort(F.collect_list(F.struct("since", "type", "z"))).alias("__history"))
    joined = rows.join(F.broadcast(history))  # one row
    begun = F.filter("__history", lambda s: s["since"] <= F.col(at))
    since = F.array_max(F.transform(begun, lambda s: s["since"]))
    now = F.filter(begun, lambda s: s["since"] == F.col("__since"))
    own = F.filter("__now", lambda s: s["type"] == F.col(type_))
    all_ = F.filter("__now", lambda s: s["type"].isNull())
    default = F.struct(*[F.lit(getattr(Zones(), f)).alias(f) for f in FIELDS])
    zones = F.coalesce(F.get(own, F.lit(0))["z"], F.get(all_, F.lit(0))["z"], default)
    return joined.withColumn("__since", since).withColumn("__now", now).withColumn("zones", zones).drop("__history", "__since", "__now")


def _zone(z) -> Column:
    return numeric.winner_zone(F.col("top1"), F.col("top2"), z)


def judged(rows: DataFrame) -> DataFrame:
    """Adds `zone` under the row's `zones`, `default_zone` and `ratio` of the second best to the best. `rows`: type, top1, top2."""
    own = Zones(**{f: F.col(f"zones.{f}") for f in FIELDS})
    ratio = F.when(F.col("top1") > 0, F.coalesce("top2", F.lit(0.0)) / F.col("top1")).otherwise(0.0)
    return rows.withColumn("zone", _zone(own)).withColumn("default_zone", _zone(Zones())).withColumn("ratio", ratio)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(100.0 * a / b, 6))


def bins_by_type(rows: DataFrame) -> DataFrame:
    """Per type, and for all together (type null), and per tenth of the ratio: rows, zones, share of hits, the mean best score,
    and the precision of hits where labels (`relevant`) say so. Tenths without rows are absent. `rows`: as `judged` gives them."""
    z = lambda name: F.count_if(F.col("zone") == name)
    wrong = F.count_if((F.col("zone") == "hit") & ~F.coalesce("relevant", F.lit(True)))
    sums = rows.withColumn("bin", numeric.calibration_bin(F.col("ratio"))).cube("type", "bin").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), z("hit").alias("hit"), z("grey").alias("grey"), z("miss").alias("miss"), wrong.alias("wrong"), F.avg("top1").alias("mean")
    )
    # Levels: 0 by type and tenth, 2 by tenth alone.
    kept = sums.filter(F.col("level").isin(0, 2))
    return kept.select(
        F.when(F.col("level") == 2, "*").otherwise(F.col("type")).alias("type"), "bin", "n", "hit", "grey", "miss", _share(F.col("hit"), F.col("n")).alias("hit_percent"), F.round("mean", 6).alias("mean_top1"), _share(F.col("hit") - F.col("wrong"), F.col("hit")).alias("precision")
    )


def drift(rows: DataFrame) -> DataFrame:
    """Per type, and for all together (``*``): what the settings of the time decide and what the defaults would, and the
    difference in points of a hundred."""
    z = lambda column, name: F.count_if(F.col(column) == name)
    names = ("hit", "grey", "miss")
    counts = [F.count(F.lit(1)).alias("n"), *[z("zone", n).alias(n) for n in names], *[z("default_zone", n).alias(f"default_{n}") for n in names], F.count_if(F.col("zone") != F.col("default_zone")).alias("moved")]
    sums = rows.rollup("type").agg(F.grouping_id().alias("level"), *counts)
    points = [F.round(100.0 * (F.col(n) - F.col(f"default_{n}")) / F.col("n"), 6).alias(f"{n}_drift") for n in names]
    return sums.select(F.when(F.col("level") == 1, "*").otherwise(F.col("type")).alias("type"), "n", *names, *[f"default_{n}" for n in names], "moved", *points)
