"""Round planning, progress scoring, dependency checks and request decisions over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text

#: Gains of a command's outcome. Fixed values.
NEW_COMMAND, NEW_FAILURE, REPEAT_FAILURE, STATE_CHANGE = 2, 1, 0, 3


def command_gains(runs: DataFrame) -> DataFrame:
    """Adds `gain`: what running a command tells, by what the session saw of it before. `runs`: session, seq, command, ok.

    A failure counts less when the command's last run failed too; a success after a failure is a change of state; a success
    seen before tells nothing.
    """
    order = Window.partitionBy("session", "command").orderBy("seq")
    seen, failed = F.row_number().over(order) > 1, F.coalesce(~F.lag("ok").over(order), F.lit(False))
    gain = F.when(~F.col("ok"), F.when(failed, REPEAT_FAILURE).otherwise(NEW_FAILURE)).when(failed, STATE_CHANGE).when(seen, 0).otherwise(NEW_COMMAND)
    return runs.withColumn("gain", gain)


def stale_slices(slices: DataFrame, dependencies: DataFrame, current: DataFrame) -> DataFrame:
    """Adds `fresh`: all dependencies (id, path, digest) of a slice are as the current files (path, digest) say; slices
    without dependencies are fresh only if marked safe. `slices`: id, safe."""
    broken = dependencies.join(current.withColumnRenamed("digest", "now"), "path", "left").filter(~F.col("digest").eqNullSafe(F.col("now"))).select("id").distinct().withColumn("broken", F.lit(True))
    known = dependencies.select("id").distinct().withColumn("has", F.lit(True))
    rows = slices.join(known, "id", "left").join(broken, "id", "left")
    return rows.withColumn("fresh", F.when(F.col("has"), F.col("broken").isNull()).otherwise(F.col("safe"))).drop("has", "broken")


def tier(intent: Column, writers: Column, calls: Column, most: int = 3) -> Column:
    """The reason for a model tier; the first rule that holds wins."""
    low = F.lower(F.trim(intent))
    return F.when(low.isin("mutation", "persistent_action"), F.concat(F.lit("intent:"), low)).when(F.size(writers) > 0, F.concat(F.lit("writer:"), F.element_at(writers, 1))).when(calls > most, F.concat(F.lit("complex:"), calls.cast("string"))).otherwise("default")


def round_plan(calls: DataFrame, suspended: tuple[str, ...], most: int = 3) -> DataFrame:
    """Per round: the tools left after suspension, in canonical order, the tier's reason, the budget's measure.

    `calls`: session, round_no, name, read_only, spent, budget, intent.
    """
    rows = calls.groupBy("session", "round_no").agg(
        F.array_sort(F.array_distinct(F.collect_list("name"))).alias("names"),
        F.array_sort(F.collect_set(F.when(~F.col("read_only"), F.col("name")))).alias("writers"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("spent").alias("spent"),
        F.max("budget").alias("budget"),
        F.max("intent").alias("intent"),
    )
    left = F.array_except("names", F.array(*map(F.lit, suspended)))
    return rows.select("session", "round_no", F.array_join(left, ",").alias("tools"), tier(F.col("intent"), F.col("writers"), F.col("calls"), most).alias("reason"), numeric.budget_action(F.col("spent"), F.col("budget")).alias("action"))


def decide_requests(requests: DataFrame) -> DataFrame:
    """What becomes of each request: reuse, inject or forward, and whether it flags the reuse before it as false.

    `requests`: session, seq, query, result_zone, hit_zone. A reuse needs a result hit; an injection a hit of any type.
    """
    decided = requests.withColumn("decision", F.when(F.col("result_zone") == "hit", "reuse").when(F.col("hit_zone") == "hit", "inject").otherwise("forward"))
    order = Window.partitionBy("session").orderBy("seq")
    alike = text.edit_similarity(F.lag("query").over(order), F.col("query"))
    false_hit = (F.lag("decision").over(order) == "reuse") & (alike >= 0.6)
    return decided.withColumn("false_hit", F.coalesce(false_hit, F.lit(False)))
