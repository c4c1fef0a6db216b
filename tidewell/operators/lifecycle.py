"""The library's lifecycle: journal replay, scoring, retention and capped eviction, archive before removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.cuts import with_position
from ..sources import logs
from ..sources.tables import read


def library(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and labels as slices with statistics; ages follow from ids."""
    d = read(spark, folder, "documents").join(read(spark, folder, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    kinds = F.array(*map(F.lit, ("prompt", "context", "tool_pattern", "result", "memory")))
    return d.select(
        F.col("doc_id").alias("id"),
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("type"),
        F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("doc_id") * 7 % 199 * 86400).alias("created"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 11 % 200 * 86400).otherwise(0).alias("last_used"),
        (F.col("n_chars") % 9).alias("hits"),
        (F.col("n_chars") % 5).alias("injected"),
        F.coalesce("toxic", F.lit(0)).alias("rejected"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("feedback"),
    )


def rescore(slices: DataFrame, now: int) -> DataFrame:
    return slices.withColumn("weight", numeric.value_weight(F.col("created"), F.col("last_used"), F.col("hits"), F.col("injected"), F.col("rejected"), F.col("feedback"), F.lit(now)))


def gc_plan(slices: DataFrame, now: int, retention_days: int, min_weight: float, most: int, grace_days: float = 7.0) -> DataFrame:
    """The slices to remove, with the reason: expired, low_score or over_cap.

    Unknown ages (0) never expire; the cap spares none. Its order: not under grace first, by type, weight, age (unknown
    first), id. The cap's rank is global: rows are dealt by ranges of that order.
    """
    scored = rescore(slices, now)
    expired = (F.col("created") > 0) & (F.col("created") < now - retention_days * 86400)
    low = (F.col("weight") > 0) & (F.col("weight") < min_weight)
    marked = scored.select("id", "type", "created", "weight", expired.alias("expired"), low.alias("low"))
    gone = marked.filter("expired or low").select("id", "type", "weight", F.when(F.col("expired"), "expired").otherwise("low_score").alias("reason"))
    live = marked.filter("not expired and not low")
    grace = ((F.col("created") > 0) & (now - F.col("created") < grace_days * 86400)).cast("int")
    over = live.count() - most
    if over <= 0:
        return gone
    order = (grace, numeric.evict_priority(F.col("type")), F.round("weight", 12), "created", "id")
    return gone.union(with_position(live, *order).filter(F.col("at") <= over).select("id", "type", "weight", F.lit("over_cap").alias("reason")))


def collect_garbage(slices: DataFrame, plan: DataFrame, archive: str) -> DataFrame:
    """Archive the planned slices, then give the ones that stay; a crash in between leaves duplicates only."""
    slices.join(plan.select("id", "reason"), "id").write.mode("append").parquet(archive)
    return slices.join(plan.select("id"), "id", "left_anti")


def replay(journal: DataFrame) -> DataFrame:
    """(id, body, hits): the state after a journal of put (last wins), del and stat (adds to hits since the last put or del).

    `journal`: id, position, op, body, hits. One aggregate finds the last put or del of each id, a second adds what follows.
    """
    window = Window.partitionBy("id")
    last = F.max(F.when(F.col("op").isin("put", "del"), F.struct("position", "op", "body", "hits"))).over(window)
    rows = journal.withColumn("last", last).filter(F.col("last.op") == "put")
    later = F.when((F.col("op") == "stat") & (F.col("position") > F.col("last.position")), F.col("hits")).otherwise(0)
    return rows.groupBy("id").agg(F.first("last.body").alias("body"), (F.sum(later) + F.first("last.hits")).alias("hits"))


def base_slices(lines: DataFrame) -> tuple[DataFrame, int]:
    """Slices of a JSONL base (column value), and how many lines were skipped as corrupt, too long or without an id."""
    scanned = logs.scan(lines, "ID string, Type int, Scope int, Content string, Weight double, created_at bigint", "ID")
    good = logs.records(scanned)
    skipped = scanned.filter("status not in ('ok', 'blank')").count()
    return good.withColumn("content", F.decode(F.unbase64("Content"), "UTF-8")).withColumn("kind", F.element_at(F.array(*map(F.lit, text.TYPES)), F.col("Type") + 1)), skipped
