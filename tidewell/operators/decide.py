"""Reuse decisions: gates in order of cost, packing into a byte budget, judge chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric


#: A clear hit with a smaller share of lexical support is a grey one. Fixed value.
LEXICAL_FLOOR = 0.05


def reuse(candidates: DataFrame, now: int, ttl: int, zones: numeric.Zones = numeric.Zones(), lexical_floor: float = LEXICAL_FLOOR) -> DataFrame:
    """The first result, in order of score and id, that passes all gates; per query and scope with counts of why not.

    `candidates`: query_id, scope, id, type, score, created, same_context, fresh_files, quality (a judge's verdict for grey
    ones: 1 approves) and optionally lexical. Gates: the worse of the two-axis and the freshness zone, context isolation, file
    fingerprints, judge. With `lexical`, the share of the best lexical score (null: not measured, never held against it), a hit
    under `lexical_floor` goes to the judge like a grey one; these are counted as n_unsupported.
    """
    window = Window.partitionBy("query_id", "scope")
    tops = candidates.withColumn("global_top", F.max("score").over(window)).withColumn("result_top", F.max(F.when(F.col("type") == "result", F.col("score"))).over(window))
    rows = tops.filter("type = 'result'")
    lexical = numeric.reuse_zone(F.col("score"), F.col("result_top"), F.col("global_top"), zones)
    age = numeric.freshness_zone(F.col("created"), F.lit(now), F.lit(ttl))
    worse = F.when((lexical == "miss") | (age == "miss"), "miss").when((lexical == "grey") | (age == "grey"), "grey").otherwise("hit")
    measured = "lexical" in candidates.columns
    blocked = (worse == "hit") & F.coalesce(F.col("lexical") < lexical_floor, F.lit(False)) if measured else F.lit(False)
    rows = rows.withColumn("z", F.when(blocked, "grey").otherwise(worse)).withColumn("blocked", blocked)
    gate = F.when(F.col("z") == "miss", "zone").when(~F.col("same_context"), "isolated").when(~F.col("fresh_files"), "files").when((F.col("z") == "grey") & (F.coalesce("quality", F.lit(0)) != 1), "judge").otherwise("pass")
    rows = rows.withColumn("gate", gate)
    first = F.min(F.when(F.col("gate") == "pass", F.struct((-F.col("score")).alias("o"), F.col("id"))))
    count = lambda name: F.count_if(F.col("gate") == name)
    return rows.groupBy("query_id", "scope").agg(
        F.when(F.count_if(F.col("gate") == "pass") > 0, "reuse").otherwise("forward").alias("outcome"),
        first["id"].alias("id"),
        F.count_if(F.col("z") == "grey").alias("n_grey"),
        count("isolated").alias("n_isolated"),
        count("files").alias("n_files"),
        count("judge").alias("n_judge_reject"),
        *([F.count_if("blocked").alias("n_unsupported")] if measured else []),
    )


#: What a block costs besides contents: its opening, its closing, a reserve. Fixed values.
OPEN_BYTES, CLOSE_BYTES, RESERVE_BYTES = len("[reuse]\n"), len("[/reuse]"), 64


def pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Greedy packing in order of score: a slice that does not fit is left out, smaller ones after it may still fit; the first
    always fits. Per query and scope: ids (in canonical order), used bytes, dropped.

    `ranked`: query_id, scope, id, score, bytes, rank; a query's candidates are as few as its top-k.
    """
    item = F.struct("rank", "id", F.col("bytes").cast("long").alias("bytes"), F.octet_length(F.format_string("--- slice %d (score=%.2f) ---\n", F.col("id"), F.col("score"))).alias("head"))
    lists = ranked.groupBy("query_id", "scope").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(OPEN_BYTES).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"), F.lit(0).alias("dropped"))

    def step(s, x):
        full = (s["used"] + x["bytes"] + CLOSE_BYTES + RESERVE_BYTES > budget) & (F.size(s["ids"]) > 0)
        taken = F.struct((s["used"] + x["head"] + x["bytes"] + 1).alias("used"), F.concat(s["ids"], F.array(x["id"])).alias("ids"), s["dropped"].alias("dropped"))
        return F.when(full, F.struct(s["used"].alias("used"), s["ids"].alias("ids"), (s["dropped"] + 1).alias("dropped"))).otherwise(taken)

    folded = lists.withColumn("s", F.aggregate("items", start, step))
    return folded.select("query_id", "scope", F.array_join(F.array_sort("s.ids"), ",").alias("ids"), F.col("s.used").alias("used"), F.col("s.dropped").alias("dropped"))


def judge_chain(candidates: DataFrame) -> DataFrame:
    """fingerprint, then zone, then judge: per row the verdict and whether the judge was called.

    `candidates`: same_files (boolean), zone, verdict (yes, no, error or null of a judge).
    """
    called = F.col("same_files") & (F.col("zone") == "grey")
    verdict = (
        F.when(~F.col("same_files"), "fingerprint_reject")
        .when(F.col("zone") == "miss", "zone_reject")
        .when(F.col("zone") == "hit", "approved")
        .when(F.col("verdict") == "yes", "approved")
        .when(F.col("verdict") == "no", "declined")
        .otherwise("fail_closed")
    )
    return candidates.withColumn("judge_called", called).withColumn("decision", verdict)
