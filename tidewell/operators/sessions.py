"""Sessions as ordered rows: turns, rounds, transitions, retries, extraction of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.cuts import with_position


def turns(lines: DataFrame) -> DataFrame:
    """Adds `turn_no`: a new turn starts at each user line. `lines`: session, line, role, content."""
    window = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(window))


def final_results(lines: DataFrame) -> DataFrame:
    """The last assistant line of each session."""
    own = lines.filter("role = 'assistant'")
    return own.groupBy("session").agg(F.max("line").alias("line"), F.max_by("content", "line").alias("content"))


def context(lines: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """The lines within `around` of each hit (session, hit) of the same session."""
    return lines.join(hits, "session").filter(F.abs(F.col("line") - F.col("hit")) <= around)


def transitions(steps: DataFrame) -> DataFrame:
    """(prev, next, n, probability) of neighbouring steps. `steps`: session, seq, name."""
    following = F.lead("name").over(Window.partitionBy("session").orderBy("seq"))
    counted = steps.select(F.col("name").alias("prev"), following.alias("next")).filter("next is not null").groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prev")), 6))


def prefetch_plan(counted: DataFrame, whitelist: tuple[str, ...], budget: int = 1000, cost: int = 200, most: int = 3) -> DataFrame:
    """Per step: the likeliest allowed next steps within the budget; equal costs make the greedy prefix a rank."""
    allowed = counted.filter(F.col("next").isin(*whitelist))
    order = Window.partitionBy("prev").orderBy(F.desc("probability"), "next")
    return allowed.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") * cost <= budget) & (F.col("rank") <= most))


def parallel_groups(calls: DataFrame, most: int) -> DataFrame:
    """Adds `group_no`: maximal runs of calls that may run in parallel, cut at `most`; others stand alone.

    `calls`: session, seq, parallel (boolean).
    """
    ordered = Window.partitionBy("session").orderBy("seq")
    starts = F.when(~F.col("parallel") | ~F.coalesce(F.lag("parallel").over(ordered), F.lit(False)), 1).otherwise(0)
    islands = calls.withColumn("start", starts).withColumn("island", F.sum("start").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("session", "island").orderBy("seq"))
    cut = islands.withColumn("head", (F.col("start") == 1) | ((place - 1) % most == 0))
    return cut.withColumn("group_no", F.sum(F.col("head").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("start", "island", "head")


def tool_rates(steps: DataFrame) -> DataFrame:
    """Per tool: runs, failures, mean duration, success rate. `steps`: name, ok (boolean), duration."""
    out = steps.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.avg("duration"), 6).alias("mean_duration"))
    return out.withColumn("success_rate", F.round(1.0 - F.col("failures") / F.col("runs"), 6))


def false_hits(requests: DataFrame, least: float = 0.6) -> DataFrame:
    """Adds `false_hit`: the request before was served by reuse and this one is close to it. A reuse is consumed by the next
    request of its session, whatever that is. `requests`: session, seq, query, reused (boolean)."""
    order = Window.partitionBy("session").orderBy("seq")
    before, reused = F.lag("query").over(order), F.lag("reused").over(order)
    alike = text.edit_similarity(before, F.col("query"))
    return requests.withColumn("similarity", F.when(reused, F.round(alike, 6))).withColumn("false_hit", F.coalesce(F.col("similarity") >= least, F.lit(False)))


def hold_out(rows: DataFrame, order: list[str], share: float) -> DataFrame:
    """Adds `train`: the first int(n * share) rows, at least one and not all."""
    placed = with_position(rows, *order)
    cut = F.least(F.greatest(F.floor(F.col("n") * share), F.lit(1)), F.col("n") - 1)
    return placed.withColumn("train", F.col("at") <= cut).drop("at", "n")


def prompt_slices(lines: DataFrame) -> DataFrame:
    """One slice per turn with a user line: its text, trimmed, with its id; of equal ids in a session the first stays."""
    users = turns(lines).filter("role = 'user'")
    rows = users.select("session", "turn_no", F.trim("content").alias("content")).filter("content <> ''")
    rows = rows.withColumn("slice_id", text.slice_id("content", "prompt"))
    order = Window.partitionBy("session", "slice_id").orderBy("turn_no")
    return rows.withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__at = 1").drop("__at")


def quotas(strata: DataFrame, n: int) -> DataFrame:
    """Seats of `n` among strata (stratum, size) by largest remainders; ties by name."""
    whole = F.sum("size").over(Window.partitionBy(F.lit(0)))
    exact = strata.withColumn("exact", F.col("size") * n / whole).withColumn("seats", F.floor("exact"))
    left = exact.withColumn("left", F.lit(n) - F.sum("seats").over(Window.partitionBy(F.lit(0))))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.col("seats"), 9)), "stratum")  # one row a stratum
    return left.withColumn("at", F.row_number().over(order)).select("stratum", "size", (F.col("seats") + (F.col("at") <= F.col("left")).cast("int")).alias("seats"))


def draw(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """A sample of `n` rows (key, stratum), or all if there are fewer: each stratum's seats by largest remainders, filled with
    the least hashes of seed and key, so the same rows are drawn from any layout. Keys are unique.

    A stratum's hashes are even numbers from 0 to 1, so its seats lie below a cut a little above their share; only what is below
    is ranked. Strata that have too few rows below their cut are ranked in full.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    even = F.conv(F.substring("__digest", 1, 13), 16, 10).cast("double") / float(1 << 52)
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    seats = quotas(sizes, n).select(F.col("stratum").alias("__stratum"), F.least("seats", "size").alias("__seats"), ((F.col("seats") + 10 * F.sqrt("seats") + 20) / F.col("size")).alias("__cut"))
    hashed = rows.withColumn("__digest", digest).join(seats, F.col("stratum").eqNullSafe(F.col("__stratum"))).filter("__seats > 0")
    low = hashed.filter(even < F.col("__cut"))
    enough = low.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__below"))
    short = seats.join(enough.withColumnRenamed("__stratum", "__found"), F.col("__stratum").eqNullSafe(F.col("__found")), "left").filter(F.coalesce("__below", F.lit(0)) < F.col("__seats"))
    rest = hashed.filter(even >= F.col("__cut")).join(short.select(F.col("__stratum").alias("__short")), F.col("__stratum").eqNullSafe(F.col("__short")), "left_semi")
    order = Window.partitionBy("__stratum").orderBy("__digest", key)
    ranked = low.unionByName(rest).withColumn("__at", F.row_number().over(order)).filter("__at <= __seats")
    return ranked.select(*rows.columns)


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of a score in 0..1 against a boolean `good`: every bin is present."""
    spine = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    per = scored.withColumn("bin", numeric.calibration_bin(F.col("ratio"), bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.round(F.avg("ratio"), 6).alias("mean_ratio"))
    return spine.join(per, "bin", "left").fillna(0, ["n", "good"]).withColumn("precision", F.round(numeric.share(F.col("good"), F.col("n")), 6))


def confusion(pairs: DataFrame) -> DataFrame:
    """One row of counts and rates. `pairs`: said, truth (booleans)."""
    said, truth = F.col("said"), F.col("truth")
    c = pairs.agg(F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"), F.count_if(~said & ~truth).alias("tn"), F.count_if(~said & truth).alias("fn"), F.count(F.lit(1)).alias("n"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))
    out = c.withColumn("consistency", ratio(100.0 * (tp + tn), n)).withColumn("false_approve", ratio(100.0 * fp, n)).withColumn("false_reject", ratio(100.0 * fn, n))
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("tp", "fp", "tn", "fn", *[F.round(x, 6).alias(x) for x in ("consistency", "false_approve", "false_reject", "precision", "recall", "f1")])
