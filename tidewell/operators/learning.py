"""Learners over ordered feedback, in batch: streamed folds over each key's sorted rows, and closed forms where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_to_last

#: Constants of the threshold engine. Fixed values.
ALPHA, POLLUTION_RISE, POLLUTION_LOW, HIT_TARGET, STEP, MIN_TAU, MAX_TAU, FREEZE, MIN_SAMPLES, FIRST = 0.1, 0.30, 0.10, 0.70, 0.05, 0.30, 0.80, 60, 20, 60


def fold(state: tuple, rows: list[tuple]) -> tuple:
    """One key's state after more signals (epoch, name, value), in order."""
    n, epoch, hit, pol, tau, frozen, changes = state
    for e, name, value in rows:
        if value is None or value != value or value in (float("inf"), float("-inf")) or e < epoch:
            continue
        n, epoch, v = n + 1, e, min(max(value, 0.0), 1.0)
        if name == "hit":
            hit = ALPHA * v + (1 - ALPHA) * hit
        elif name == "pollution":
            pol = ALPHA * v + (1 - ALPHA) * pol
        else:
            continue
        if n < MIN_SAMPLES or e < FIRST or e < frozen:
            continue
        new = tau + STEP if pol >= POLLUTION_RISE else tau - STEP if hit >= HIT_TARGET and pol <= POLLUTION_LOW else tau
        new = min(max(new, MIN_TAU), MAX_TAU)
        if new != tau:
            tau, frozen, changes = new, e + FREEZE, changes + 1
    return n, epoch, hit, pol, tau, frozen, changes


def evolve(signals: DataFrame, tau: float = 0.55) -> DataFrame:
    """Per key: the threshold after its signals, in order. `signals`: key, seq, epoch, name (hit or pollution), value.

    Moving averages of hits and pollution raise the threshold when pollution is high and lower it when hits are high and
    pollution low; after each change it is frozen for FREEZE epochs, and nothing moves before MIN_SAMPLES signals and epoch
    FIRST. Values are clamped to 0..1, signals that are no numbers or of an earlier epoch are skipped. A key's rows are read by
    one task as a sorted stream; keys are independent.
    """
    kind = dict(signals.dtypes)["key"]
    rows = signals.select("key", F.struct("seq", "epoch", "name", "value").alias("at"))
    step = lambda state, row: fold(state, [(row["at"]["epoch"], row["at"]["name"], row["at"]["value"])])
    folded = fold_to_last(rows, "key", "at", lambda: (0, 0, 0.0, 0.0, tau, 0, 0), step, f"key {kind}, n long, epoch long, hit double, pol double, tau double, frozen long, changes long")
    return folded.select("key", F.col("n").alias("samples"), F.round("hit", 6).alias("hit_ewma"), F.round("pol", 6).alias("pollution_ewma"), F.round("tau", 6).alias("tau"), F.col("changes").alias("adjustments"))


def adapt(feedback: DataFrame, tau: float = 0.55, alpha: float = 0.1, bound: float = 0.2, samples: int = 20, step_by: float = 0.05, freeze: int = 60, low: float = 0.3, high: float = 0.9) -> DataFrame:
    """Per slice: its own threshold, learned from negative feedback. `feedback`: slice_id, seq, negative (boolean).

    While frozen, observations count but do not adjust; a freeze runs down by observations.
    """
    kind = dict(feedback.dtypes)["slice_id"]

    def step(state: tuple, row: dict) -> tuple:
        pos, neg, ewma, own, relaxed, frozen = state
        negative = row["at"]["negative"]
        pos, neg, ewma = pos + (not negative), neg + negative, alpha * negative + (1 - alpha) * ewma
        base = own if own > 0 else tau
        up = ewma > bound
        moved = base + step_by if up else base - step_by if ewma < bound / 2 and pos >= samples else base
        moved = min(max(moved, low), high)
        if frozen == 0 and pos + neg >= samples and moved != base:
            return pos, neg, ewma, moved, not up, freeze
        return pos, neg, ewma, own, relaxed, max(frozen - 1, 0)

    rows = feedback.select("slice_id", F.struct("seq", "negative").alias("at")).filter("negative is not null")
    folded = fold_to_last(rows, "slice_id", "at", lambda: (0, 0, 0.0, 0.0, False, 0), step, f"slice_id {kind}, pos int, neg int, ewma double, tau double, relaxed boolean, frozen int")
    return folded.select("slice_id", "pos", "neg", F.round("ewma", 6).alias("neg_ewma"), F.round("tau", 6).alias("tau_low"), "relaxed")


def beta_posterior(outcomes: DataFrame, decay: float = 0.2, limit: float = 3.0) -> DataFrame:
    """Per key: discounted hits and waste, posterior mean, lower bound and demotion. `outcomes`: key, seq, hit (boolean).

    The fold has a closed form: the weight of an outcome is (1 - decay) to the number of later ones.
    """
    later = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))) - 1
    rows = outcomes.withColumn("w", F.pow(F.lit(1 - decay), later))
    sums = rows.groupBy("key").agg(F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("h"), F.sum(F.when(F.col("hit"), 0.0).otherwise(F.col("w"))).alias("waste"))
    from ..functions.numeric import beta_mean, wilson_low

    mean = beta_mean(F.col("h"), F.col("waste"))
    out = sums.withColumn("mean", mean).withColumn("low", wilson_low(F.col("mean"), F.col("h") + F.col("waste")))
    return out.select("key", F.round("h", 6).alias("hits"), F.round("waste", 6).alias("waste"), F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), (F.col("mean") < 1 / (1 + limit)).alias("demoted"))
