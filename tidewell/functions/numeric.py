"""Numeric and classification functions as columns. Thresholds and clocks are parameters; zero stands for unknown where the
data model says so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25_term(tf: Column, df: Column, docs: Column, length: Column, average: Column) -> Column:
    """The contribution of one term."""
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    """0 if the sizes differ or a vector is zero."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / F.sqrt(na * nb))


@dataclass(frozen=True)
class Zones:
    """Thresholds of the hit, grey and miss zones: shares of the best score, and floors of the best score itself."""

    tau_high: float = 0.8
    tau_low: float = 0.55
    abs_high: float = 0.7
    abs_low: float = 0.45


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)


def zone(score: Column, top: Column, z: Zones = Zones()) -> Column:
    """hit, grey or miss of a score against its query's best."""
    ratio = score / F.when(top > 0, top)
    return (
        F.when(_bad(score) | _bad(top) | (top < z.abs_low), "miss")
        .when((ratio >= z.tau_high) & (top >= z.abs_high), "hit")
        .when((ratio >= z.tau_low) & (top >= z.abs_low), "grey")
        .otherwise("miss")
    )


def reuse_zone(score: Column, result_top: Column, global_top: Column, z: Zones = Zones()) -> Column:
    """The two-axis zone of reuse: against the best result and the best of all types."""
    own, whole = score / F.when(result_top > 0, result_top), score / F.when(global_top > 0, global_top)
    bad = _bad(score) | _bad(result_top) | _bad(global_top)
    return (
        F.when(bad, "miss")
        .when((own >= z.tau_high) & (whole >= z.abs_low) & (global_top >= z.abs_high), "hit")
        .when((own >= z.tau_low) & (whole >= z.abs_low) & (global_top >= z.abs_low), "grey")
        .otherwise("miss")
    )


def winner_zone(top1: Column, top2: Column, z: Zones = Zones()) -> Column:
    """hit only if the best leads the second by tau_low of itself."""
    return F.when(top1.isNull() | (top1 <= 0) | (top1 < z.abs_low), "miss").when((top1 >= z.abs_high) & (top1 - F.coalesce(top2, F.lit(0.0)) >= z.tau_low * top1), "hit").otherwise("grey")


def freshness_zone(created: Column, now: Column, ttl: Column) -> Column:
    """Zone by age in seconds: half the time to live is grey, beyond it a miss; unknown or future ages are misses."""
    age = now - created
    return F.when(ttl <= 0, "hit").when((created <= 0) | (age < 0) | (age > ttl), "miss").when(age > F.floor(ttl / 2), "grey").otherwise("hit")


def value_weight(created: Column, last_used: Column, hits: Column, injected: Column, rejected: Column, feedback: Column, now: Column, half_life_days=30.0, pseudo=3.0, reject_cost=2.0, gain=0.5) -> Column:
    """Decay by age, use, acceptance and feedback, within 0.001 and 1."""
    active = F.greatest(created, last_used)
    age = F.greatest(now - active, F.lit(0)).cast("double")
    decay = F.when(active > 0, F.exp(-0.6931471805599453 * age / (half_life_days * 86400))).otherwise(0.5)
    use, inj = (hits + injected).cast("double"), injected.cast("double")
    raw = F.when(F.isnan(feedback) | (F.abs(feedback) == float("inf")), 0.0).otherwise(F.coalesce(feedback, F.lit(0.0)))
    fb = F.least(F.greatest(1 + gain * raw, F.lit(0.25)), F.lit(2.0))
    w = decay * (use + 0.5) / (use + pseudo) * (inj + 1) / (inj + 1 + reject_cost * rejected.cast("double")) * fb
    return F.least(F.greatest(w, F.lit(0.001)), F.lit(1.0))


#: Order in which types are evicted. Fixed values.
EVICT_ORDER = ("result", "tool_pattern", "memory", "prompt", "context")


def evict_priority(kind: Column) -> Column:
    out = F.when(kind == EVICT_ORDER[0], 0)
    for k, name in enumerate(EVICT_ORDER[1:], 1):
        out = out.when(kind == name, k)
    return out.otherwise(5)


def beta_mean(hits: Column, waste: Column) -> Column:
    return (hits + 1.0) / (hits + waste + 2.0)


def wilson_low(mean: Column, n: Column, z: float = 1.645) -> Column:
    """Lower bound of a mean of n observations, which may be fractions; 0 without observations."""
    low = (mean + z * z / (2 * n) - z * F.sqrt(mean * (1 - mean) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, low).otherwise(0.0)


def memory_freshness(created: Column, updated: Column, verified: Column, expires: Column, volatility: Column, kind: Column, now: Column) -> Column:
    """fresh, current, stale or expired; times are unix seconds, null if unknown."""
    day = 86400
    changed = F.coalesce(updated, created)
    since = F.greatest(changed, F.coalesce(verified, changed))
    fresh = F.when(volatility == "stable", 90).when(volatility == "volatile", 7).when(kind == "reference", 14).when(kind.isin("user", "feedback"), 90).otherwise(30)
    current = F.when(volatility == "stable", 365).when(volatility == "volatile", 30).when(kind == "reference", 45).when(kind.isin("user", "feedback"), 365).otherwise(180)
    age = now - since
    return (
        F.when(expires.isNotNull() & (now > expires), "expired")
        .when(since.isNull() | (since > now), "current")
        .when(volatility == "evergreen", "fresh")
        .when(age <= fresh * day, "fresh")
        .when(age <= current * day, "current")
        .otherwise("stale")
    )


def calibration_bin(ratio: Column, bins: int = 10) -> Column:
    """floor(ratio * bins) within 0 and bins - 1; what is no number or negative is 0."""
    return F.when(ratio.isNull() | F.isnan(ratio) | (ratio < 0), 0).otherwise(F.least(F.lit(bins - 1), F.floor(ratio * bins))).cast("int")


def budget_action(spent: Column, limit: Column) -> Column:
    """The ladder of measures as a budget fills; none without a limit."""
    ratio = spent / F.when(limit > 0, limit)
    return F.when(ratio >= 1.0, "hard_stop").when(ratio >= 0.9, "degrade_tier").when(ratio >= 0.8, "degrade_inject").when(ratio >= 0.7, "halt_prefetch").otherwise("none")


def load_gate(used: Column, limit: Column, most: float, wait: Column, estimate: Column) -> Column:
    """saturated, too_short or open."""
    return F.when((limit > 0) & (used / limit >= most), "saturated").when((wait > 0) & (wait < estimate), "too_short").otherwise("open")


def provider_of(model_ref: Column) -> Column:
    """What stands before the slash of provider/model; `default` for bare names."""
    return F.when(F.instr(model_ref, "/") > 1, F.substring_index(model_ref, "/", 1)).otherwise("default")


def token_cost(hit: Column, miss: Column, output: Column, price_hit: Column, price_in: Column, price_out: Column) -> Column:
    """Price per million tokens, as a decimal of nine places."""
    return ((hit * price_hit + miss * price_in + output * price_out) / 1e6).cast("decimal(28,9)")


def share(part: Column, whole: Column, factor: float = 100.0) -> Column:
    """part of whole in percent; 0 of nothing."""
    return F.when(whole > 0, factor * part / whole).otherwise(0.0)
