"""Usage, cost and statistics: one pass of conditional sums each, with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, records

MEASURES = ("tokens_in", "tokens_out", "cache_hit_tokens", "injected_tokens", "slice_hits")


def _flag(c: str) -> Column:
    return F.count_if(F.col(c))


def summarize(usage: DataFrame, cost_miss: float, cost_hit: float) -> DataFrame:
    """One row: sums over all events and their judge decisions, costs, savings and the return on injected tokens.

    `usage`: MEASURES, l3_reuse, l3_false_hit (booleans), judge (array of verdict, called, latency_ms, prompt_tokens). The
    judge's sums are taken inside each event's array, so nothing is exploded or joined. `cost_paid_strict` leaves cached
    tokens of reused turns out of the subtraction, which the plain formula counts twice.
    """
    decisions = lambda test: F.sum(F.size(F.filter(F.coalesce("judge", F.array()), test)))
    added = lambda field, test: F.sum(F.aggregate(F.filter(F.coalesce("judge", F.array()), test), F.lit(0).cast("long"), lambda s, j: s + j[field]))
    reused = lambda c: F.sum(F.when(F.col("l3_reuse"), F.col(c)).otherwise(0))
    verdict = lambda v: lambda j: j["verdict"] == v
    everything = lambda j: F.lit(True)
    sums = usage.agg(
        F.count(F.lit(1)).alias("events"),
        *[F.sum(m).alias(m) for m in MEASURES],
        _flag("l3_reuse").alias("l3_reuses"),
        _flag("l3_false_hit").alias("l3_false_hits"),
        decisions(everything).alias("judge_decisions"),
        decisions(lambda j: j["called"]).alias("judge_calls"),
        added("latency_ms", everything).alias("judge_latency_ms"),
        added("prompt_tokens", lambda j: j["called"]).alias("judge_prompt_tokens"),
        *[decisions(verdict(v)).alias(f"judge_{v}") for v in ("approved", "declined", "fail_closed", "skipped")],
        reused("tokens_in").alias("l3_in"),
        reused("tokens_out").alias("l3_out"),
        reused("cache_hit_tokens").alias("l3_hit"),
    )
    c = F.col
    paid = lambda billed: (billed * cost_miss + c("cache_hit_tokens") * cost_hit + (c("tokens_out") - c("l3_out")) * cost_miss) / 1e6
    none = (c("tokens_in") * cost_miss + c("tokens_out") * cost_miss) / 1e6
    gain = c("injected_tokens") * (cost_miss - cost_hit) / 1e6 + (c("l3_in") * cost_miss + c("l3_out") * cost_miss) / 1e6
    out = sums.withColumn("cost_paid", paid(c("tokens_in") - c("cache_hit_tokens") - c("l3_in"))).withColumn("cost_no_cache", none)
    strict = (c("tokens_in") - c("l3_in") - (c("cache_hit_tokens") - c("l3_hit"))) * cost_miss
    out = out.withColumn("cost_paid_strict", (strict + (c("cache_hit_tokens") - c("l3_hit")) * cost_hit + (c("tokens_out") - c("l3_out")) * cost_miss) / 1e6)
    return (
        out.withColumn("savings", c("cost_no_cache") - c("cost_paid"))
        .withColumn("savings_rate", F.when(c("cost_no_cache") > 0, c("savings") / c("cost_no_cache")).otherwise(0.0))
        .withColumn("inject_roi", F.when(c("injected_tokens") > 0, gain / c("injected_tokens") * 1e6).otherwise(0.0))
    )


def by_provider(usage: DataFrame) -> DataFrame:
    """Per provider: events, reuses and, of exactly metered events only, tokens and the share of cached input."""
    exact = lambda m: F.sum(F.when(F.col("exact"), F.col(m)).otherwise(0)).alias(m)
    out = usage.groupBy("provider").agg(F.count(F.lit(1)).alias("events"), _flag("exact").alias("exact_events"), _flag("l3_reuse").alias("l3_reuses"), *[exact(m) for m in MEASURES[:3]])
    return out.withColumn("l1_hit_rate", F.round(numeric.share(F.col("cache_hit_tokens"), F.col("tokens_in")), 6))


def provider_savings(usage: DataFrame, prices: DataFrame, miss: float, hit: float) -> DataFrame:
    """Savings by cached tokens at each provider's prices, else the general ones; the unnamed provider sorts last."""
    rows = by_provider(usage).join(prices, "provider", "left")
    saved = F.col("cache_hit_tokens") * (F.coalesce("price_miss", F.lit(miss)) - F.coalesce("price_hit", F.lit(hit))) / 1e6
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("provider") == "", "provider")
    return rows.select("provider", "cache_hit_tokens", F.round(saved, 9).alias("saved"), F.row_number().over(order).alias("position"))


def l1_check(usage: DataFrame, least: int = 20, floor: float = 85.0) -> DataFrame:
    """Providers with `least` exact events or more whose share of cached input is under `floor`."""
    return by_provider(usage).filter((F.col("exact_events") >= least) & (F.col("l1_hit_rate") < floor)).select("provider", "exact_events", "l1_hit_rate")


def daily(stats: DataFrame) -> DataFrame:
    """The rollup: sums per day, source and model; turn markers count as turns and their tokens do not."""
    real = ~F.col("turn")
    tokens = lambda c: F.sum(F.when(real, F.col(c)).otherwise(0)).alias(c)
    return stats.groupBy("day", "source", "model").agg(tokens("prompt"), tokens("completion"), tokens("cache_hit"), tokens("total"), F.count_if(real).alias("requests"), F.count_if(F.col("turn")).alias("turns"))


def range_totals(rolled: DataFrame) -> DataFrame:
    """Totals of a range over rollup rows, by model within the range, with shares; the best by tokens, then name, has rank 1."""
    per = rolled.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("prompt", "completion", "cache_hit", "total", "requests", "turns")], F.count_distinct("day").alias("active_days"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(0)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "model")
    return per.withColumn("percent", F.round(numeric.share(F.col("total"), whole), 6)).withColumn("rank", F.row_number().over(order)).withColumn("provider", numeric.provider_of(F.col("model")))


def day_spine(rolled: DataFrame) -> DataFrame:
    """Every day from the first to the last, days without rows with zeros."""
    per = rolled.groupBy("day").agg(F.sum("total").alias("total"), F.sum("requests").alias("requests"))
    days = per.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(per, "day", "left").fillna(0, ["total", "requests"])


def ledger(entries: DataFrame) -> DataFrame:
    """Per key: the sum if there is one currency, else null and the sums by currency."""
    per = entries.groupBy("key", "currency").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("entries"))
    out = per.groupBy("key").agg(
        F.count(F.lit(1)).alias("currencies"), F.sum("entries").alias("entries"), F.sum("amount").alias("sum"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "currency", F.col("amount").cast("string")))), ",").alias("buckets")
    )
    return out.withColumn("amount", F.when(F.col("currencies") == 1, F.col("sum"))).drop("sum")


def quotes(rows: DataFrame) -> DataFrame:
    """Per model: totals, whether all rows are priced, and the status."""
    out = rows.groupBy("model").agg(F.sum("cost").alias("cost"), F.every(F.col("cost").isNotNull()).alias("complete"), F.count(F.lit(1)).alias("rows"), F.count("cost").alias("priced"))
    return out.withColumn("status", F.when(F.col("complete"), "complete").when(F.col("priced") > 0, "partial").otherwise("unknown"))


def quota(usage: DataFrame, free: int, paid: int) -> DataFrame:
    """Mode of each request by what its session had used before; reuse turns are free of charge."""
    cost = F.when(F.col("l3_reuse"), 0).otherwise(F.col("tokens_in") + F.col("tokens_out"))
    before = F.coalesce(F.sum(cost).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = usage.withColumn("used_before", before)
    return rows.withColumn("mode", F.when(F.col("used_before") < free, "free").when(F.col("used_before") < free + paid, "paid").otherwise("blocked"))


def nearest_rank(values: DataFrame, group: str, value: str, share: float = 0.99, last: int = 20) -> DataFrame:
    """The ceil(share * n)-th of the last `last` values by `seq` per group, and whether all of the last three reach a budget."""
    recent = values.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("seq")))).filter(F.col("at") <= last)
    lists = recent.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("v"), F.min(F.when(F.col("at") <= 3, F.col(value))).alias("least_recent"))
    return lists.select(group, F.element_at("v", F.greatest(F.lit(1), F.ceil(F.size("v") * share).cast("int"))).alias("p99"), "least_recent", F.size("v").alias("n"))


def rolling_ranks(values: DataFrame, group: str, value: str, budget: int, share: float = 0.99, last: int = 20, streak: int = 3) -> DataFrame:
    """Adds to each row (group, seq, value), as of its time: `n` and `p99` of the group's last `last` values, the ceil(share * n)-th
    of them, and `demote`, whether the last `streak` all reach `budget`. Negative values count as 0; a budget of 0 or less demotes
    nothing. The frame of a row is `last` rows, whatever the size of the group."""
    recent = Window.partitionBy(group).orderBy("seq")
    sample = F.greatest(F.col(value), F.lit(0))
    frame = F.sort_array(F.collect_list(sample).over(recent.rowsBetween(1 - last, 0)))
    tail = F.collect_list(sample).over(recent.rowsBetween(1 - streak, 0))
    rows = values.withColumn("__frame", frame).withColumn("__tail", tail)
    at = F.greatest(F.lit(1), F.ceil(F.size("__frame") * share).cast("int"))
    slow = (F.lit(budget) > 0) & (F.size("__tail") == streak) & F.forall("__tail", lambda x: x >= budget)
    return rows.select(*values.columns, F.size("__frame").alias("n"), F.element_at("__frame", at).alias("p99"), slow.alias("demote"))


def valuations(quotes: DataFrame, catalog: DataFrame, target: str) -> DataFrame:
    """Adds `official`, whether a quote's rates are those of the catalog, and its `valuation` in the target currency.

    `quotes`: id, provider, model, currency, hit, miss, output (tokens), rate_hit, rate_in, rate_out; `catalog`: provider,
    model, currency, mode, rate_hit, rate_in, rate_out, one row a provider, model, currency and mode. Equal rates of several
    modes count as pay-as-you-go first, then by name. The valuation is by the peer in the target currency of the same mode,
    else of pay-as-you-go; none for quotes in that currency or off the catalog.
    """
    rates = ["rate_hit", "rate_in", "rate_out"]
    listed = catalog.withColumn("currency", records.currency(F.col("currency")))
    keys = ["provider", "model", "currency", *rates]
    place = F.struct((F.col("mode") != "payg").alias("later"), F.col("mode").alias("mode"))
    known = listed.groupBy(*keys).agg(F.min(place)["mode"].alias("official_mode"))
    rows = quotes.withColumn("provider", F.lower(F.trim("provider"))).withColumn("model", F.trim("model")).withColumn("currency", records.currency(F.col("currency")))
    peers = listed.filter(F.col("currency") == target).groupBy("provider", "model").agg(F.map_from_entries(F.collect_list(F.struct("mode", F.struct(*rates)))).alias("peers"))
    found = rows.join(known, keys, "left").join(peers, ["provider", "model"], "left")
    peer = F.coalesce(F.col("peers")[F.col("official_mode")], F.col("peers")["payg"])
    worth = numeric.token_cost(F.col("hit"), F.col("miss"), F.col("output"), peer["rate_hit"], peer["rate_in"], peer["rate_out"])
    valued = F.when((F.col("currency") != target) & F.col("official_mode").isNotNull(), worth)
    return found.withColumn("official", F.col("official_mode").isNotNull()).withColumn("valuation", valued).drop("peers", "official_mode")


#: The figures of a usage report, in order. Fixed values.
REPORTED = ("events", *MEASURES[:3], "l3_reuses", *MEASURES[3:], "cost_paid", "cost_no_cache", "savings", "savings_rate", "judge_approved", "judge_declined", "judge_fail_closed", "judge_skipped", "l3_false_hits")


def report(usage: DataFrame, prices: DataFrame, miss: float, hit: float) -> DataFrame:
    """The usage report as rows (section, position, name, value, detail): the totals of REPORTED, and per provider its savings with
    its hit rate (n/a where nothing was metered exactly), exact and all events, and reuses. The unnamed provider comes last."""
    totals = summarize(usage, miss, hit)
    names = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for i, n in enumerate(REPORTED)])
    first = totals.select(F.inline(names)).select(F.lit("totals").alias("section"), "position", "name", F.round("value", 9).alias("value"), F.lit("").alias("detail"))
    rate = F.when(F.col("exact_events") > 0, F.format_string("%.1f%%", F.col("l1_hit_rate"))).otherwise("n/a")
    detail = F.format_string("hit %s exact %d/%d reuses %d", rate, "exact_events", "events", "l3_reuses")
    rows = provider_savings(usage, prices, miss, hit).join(by_provider(usage).drop("cache_hit_tokens"), "provider")
    second = rows.select(F.lit("providers").alias("section"), "position", F.when(F.col("provider") == "", "(unattributed)").otherwise(F.col("provider")).alias("name"), F.col("saved").alias("value"), detail.alias("detail"))
    return first.unionByName(second)


#: A counter goes no higher. Fixed value.
MOST_COUNTED = 1_000_000


def counters(signals: DataFrame) -> DataFrame:
    """(signal, bucket, count) of telemetry: sums of positive counts, up to MOST_COUNTED; what has no signal or bucket is left out.
    `signals`: signal, bucket, count."""
    named = (F.coalesce("signal", F.lit("")) != "") & (F.coalesce("bucket", F.lit("")) != "") & (F.col("count") > 0)
    sums = signals.filter(named).groupBy("signal", "bucket").agg(F.sum("count").alias("count"))
    return sums.withColumn("count", F.least("count", F.lit(MOST_COUNTED).cast("long")))
