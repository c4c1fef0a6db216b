"""The slice library as a whole: totals, hit rates, compression, sources, promotions, merges, prefetching and scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.cuts import cut
from .retrieval import BROADCAST_BYTES


def totals(slices: DataFrame) -> DataFrame:
    """One row: slices and the distinct sessions they come from; an empty session is none."""
    return slices.agg(F.count(F.lit(1)).alias("slices"), F.count_distinct(F.nullif(F.col("session"), F.lit(""))).alias("sessions"))


def hit_rates(usage: DataFrame) -> DataFrame:
    """One row: events, reuses (l3), turns with injected tokens (l2), both, and their rate. A turn may be in both."""
    sums = usage.agg(F.count(F.lit(1)).alias("events"), F.count_if("l3_reuse").alias("l3_hits"), F.count_if(F.col("injected_tokens") > 0).alias("l2_hits"))
    hits = F.col("l3_hits") + F.col("l2_hits")
    return sums.withColumn("hits", hits).withColumn("rate", F.when(F.col("events") > 0, F.col("hits") / F.col("events")).otherwise(0.0))


def zone_counts(asked: DataFrame, tops: DataFrame) -> DataFrame:
    """One row: the asked by zone of their two best others. `asked`: query_id; `tops`: query_id, top1, top2 (null: none).
    Who finds no other is a miss."""
    rows = asked.select("query_id").join(tops, "query_id", "left")
    zone = F.when(F.col("top1").isNull(), "miss").otherwise(numeric.winner_zone(F.col("top1"), F.col("top2")))
    zoned = rows.select(zone.alias("zone"))
    return zoned.agg(*[F.count_if(F.col("zone") == z).alias(z) for z in ("hit", "grey", "miss")], F.count(F.lit(1)).alias("total"))


def dashboard(summary: DataFrame, rates: DataFrame, zones: DataFrame, library: DataFrame, capacity: int) -> DataFrame:
    """(section, metric, value): the one-row tables of the snapshot, one row a figure."""
    parts = {
        "savings": (summary, ("savings", "savings_rate", "cost_paid", "cost_no_cache")),
        "hit_rate": (rates, ("events", "l3_hits", "l2_hits", "hits", "rate")),
        "zones": (zones, ("hit", "grey", "miss", "total")),
        "library": (library.withColumn("capacity", F.lit(capacity)), ("slices", "sessions", "capacity")),
    }
    out = None
    for section, (table, metrics) in parts.items():
        rows = table.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value")
        rows = rows.select(F.lit(section).alias("section"), "metric", F.round("value", 9).alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


def adaptation(entries: DataFrame) -> DataFrame:
    """One row: entries, those with a threshold of their own, the relaxed among these, and least, upper median and most of
    their thresholds (null without any). `entries`: tau_low (0: the common one), relaxed."""
    tau = F.when(F.col("tau_low") > 0, F.col("tau_low"))
    median = -F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -if(tau_low > 0, tau_low, null))")
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count(tau).alias("learned"),
        F.count_if((F.col("tau_low") > 0) & F.col("relaxed")).alias("relaxed"),
        F.min(tau).alias("least"),
        median.alias("median"),
        F.max(tau).alias("most"),
    )


def compression(slices: DataFrame) -> DataFrame:
    """One row: raw and stored bytes and the share saved. `slices`: content, version, original_bytes, stored_bytes.

    The original size is believed only where a version is named and the stored size is that of the content.
    """
    stored = F.coalesce(F.octet_length("content"), F.lit(0))
    known = (F.col("version") != "") & (F.col("original_bytes") > 0) & (F.col("stored_bytes") == stored) & (F.col("original_bytes") >= F.col("stored_bytes"))
    sums = slices.agg(F.sum(F.when(known, F.col("original_bytes")).otherwise(stored).cast("long")).alias("raw"), F.sum(stored.cast("long")).alias("stored"))
    sums = sums.select(F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return sums.withColumn("ratio", F.when(F.col("raw") > 0, (F.col("raw") - F.col("stored")) / F.col("raw")).otherwise(0.0))


def top_sources(hits: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, place, session, hits): the sessions that most hits of a query come from, the one seen first on a tie.
    `hits`: query_id, rank, session; blank sessions are left out."""
    named = hits.select("query_id", "rank", F.trim("session").alias("session")).filter("session <> ''")
    counted = named.groupBy("query_id", "session").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "first"))
    return counted.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "place", "session", "hits")


def replay_means(rows: DataFrame, k: int = 5) -> DataFrame:
    """Per series: means of hit rate and cost over its first and last k rows, and the total cost. `rows`: series, seq,
    hit_rate, cost. Series shorter than k are taken whole."""
    up, down = Window.partitionBy("series").orderBy("seq"), Window.partitionBy("series").orderBy(F.desc("seq"))
    ranked = rows.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
    ends = [F.avg(F.when(F.col(side) <= k, F.col(c))).alias(f"{name}_{c}") for side, name in (("up", "first"), ("down", "last")) for c in ("hit_rate", "cost")]
    return ranked.groupBy("series").agg(*ends, F.sum("cost").alias("total_cost"))


def promotions(entries: DataFrame) -> DataFrame:
    """Of entries with equal slice, version and query the first by promoted_at and seq; null equals null."""
    order = Window.partitionBy("slice_id", "version", "query").orderBy("promoted_at", "seq")
    return entries.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def merged_symbols(primary: DataFrame, fallback: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """All primary symbols of a scope, and those of the fallback that these lack, each once, the first by seq.

    A scope without primary symbols keeps its fallback as it is. Both: scope, seq and `identity`; adds `primary`.
    """
    keys = ["scope", *identity]
    scopes = primary.select("scope").distinct().withColumn("__both", F.lit(True))
    rest = fallback.join(primary.select(*keys).distinct(), keys, "left_anti").join(scopes, "scope", "left")
    order = Window.partitionBy(*keys).orderBy("seq")
    once = rest.withColumn("__n", F.row_number().over(order)).filter("__both IS NULL OR __n = 1").drop("__n", "__both")
    return primary.withColumn("primary", F.lit(True)).unionByName(once.withColumn("primary", F.lit(False)))


def local_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tasks that may run, which are those declared local, and one row with the number of all others."""
    local = F.coalesce(F.col("locality") == "local", F.lit(False))
    return tasks.filter(local), tasks.agg(F.count_if(~local).alias("blocked"))


def assembled(ranked: DataFrame) -> DataFrame:
    """(task, content): the candidates' texts, each under its id, by ascending id. `ranked`: task, id, content; a bounded top-k."""
    entry = F.concat(F.lit("--- slice "), F.col("id").cast("string"), F.lit(" ---\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("id", entry.alias("entry"))))
    return ranked.groupBy("task").agg(F.array_join(F.transform(parts, lambda p: p["entry"]), "").alias("content"))


def coverage(steps: DataFrame, plans: DataFrame) -> DataFrame:
    """(session, calls, covered): read-only steps, and those that the session's last plan before them had proposed for the
    step before. `steps`: session, seq, name, read_only; `plans`: session, seq (of the step it follows), prev, targets. The
    first step of a session follows nothing and is no call."""
    planned = plans.select("session", "seq", F.struct("prev", "targets").alias("plan"))
    order = Window.partitionBy("session").orderBy("seq")
    rows = steps.join(planned, ["session", "seq"], "left").withColumn("before", F.lag("name").over(order))
    last = F.last("plan", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    calls = rows.withColumn("last", last).filter("read_only AND before IS NOT NULL")
    hit = F.coalesce((F.col("last.prev") == F.col("before")) & F.array_contains("last.targets", F.col("name")), F.lit(False))
    return calls.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("covered"))


def attached(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session, seq, call_id, name, result, attached): calls with their results, a result with its first call only.

    `calls`: session, seq, call_id, name; `results`: session, call_id, seq, content; of several the last one stands.
    """
    latest = results.groupBy("session", "call_id").agg(F.max_by("content", "seq").alias("result"), F.lit(True).alias("found"))
    first = F.row_number().over(Window.partitionBy("session", "call_id").orderBy("seq")) == 1
    rows = calls.withColumn("first", first).join(latest, ["session", "call_id"], "left")
    has = F.coalesce(F.col("first") & F.col("found"), F.lit(False))
    return rows.select("session", "seq", "call_id", "name", F.when(has, F.col("result")).alias("result"), has.alias("attached"))


def scanned(known: DataFrame, listing: DataFrame, now: int, grace: int) -> DataFrame:
    """Known sources after a scan: what the listing lacks is missing since now or earlier and gone once its grace is over.

    `known`: path, missing_since (0: present); adds `health` and `gone`. Documents of gone sources go with them.
    """
    seen = listing.select("path").distinct().withColumn("__seen", F.lit(True))
    rows = known.join(seen, "path", "left")
    since = F.when(F.col("__seen"), 0).when(F.col("missing_since") == 0, now).otherwise(F.col("missing_since"))
    rows = rows.withColumn("missing_since", since.cast("long")).drop("__seen")
    absent = F.col("missing_since") > 0
    return rows.withColumn("health", F.when(absent, "missing").otherwise("ok")).withColumn("gone", absent & (F.col("missing_since") <= now - grace))


def searchable(hits: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with their document and its source; those of sources that are missing or not in health are left out.
    `hits`: id; `documents`: id, path; `sources`: path, health, missing_since."""
    return hits.join(documents, "id").join(sources.filter("health = 'ok' AND missing_since = 0"), "path")


def opened(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with `open`: whether `searchable` leaves them. Sources are counted and go to the documents up to BROADCAST_BYTES (128 bytes a
    row). `documents`: path and more; `sources`: path (once), health, missing_since."""
    good = cut(sources.filter("health = 'ok' AND missing_since = 0").select("path", F.lit(True).alias("open")))
    rows = documents.join(F.broadcast(good) if good.count() * 128 <= BROADCAST_BYTES else good, "path", "left")
    return rows.withColumn("open", F.coalesce("open", F.lit(False)))


def evolution_signals(usage: DataFrame) -> DataFrame:
    """(key, seq, epoch, name, value): what usage records tell a threshold engine. `usage`: key, seq, l3_reuse, l3_false_hit,
    tokens_in, cache_hit_tokens, judged (decisions of the last tier), rejected (by its judge).

    A reuse is a hit of 1, else the cached share of the input; records with neither are skipped and open no epoch. Records
    with decisions, reuse or a false hit also tell how many decisions were rejections.
    """
    epoch = F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("long")
    # Numbered before signals are exploded: in one select, Spark numbers the exploded rows.
    useful = usage.filter("l3_reuse OR tokens_in > 0").withColumn("epoch", epoch)
    hit = F.when(F.col("l3_reuse"), 1.0).otherwise(F.col("cache_hit_tokens") / F.col("tokens_in"))
    bad = F.least((F.col("rejected") + F.col("l3_false_hit").cast("int")) / (F.col("judged") + 1), F.lit(1.0))
    active = (F.col("judged") > 0) | F.col("l3_reuse") | F.col("l3_false_hit")
    signals = F.array(F.struct(F.lit("hit").alias("name"), hit.alias("value")), F.when(active, F.struct(F.lit("pollution").alias("name"), bad.alias("value"))))
    rows = useful.select("key", "seq", "epoch", F.explode(F.array_compact(signals)).alias("s"))
    return rows.select("key", "seq", "epoch", "s.name", "s.value")


def recall_blocks(hits: DataFrame, budget: int, frame: int, note: int) -> DataFrame:
    """(query_id, ids, used, omitted): the hits, by rank, whose entries fit a block of `budget` characters.

    `hits`: query_id, rank, id, head (an entry without its text), snippet (as it is printed). An entry too long is clipped: a quarter of what
    is left of its text goes, at least one character, until it fits with three dots; if nothing is left it is omitted and
    the next one may still fit. `frame` is what opening and closing take; a note on what is omitted takes `note` characters
    and is added only if it still fits. Hits are a bounded top-k.
    """
    size = F.char_length(F.coalesce("snippet", F.lit("")))
    rows = hits.select("query_id", F.struct("rank", "id", F.char_length("head").alias("head"), size.alias("size"), _cuts(size).alias("cuts")).alias("h"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("h"))
    empty = F.struct(F.array().cast(f"array<{dict(hits.dtypes)['id']}>").alias("ids"), F.lit(frame).alias("used"), F.lit(0).alias("omitted"))

    def step(a: Column, h: Column) -> Column:
        left = F.lit(budget) - a["used"]
        clipped = F.filter(h["cuts"], lambda n: h["head"] + n + 3 <= left)
        length = F.when(h["head"] + h["size"] <= left, h["head"] + h["size"]).when(F.size(clipped) > 0, h["head"] + F.get(clipped, F.lit(0)) + 3)
        kept = F.struct(F.array_append(a["ids"], h["id"]).alias("ids"), (a["used"] + length).alias("used"), a["omitted"].alias("omitted"))
        return F.when(length.isNotNull(), kept).otherwise(F.struct(a["ids"].alias("ids"), a["used"].alias("used"), (a["omitted"] + 1).alias("omitted")))

    folded = lists.select("query_id", F.aggregate("h", empty, step).alias("a"))
    noted = (F.col("a.omitted") > 0) & (F.col("a.used") + note <= budget) & (F.size("a.ids") > 0)
    used = F.when(F.size("a.ids") == 0, 0).otherwise(F.col("a.used") + F.when(noted, note).otherwise(0))
    return folded.select("query_id", F.col("a.ids").alias("ids"), used.alias("used"), F.col("a.omitted").alias("omitted"))


def _cuts(size: Column) -> Column:
    """The lengths that clipping tries, longest first."""
    steps = F.ceil(F.log(F.greatest(size, F.lit(2))) / math.log(4 / 3)).cast("int") + 8
    less = lambda n: n - F.greatest(F.floor(n / 4), F.lit(1)).cast("int")
    shorter = lambda a, _: F.when(F.element_at(a, -1) > 1, F.array_append(a, less(F.element_at(a, -1)))).otherwise(a)
    return F.filter(F.aggregate(F.sequence(F.lit(1), steps), F.array(size), shorter), lambda n: n > 0)
