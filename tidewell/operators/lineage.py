"""Lineage of recovered sessions: which copy holds what all others hold, and which row of each group an ordinary list shows.

That one transcript begins with another is an equality: every prefix of a session has a hash that follows from its messages
and their places, so "covers" is a join on (session, length, hash). Parents are followed by doubling, so a chain of n sessions
takes log2(n) joins. Groups are reduced to one row before anything is joined to them, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import stored

_CONTENT = ("len", "body", "h", "g")


def prefixes(messages: DataFrame) -> DataFrame:
    """(session, length, h, g): 128 bits of hash for the first `length` messages of each session, for every length from 1.
    `messages`: session, at, role, content. A system message that comes first belongs to no prefix, and sessions that differ
    in it alone are equal."""
    return _chained(messages).filter("length > 0")


def _chained(messages: DataFrame) -> DataFrame:
    """`prefixes`, and a leading system message as a row of length 0. Messages are hashed where they are read; texts are not exchanged."""
    mark = F.struct(F.coalesce("role", F.lit("")), F.coalesce("content", F.lit("")))
    hashed = messages.select("session", "at", F.col("role").eqNullSafe("system").alias("system"), F.xxhash64(mark).alias("x"), F.xxhash64(F.lit(1), mark).alias("y"))
    order = Window.partitionBy("session").orderBy("at")
    placed = hashed.withColumn("n", F.row_number().over(order)).withColumn("headed", F.first("system").over(order))
    length = (F.col("n") - F.col("headed").cast("int")).cast("long")
    # Exclusive or of hashes that contain the place: a running aggregate, which no other order of the messages gives.
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    chain = lambda c: F.bit_xor(F.when(length > 0, F.xxhash64(length, F.col(c))).otherwise(0)).over(running)
    return placed.select("session", length.alias("length"), chain("x").alias("h"), chain("y").alias("g"))


def contents(messages: DataFrame, chains: DataFrame) -> DataFrame:
    """Per session with messages: len (all of them), body (without a leading system message) and the hash of the whole body."""
    counted = messages.groupBy("session").agg(F.count(F.lit(1)).alias("len"))
    whole = chains.groupBy("session").agg(F.max(F.struct("length", "h", "g")).alias("w"))
    joined = counted.join(whole, "session", "left")
    return joined.select("session", "len", F.coalesce("w.length", F.lit(0).cast("long")).alias("body"), F.coalesce("w.h", F.lit(0).cast("long")).alias("h"), F.coalesce("w.g", F.lit(0).cast("long")).alias("g"))


def origins(rows: DataFrame) -> DataFrame:
    """(id, origin, in_cycle, found) of sessions (id, parent, recovered) by following the parents of recovered ones. `found`: the
    origin is a session that is not recovered. Else it is the parent that is not there, the last recovered session without a
    parent, or, where parents go round in a circle, the least id of that circle, whose members are `in_cycle`.

    Each round doubles the distance that a pointer spans and drops what has arrived; when a round drops nothing, only circles
    and what leads into them are left. Rounds are cut by Parquet tables.
    """
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("there"), F.col("recovered").alias("goes"), F.col("parent").alias("next"))
    stop = lambda goes, following: ~goes | following.isNull()
    open_ = rows.filter(F.col("recovered") & F.col("parent").isNotNull()).select("id", F.col("parent").alias("up"), F.least("id", "parent").alias("least"))
    done = rows.filter(stop(F.col("recovered"), F.col("parent"))).select("id", F.col("id").alias("origin"), F.lit(False).alias("in_cycle"), (~F.col("recovered")).alias("found"))

    # First step: parents that are missing or ends themselves.
    first = stored(open_.join(known, "up", "left"))
    ended = F.col("there").isNull() | stop(F.col("goes"), F.col("next"))
    done = done.unionByName(first.filter(ended).select("id", F.col("up").alias("origin"), F.lit(False).alias("in_cycle"), (F.col("there").isNotNull() & ~F.coalesce("goes", F.lit(False))).alias("found")))
    # `up` of an open session is another open or just ended session: follow what that one points to.
    ends = done
    left = first.filter(~ended).select("id", "up", "least")
    before, pending = -1, left.count()
    while pending and pending != before:
        jump = left.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("least").alias("lower"))
        hop = left.join(ends.select(F.col("id").alias("up"), "origin", "found"), "up", "left").join(jump, "up", "left")
        hop = stored(hop.select("id", F.coalesce("further", "up").alias("up"), F.least("least", F.coalesce("lower", "least")).alias("least"), "origin", "found"))
        arrived = hop.filter("origin is not null").select("id", "origin", F.lit(False).alias("in_cycle"), "found")
        ends = stored(ends.unionByName(arrived))
        left = hop.filter("origin is null").select("id", "up", "least")
        before, pending = pending, left.count()
    # Only circles: go on until every pointer lies in its circle and has seen all of it.
    for _ in range(pending.bit_length() if pending else 0):
        jump = left.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("least").alias("lower"))
        left = stored(left.join(jump, "up").select("id", F.col("further").alias("up"), F.least("least", "lower").alias("least")))
    if not pending:
        return ends
    circle = left.select(F.col("up").alias("id")).distinct().join(left.select("id", F.col("least").alias("origin")), "id")
    return ends.unionByName(
        left.select("id", "up").join(circle.select(F.col("id").alias("up"), "origin"), "up").join(circle.select("id", F.lit(True).alias("member")), "id", "left").select("id", "origin", F.coalesce("member", F.lit(False)).alias("in_cycle"), F.lit(False).alias("found"))
    )


def classify(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Per session: id, group_id, role, canonical, copy, in_cycle, logical_topic and visible. `rows`: id, parent, recovered,
    preferred (booleans), topic, created, activity, turns (longs); `messages`: see `prefixes`.

    A recovered session that its parent covers is a covered copy. Of the others of a group (of one origin), the only preferred
    one is canonical; else the longest one, if it covers all of them: adopted if it also covers the origin, and the rest become
    covered copies; if not, the one with the most turns and the latest activity. Ties go by activity, then id. Several preferred
    ones count as none; a session without messages covers nothing and is covered by nothing. Sessions that were not recovered are
    visible; of a group whose origin is missing, the canonical one is.
    """
    # Read four times below: places and hashes of all messages, and one row a session.
    every = stored(_chained(messages))
    chains = every.filter("length > 0")
    content = stored(contents(every, chains))
    rows = stored(rows)
    base = rows.join(origins(rows), "id").join(content.withColumnRenamed("session", "id"), "id", "left")
    at = chains.select(F.col("session").alias("parent"), F.col("length").alias("body"), "h", "g").withColumn("same", F.lit(True))
    holds = content.select(F.col("session").alias("parent"), F.lit(True).alias("parent_there"))
    base = base.join(holds, "parent", "left").join(at, ["parent", "body", "h", "g"], "left")
    empty = F.col("body").eqNullSafe(0) & F.coalesce("parent_there", F.lit(False))
    base = stored(base.withColumn("early", F.col("recovered") & (F.coalesce("same", F.lit(False)) | empty)).drop("same", "parent_there"))

    members = base.filter(F.col("recovered") & ~F.col("early"))
    groups = members.groupBy("origin").agg(
        F.min(F.when(F.col("body").isNotNull(), F.struct((-F.col("len")).alias("l"), (-F.col("body")).alias("b"), (-F.col("activity")).alias("a"), "id"))).alias("longest"),
        F.every(F.col("body").isNotNull()).alias("whole"),
        F.count_if("preferred").alias("marked"),
        F.min(F.when(F.col("preferred"), F.col("id"))).alias("chosen"),
        F.min(F.struct((-F.col("turns")).alias("t"), (-F.col("activity")).alias("a"), "id")).alias("stable"),
        F.first("found").alias("found"),
    )
    groups = groups.select("origin", F.col("longest.id").alias("leaf"), "whole", "marked", "chosen", F.col("stable.id").alias("fallback"), "found")
    # What the leaf must cover: at most one row for each length, since two contents of one length cannot both be its prefix.
    roots = base.filter(~F.col("recovered") & F.col("body").isNotNull()).select("origin", "body", "h", "g", F.lit(True).alias("root"))
    parts = members.filter("body is not null").select("origin", "body", "h", "g", F.lit(False).alias("root")).unionByName(roots)
    needs = parts.groupBy("origin", "body", "root").agg(F.min(F.struct("h", "g")).alias("low"), F.max(F.struct("h", "g")).alias("high"))
    own = chains.select(F.col("session").alias("leaf"), F.col("length").alias("body"), F.struct("h", "g").alias("is"))
    checked = needs.join(groups.select("origin", "leaf"), "origin").join(own, ["leaf", "body"], "left")
    fits = (F.col("body") == 0) | ((F.col("low") == F.col("high")) & F.coalesce(F.col("low") == F.col("is"), F.lit(False)))
    verdict = checked.groupBy("origin").agg(F.every(F.when(F.col("root"), True).otherwise(fits)).alias("covers_all"), F.coalesce(F.bool_or(F.when(F.col("root"), fits)), F.lit(False)).alias("covers_root"))
    topics = base.filter(F.col("recovered") & (F.coalesce("topic", F.lit("")) != "")).groupBy("origin").agg(F.min(F.struct("created", "id", "topic")).alias("t"))
    titles = base.filter(~F.col("recovered")).select("origin", F.nullif("topic", F.lit("")).alias("root_topic"))
    facts = base.select("origin").distinct().join(groups, "origin", "left").join(verdict, "origin", "left").join(topics, "origin", "left").join(titles, "origin", "left")

    known = base.join(facts.drop("found"), "origin")
    sure = lambda test: F.coalesce(test, F.lit(False))
    single, agreed, rooted = sure(F.col("marked") == 1), sure(F.col("whole") & F.col("covers_all")), sure(F.col("covers_root"))
    mine = lambda c: F.col("id").eqNullSafe(F.col(c))
    late = F.col("recovered") & ~F.col("early") & ~single & agreed & (~F.col("found") | rooted) & ~mine("leaf")
    copy = F.col("early") | late
    top = F.when(single, mine("chosen")).when(agreed, mine("leaf")).otherwise(mine("fallback"))
    canonical = F.col("recovered") & ~copy & top
    adopted = ~single & agreed & F.col("found") & rooted
    role = F.when(~F.col("recovered"), "normal").when(copy, "covered_copy").when(canonical & single, "preferred").when(canonical & adopted, "adopted").otherwise("diverged")
    anchor = F.coalesce("root_topic", "t.topic", F.concat(F.lit("recovery:"), F.col("origin").cast("string")))
    return known.select("id", F.col("origin").alias("group_id"), role.alias("role"), canonical.alias("canonical"), copy.alias("copy"), "in_cycle", anchor.alias("logical_topic"), (~F.col("recovered") | (canonical & ~F.col("found"))).alias("visible"))
