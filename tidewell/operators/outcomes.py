"""What the rounds of a session achieved: gains, churn, verification debt, receipts and criteria.

Receipts: session, round_no, seq, tool, args, ok, changes (a mutation or write), command, bookkeeping (a proof of a step or a
list of tasks), reads, output_bytes, paths (array), verify and exercises (whether the command verifies or exercises a change).
Rounds without receipts leave no rows and are not seen. A session's receipts are ordered by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .progress import command_gains

#: Gains of a receipt that is no command, and how many rounds of only looking still count. Fixed values.
NEW_READ, NEW_ACTION, MUTATION, TASK_PROGRESS, DELEGATED, LOOKING_ROUNDS = 1, 1, 3, 1, 2, 6
#: Tools that hand work to others. Fixed values.
DELEGATES = ("task", "parallel_tasks", "fleet")


def _kinds(receipts: DataFrame) -> DataFrame:
    """Adds `kind`, the first of the classes that a receipt is of, and trims the command."""
    ok = F.coalesce("ok", F.lit(False))
    command = F.trim(F.coalesce("command", F.lit("")))
    looked = F.col("reads") & (F.col("output_bytes") > 0) & (F.size(F.coalesce("paths", F.array().cast("array<string>"))) > 0)
    kind = (
        F.when(command != "", "command")
        .when(~ok, "failed")
        .when(F.col("changes"), "change")
        .when(F.col("tool").isin(*DELEGATES), "delegate")
        .when(F.col("bookkeeping"), "book")
        .when(looked, "read")
        .otherwise("other")
    )
    return receipts.withColumn("ok", ok).withColumn("command", command).withColumn("kind", kind)


def _novelty(rows: DataFrame) -> DataFrame:
    """Adds `fresh`, the paths that no earlier read of the session had, and `asked`, whether tool and arguments are new."""
    read = rows.filter("kind = 'read'").select("session", "seq", F.explode("paths").alias("path")).filter("path <> ''")
    fresh = read.groupBy("session", "path").agg(F.min("seq").alias("seq")).groupBy("session", "seq").agg(F.count(F.lit(1)).alias("fresh"))
    asks = F.col("kind").isin("read", "other")
    first = F.min(F.when(asks, F.col("seq"))).over(Window.partitionBy("session", "tool", "args"))
    out = rows.withColumn("asked", asks & (F.col("seq") == first)).join(fresh, ["session", "seq"], "left")
    return out.withColumn("fresh", F.coalesce("fresh", F.lit(0)))


def _looks(new: int) -> Column:
    """What a read brings: its new paths, or `new` for a new question about known ones."""
    return F.when(F.col("fresh") > 0, F.col("fresh") * new).when(F.col("asked"), new).otherwise(0)


def round_gains(receipts: DataFrame) -> DataFrame:
    """(session, round_no, gain, looking): the evidence each round gained; after LOOKING_ROUNDS rounds of only looking, none."""
    rows = _novelty(_kinds(receipts))
    commands = command_gains(rows.filter("kind = 'command'")).select("session", "seq", F.col("gain").alias("command_gain"))
    gain = (
        F.when(F.col("kind") == "command", F.col("command_gain"))
        .when(F.col("kind") == "change", MUTATION)
        .when(F.col("kind") == "delegate", DELEGATED)
        .when(F.col("kind") == "book", TASK_PROGRESS)
        .when(F.col("kind") == "read", _looks(NEW_READ))
        .when(F.col("asked"), NEW_ACTION)
        .otherwise(0)
    )
    acted = F.col("changes") | (F.col("command") != "")
    rounds = rows.join(commands, ["session", "seq"], "left").groupBy("session", "round_no").agg(F.sum(gain).alias("gain"), F.max(acted).alias("acted"))
    order = Window.partitionBy("session").orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = rounds.withColumn("run", F.sum(F.col("acted").cast("int")).over(order))
    inside = Window.partitionBy("session", "run").orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)
    looking = F.sum((~F.col("acted")).cast("int")).over(inside)
    return runs.withColumn("looking", looking).select("session", "round_no", F.when(F.col("looking") > LOOKING_ROUNDS, 0).otherwise(F.col("gain")).alias("gain"), "looking")


def outcomes(receipts: DataFrame) -> DataFrame:
    """Per round: exploration, churn, discriminating and verifying runs, transitions of verifiers, and the verification debt.

    A discriminating run settles the debt; else a change opens it, and every round ages it until it is settled. `blind` are
    the changes since the debt was settled last.
    """
    rows = _novelty(_kinds(receipts))
    run = F.col("kind") == "command"
    verify = run & F.col("verify")
    earlier = Window.partitionBy("session", "command", "kind", "verify").orderBy("seq")
    before = F.lag("ok").over(earlier)
    alike = Window.partitionBy("session", "command", "kind", "ok").orderBy("seq")
    first = F.row_number().over(alike) == 1
    explored = (
        F.when(run & F.col("ok"), (~F.col("verify") & first).cast("int"))
        .when(run, first.cast("int"))
        .when(F.col("kind") == "delegate", 1)
        .when(F.col("kind") == "read", _looks(1))
        .when((F.col("kind") == "other") & F.col("asked"), 1)
        .otherwise(0)
    )
    churn = (F.col("kind") == "change") | (run & F.col("ok") & F.col("changes"))
    scored = rows.select(
        "session",
        "round_no",
        explored.alias("exploration"),
        churn.alias("churn"),
        (run & (F.col("verify") | F.col("exercises"))).alias("discriminating"),
        verify.alias("verification"),
        (verify & F.col("ok") & ~before).alias("objective"),
        (verify & ~F.col("ok") & before).alias("regression"),
    )
    counts = ("churn", "discriminating", "verification", "objective", "regression")
    rounds = scored.groupBy("session", "round_no").agg(F.sum("exploration").alias("exploration"), *[F.count_if(c).alias(c) for c in counts])
    order = Window.partitionBy("session").orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)
    settles = F.col("discriminating") > 0
    spans = rounds.withColumn("span", F.sum(settles.cast("int")).over(order))
    inside = Window.partitionBy("session", "span").orderBy("round_no").rowsBetween(Window.unboundedPreceding, 0)
    debts = spans.withColumn("blind", F.sum(F.when(settles, 0).otherwise(F.col("churn"))).over(inside))
    aged = debts.withColumn("debt_age", F.sum((F.col("blind") > 0).cast("int")).over(inside))
    return aged.drop("span")


def receipt_summary(receipts: DataFrame) -> DataFrame:
    """Per session: successful writes, commands, task lists, signed-off steps and reviews. A receipt may count in several.

    `receipts` further has `review`, whether it completed a review.
    """
    done = lambda test: F.count_if(F.col("ok") & test)
    return receipts.groupBy("session").agg(
        done(F.col("changes")).alias("writes"),
        done(F.coalesce("command", F.lit("")) != "").alias("commands"),
        done(F.col("tool") == "todo_write").alias("todos"),
        done((F.col("tool") == "complete_step") & F.col("bookkeeping")).alias("signoffs"),
        done(F.col("review")).alias("reviews"),
    )


def criteria(wanted: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds `evidence`, how many of a criterion's references are to accepted findings, and `status`: open only if required
    and without evidence. `wanted`: task, criterion, required, references (array of ids, repeated ones count); `findings`:
    task, finding, accepted. A finding counts as accepted if any of its rows is."""
    accepted = findings.filter("accepted").select("task", "finding").distinct()
    asked = wanted.select("task", "criterion", F.explode("references").alias("finding"))
    counted = asked.join(accepted, ["task", "finding"]).groupBy("task", "criterion").agg(F.count(F.lit(1)).alias("evidence"))
    rows = wanted.join(counted, ["task", "criterion"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("required") & (F.col("evidence") == 0), "open").otherwise("satisfied"))
