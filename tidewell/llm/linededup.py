"""Repeated lines, found by sorting hashes: every line long enough becomes (hash, document, position), these are dealt by
range of the hash and sorted by document and position, and one pass over each range meets a line's first occurrence before
all others. What comes back is no text but, for each document, the run lengths of kept and dropped lines.

Plan: one scan writes the hashes of lines to the shared folder; a mergeable sketch over them finds lines that are too
frequent for one task. Those are few by construction, so their totals are aggregated before the exchange and broadcast back;
all other lines go through one range exchange and a window. Texts are exchanged once, by document, to meet their run lengths;
a caller that wants run lengths only exchanges no text. No Python runs on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, let, materialize

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: Sketch entries per shuffle partition, and their bound: 65,536 hot hashes of 64 bytes at most are broadcast (4 MiB).
HOT_PER_PARTITION, MOST_HOT = 4, 1 << 16


def lines_of(text: Column) -> Column:
    """The lines between \\n; null or empty text gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line: A-Z lower-cased, without space and \\x09-\\x0D at both ends."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)))


def run_lengths(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap of `n_lines` lines without those at the ascending positions `dropped`, compressed to the lengths of its
    runs: kept, dropped, kept and so on, ending with a kept run, which may be 0."""
    one, zero = F.lit(1), F.lit(0)

    def build(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - one) != x - one))
        ends = F.filter(p, lambda x, i: (i == F.size(p) - one) | (F.get(p, i + one) != x + one))
        return let(F.struct(starts.alias("s"), ends.alias("e")), lambda b: F.concat(F.flatten(F.transform(b["s"], lambda s, i: pair(b["e"], s, i))), F.array(n_lines - tail(b["e"]))))

    def pair(ends: Column, start: Column, i: Column) -> Column:
        before = F.when(i == 0, zero).otherwise(F.get(ends, i - one) + one)
        return F.array(start - before, F.get(ends, i) + one - start)

    def tail(ends: Column) -> Column:
        return F.when(F.size(ends) == 0, zero).otherwise(F.element_at(ends, -1) + one)

    return let(dropped, build)


def apply_runs(text: Column, runs: Column) -> Column:
    """The kept lines of `text`, joined by \\n."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return let(flags, lambda f: F.array_join(F.filter(lines_of(text), lambda _, i: F.get(f, i)), "\n"))


def _verdicts(lines: DataFrame, least_documents: int) -> DataFrame:
    """The rows of `lines` (__id, __text, __at, __h, __g) to drop: their line is in `least_documents` documents and __id is
    not the largest of them."""
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(MOST_HOT, max(1024, HOT_PER_PARTITION * partitions))
    # Sketches merge in two levels, so that no task reads those of all others.
    parts = lines.groupBy(F.spark_partition_id() % 64).agg(F.expr(f"approx_top_k_accumulate(__h, {tracked}) as __s"))
    top = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(__s, {tracked}), {tracked}) as __top"))
    total = lines.count()
    share = max(1, total // (HOT_PER_PARTITION * partitions))
    hot = materialize(top.select(F.explode("__top").alias("__t")).filter(F.col("__t.count") > share).select(F.col("__t.item").alias("__h")), "hot-lines")

    light = lines.join(F.broadcast(hot), "__h", "left_anti").repartitionByRange("__h", "__g").sortWithinPartitions("__h", "__g", F.desc("__id"), "__at")
    line = Window.partitionBy("__h", "__g")
    first = line.orderBy(F.desc("__id"))
    streamed = light.select("*", F.first("__id").over(first).alias("__keeper"), F.dense_rank().over(first).alias("__nth")).withColumn("__n", F.max("__nth").over(line))

    heavy = lines.join(F.broadcast(hot), "__h")
    known = heavy.groupBy("__h", "__g", "__id").agg(F.lit(1).alias("__one")).groupBy("__h", "__g").agg(F.max("__id").alias("__keeper"), F.count("__one").alias("__n"))
    # At most one row for each hot hash, but for hashes that agree in __h alone.
    summed = heavy.join(F.broadcast(known), ["__h", "__g"])
    columns = ["__id", "__text", "__at", "__keeper", "__n"]
    both = streamed.select(columns).unionByName(summed.select(columns))
    return both.filter((F.col("__n") >= least_documents) & ~F.col("__id").eqNullSafe(F.col("__keeper"))).select("__id", "__text", "__at")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, keep_text: bool = False) -> DataFrame:
    """Per row of `docs`: its columns (the text only with `keep_text`), `n_lines`, `n_dropped` (long) and `keep_runs`
    (array<int>, see `run_lengths`).

    A line whose key has `least_chars` code points and is in `least_documents` documents goes from all of them but that of
    the largest `key`, where all its occurrences stay; repeats within one document are no reason to drop. A null or empty
    text is one empty line. Rows that share a `key` are one document in the count, and all rows with the largest key keep
    the line; null keys are one document too, smaller than all others. A text of any length is one row of work. An empty
    table gives an empty result. Columns of `docs` named n_lines, n_dropped or keep_runs are replaced, names starting with
    ``__`` are reserved.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs") and (keep_text or c != text)]
    source = docs.select(F.col(f"`{key}`").alias("__id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__text"), line_keys(F.col(f"`{text}`")).alias("__keys"))
    exploded = source.select("__id", "__text", F.posexplode("__keys").alias("__at", "__key")).filter(F.char_length("__key") >= least_chars)
    lines = materialize(exploded.select("__id", "__text", "__at", F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit(1), "__key").alias("__g")), "line-hashes")

    # Rows equal in key and text have equal verdicts: the set of positions does not grow with their number.
    dropped = _verdicts(lines, least_documents).groupBy("__id", "__text").agg(F.sort_array(F.collect_set("__at")).alias("__dropped"))
    found = dropped.select(F.col("__id").alias("__key"), F.col("__text").alias("__same"), "__dropped")
    rows = docs.select(
        F.struct(*columns).alias("__row"),
        F.col(f"`{key}`").alias("__id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__text"),
        F.size(lines_of(F.col(f"`{text}`"))).alias("__lines"),
    )
    joined = rows.join(found, F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__same")), "left")
    positions = F.coalesce("__dropped", F.array().cast("array<int>"))
    return joined.select("__row.*", F.col("__lines").cast("long").alias("n_lines"), F.size(positions).cast("long").alias("n_dropped"), run_lengths(positions, F.col("__lines")).alias("keep_runs"))
