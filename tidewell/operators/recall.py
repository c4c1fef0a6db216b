"""Recall of remembered facts: identity, freshness, distinctive matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import retrieval

#: Queries that say nothing. Fixed values.
GENERIC = ("continue", "please continue", "go on", "next", "ok", "okay", "yes", "no", "继续", "好的", "好", "是", "否", "下一步")
#: Factors of scope and freshness, the share of the best score that a hit needs. Fixed values.
PROJECT, STALE, RATIO = 1.08, 0.92, 0.24


def generic(query: Column) -> Column:
    return F.lower(text.normalize_space(query)).isin(*GENERIC)


def identity_keys(facts: DataFrame) -> DataFrame:
    """(id, scope, key): what makes two facts the same: id, name, title, subject."""
    keys = F.array(
        F.concat(F.lit("id:"), F.col("id").cast("string")),
        F.when(F.col("name").isNotNull(), F.concat(F.lit("name:"), F.lower(F.regexp_replace("name", "[^\\p{L}\\p{Nd}]+", "-")))),
        F.when(text.title_key("title") != "", F.concat(F.lit("title:"), text.title_key("title"))),
        F.when(text.subject_key("subject") != "", F.concat(F.lit("subject:"), text.subject_key("subject"))),
    )
    return facts.select("id", "scope", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def visible(facts: DataFrame) -> DataFrame:
    """Facts without pinned ones and without global ones that a project's fact of the same identity overrides."""
    open_ = facts.filter(F.coalesce("activation", F.lit("")) != "pinned")
    keys = identity_keys(open_)
    hidden = keys.filter("scope <> 'project'").join(keys.filter("scope = 'project'").select("key").distinct(), "key", "left_semi").select("id").distinct()
    return open_.join(hidden, "id", "left_anti")


def recall(queries: DataFrame, facts: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, rank, id, score, freshness): facts (id, scope, content, freshness, updated) for queries (query_id, query).

    A fact needs two of the query's terms, or the one term of a short query if it is long. Expired facts are left out, stale
    ones count less, a project's own ones more; what scores under RATIO of the best is dropped.
    """
    asked = queries.filter(~generic(F.col("query")))
    factor = F.when(F.col("scope") == "project", PROJECT).otherwise(1.0) * F.when(F.col("freshness") == "stale", STALE).otherwise(1.0)
    usable = F.coalesce(F.col("freshness") != "expired", F.lit(False))
    docs = facts.select(F.lit("facts").alias("scope"), "id", "content", usable.alias("open"), factor.alias("factor"), F.coalesce(F.col("updated").cast("long"), F.lit(-(1 << 63))).alias("later"))
    # Two terms are needed; the one long term of a short query is worth two.
    worth = F.when((F.col("asked") <= 2) & (F.char_length("term") >= 6), 2).otherwise(1)
    found = retrieval.bm25_top_k(asked, docs, limit, text.tokens_bigram, points=worth)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("later"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    kept = retrieval.keep_relative(ranked.select("query_id", "rank", "id", "score"), RATIO)
    return retrieval.behind(kept, facts.select("id", "freshness")).select("query_id", "rank", "id", "score", "freshness")


def symbols(rows: DataFrame, kind: str | None, needle: str) -> DataFrame:
    """Code symbols (name, parent, signature, kind) of a kind whose texts hold the needle, in any case."""
    found = F.lower(F.concat_ws("\n", "name", "parent", "signature")).contains(needle.lower())
    return rows.filter(found & (F.lit(True) if kind is None else F.col("kind") == kind))


def grep(files: DataFrame, pattern: str, most: int = 200) -> DataFrame:
    """(path, line, text) of lines that match, at most `most`, in order; files (path, content) with a NUL are binary."""
    lines = files.filter(~F.col("content").contains("\x00")).select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return lines.filter(F.col("text").rlike(pattern)).withColumn("line", F.col("line") + 1).orderBy("path", "line").limit(most)
