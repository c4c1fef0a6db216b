"""Full-text search over history: a positional inverted index, phrases by adjacent positions, and pages by keyset.

A query is a set of phrases, any of which may match: quoted parts, and single terms, which are phrases too where a term has
several tokens. Every distinct phrase is looked up once, whatever the number of queries that ask for it: the tokens of all
phrases filter the index, and each place where token j of a phrase stands votes for the start j places before it; a start with
all votes is an occurrence. So a search is equi-joins and counts, never a comparison of texts.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Parameters of the ranking. Fixed values.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows of a page: the default, and the most. Fixed values.
PAGE, MOST = 8, 20


@cache
def _folding() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the letters below the marks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isalpha() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(content: Column | str) -> Column:
    """Words in lower case without diacritics, cut at underscores; runs of CJK characters give overlapping pairs."""
    words = text.tokens_bigram(content)
    return F.filter(F.split(F.translate(F.array_join(words, " "), *_folding()), "[ _]+", -1), lambda t: t != "")


def phrases(query: Column | str) -> Column:
    """The distinct phrases of a query, each an array of tokens."""
    query = F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit(""))
    parts = F.split(query, '"', -1)
    quoted = F.transform(F.filter(parts, lambda p, i: i % 2 == 1), tokens)
    # An opened quote that is not closed is no quote: its part has an odd place, and is the last.
    bare = F.flatten(F.transform(F.filter(parts, lambda p, i: i % 2 == 0), lambda p: F.transform(text.tokens_bigram(p), tokens)))
    return F.array_distinct(F.filter(F.concat(quoted, bare), lambda p: F.size(p) > 0))


def search(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, score) of all documents that hold a phrase of a query. `queries`: query_id, query; `docs`: id, content.

    The score of a phrase is its idf, log((N - n + 0.5) / (n + 0.5)) but LEAST_IDF at least, times its saturated frequency; N, n
    and the lengths are those of all documents, so filters by path or kind belong behind the search. Scores are rounded to six places.
    A text that is null has no tokens; repeated ids are told apart by nothing and count as one document.
    """
    asked = queries.select("query_id", F.explode(phrases("query")).alias("phrase"))
    wanted = asked.select("phrase").distinct().withColumn("size", F.size("phrase"))
    parts = wanted.select("phrase", "size", F.posexplode("phrase").alias("j", "token"))
    listed = docs.select("id", tokens("content").alias("tokens"))
    lengths = listed.select("id", F.size("tokens").cast("long").alias("length"))
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("total"))
    index = listed.select("id", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "token")).join(wanted.select(F.explode("phrase").alias("token")).distinct(), "token", "left_semi")
    votes = index.join(parts, "token").groupBy("phrase", "size", "id", "length", (F.col("at") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("votes"))
    found = votes.filter("votes = size").groupBy("phrase", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    holders = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    hits = asked.join(found, "phrase").join(holders, "phrase").join(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    norm = K1 * (1 - B + B * F.col("length") / (F.col("total") / F.col("docs")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)), 6).alias("score"))


def page(found: DataFrame, size: int = PAGE, after: DataFrame | None = None, keys: tuple[str, ...] = ("path", "idx")) -> DataFrame:
    """The next rows of each query, best first, then by `keys`; adds `rank` within the page. `after`: query_id, score and keys of
    the last row seen; queries without such a row begin at the top. At most MOST rows a page, none for size <= 0."""
    if after is not None:
        seen = after.select("query_id", F.col("score").alias("__score"), *[F.col(k).alias(f"__{k}") for k in keys])
        tie = F.lit(False)
        for k in reversed(keys):
            tie = (F.col(k) > F.col(f"__{k}")) | ((F.col(k) == F.col(f"__{k}")) & tie)
        later = F.col("__score").isNull() | (F.col("score") < F.col("__score")) | ((F.col("score") == F.col("__score")) & tie)
        found = found.join(seen, "query_id", "left").filter(later).select(*found.columns)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(0, min(size, MOST)))
