"""Registered queries of retrieval and reuse decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import decide, retrieval
from ..sources.tables import questions, read, slices

_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{Nd}}_]+')"
_HASH_WORDS = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+')"

_BM25 = f"""d AS (SELECT lang AS scope, doc_id AS id, {_WORDS.format("text")} AS t FROM documents),
q AS (SELECT item_id AS query_id, list_distinct({_WORDS.format("text")}) AS t FROM benchmark),
qt AS (SELECT query_id, unnest(t) AS term FROM q),
p AS (SELECT scope, id, len(t) AS length, unnest(t) AS term FROM d),
tf AS (SELECT scope, id, length, term, count(*)::DOUBLE AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT scope, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
st AS (SELECT scope, count(*)::DOUBLE AS docs, avg(len(t)) AS average FROM d GROUP BY scope),
bm AS (SELECT query_id, scope, id, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * (tf * 22e-1) / (tf + 12e-1 * (25e-2 + 75e-2 * length / average))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (scope, term) JOIN st USING (scope) GROUP BY query_id, scope, id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id, scope) AS top1 FROM bm)"""

_ZONE = """CASE WHEN score <= 0 OR top1 < 45e-2 THEN 'miss' WHEN score / top1 >= 8e-1 AND top1 >= 7e-1 THEN 'hit' WHEN score / top1 >= 55e-2 AND top1 >= 45e-2 THEN 'grey' ELSE 'miss' END"""

_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, strlen({0})), lambda i: ascii({0}[i + 1])::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"

_HASHED = f"""dt AS (SELECT lang AS scope, doc_id AS id, unnest({_HASH_WORDS.format("text")}) AS tok FROM documents),
dc AS (SELECT scope, id, tok, count(*) AS n FROM dt GROUP BY ALL),
qk AS (SELECT item_id AS query_id, unnest({_HASH_WORDS.format("text")}) AS tok FROM benchmark),
qc AS (SELECT query_id, tok, count(*) AS n FROM qk GROUP BY ALL),
hs AS (SELECT tok, {_FNV.format("tok")} AS h FROM (SELECT DISTINCT tok FROM (SELECT tok FROM dc UNION ALL SELECT tok FROM qc))),
db AS (SELECT scope, id, h % 256 AS bucket, sum(CASE WHEN h % 2 = 0 THEN n ELSE -n END)::DOUBLE AS v FROM dc JOIN hs USING (tok) GROUP BY ALL HAVING v <> 0),
qb AS (SELECT query_id, h % 256 AS bucket, sum(CASE WHEN h % 2 = 0 THEN n ELSE -n END)::DOUBLE AS v FROM qc JOIN hs USING (tok) GROUP BY ALL HAVING v <> 0),
dn AS (SELECT scope, id, sqrt(sum(v * v)) AS nd FROM db GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(v * v)) AS nq FROM qb GROUP BY ALL),
hv AS (SELECT query_id, scope, id, round(sum((qb.v / nq) * (db.v / nd)), 6) AS score FROM qb JOIN db USING (bucket) JOIN dn USING (scope, id) JOIN qn USING (query_id) GROUP BY ALL HAVING score > 0)"""


def r01_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    ranked = retrieval.with_zone(retrieval.lexical(questions(spark, folder), slices(spark, folder), 3))
    return ranked.select("query_id", "scope", "rank", "id", "score", "zone")


def r02_hash_vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.top_k(retrieval.hashed_top_k(questions(spark, folder), slices(spark, folder), 3), 3).select("query_id", "scope", "rank", "id", "score")


def r02b_embedding_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return retrieval.vector_search(asked, vectors, 5)


def _routes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    q, s = questions(spark, folder), slices(spark, folder)
    return retrieval.lexical(q, s, 10), retrieval.top_k(retrieval.hashed_top_k(q, s, 10), 10)


def r03_fuse_weighted(spark: SparkSession, folder: str) -> DataFrame:
    fused = retrieval.fuse_weighted(*_routes(spark, folder), 0.5)
    return retrieval.top_k(fused, 5).select("query_id", "scope", "rank", "id", "score", "lexical")


def r04_fuse_rrf(spark: SparkSession, folder: str) -> DataFrame:
    fused = retrieval.fuse_ranks(*_routes(spark, folder), 60)
    return retrieval.top_k(fused, 5).select("query_id", "scope", "rank", "id", "score")


def r06_bm25_zone(spark: SparkSession, folder: str) -> DataFrame:
    ranked = retrieval.with_zone(retrieval.lexical(questions(spark, folder), slices(spark, folder), 10))
    return ranked.groupBy("scope", "zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def r08_l2_decide(spark: SparkSession, folder: str) -> DataFrame:
    """Per query and scope: the ids that are clear hits, in canonical order."""
    ranked = retrieval.with_zone(retrieval.lexical(questions(spark, folder), slices(spark, folder), 5))
    return ranked.groupBy("query_id", "scope").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("zone") == "hit").alias("hits"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("zone") == "hit", F.col("id")))), ",").alias("hit_ids")
    )


def _typed(ranked: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with type, age and labels, as the reuse decision reads them: every third slice is a result."""
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source")
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    kind = F.when(F.col("id") % 3 == 0, "result").otherwise("prompt")
    return retrieval.behind(ranked, docs).join(labels, "id", "left").withColumn("type", kind)


def r09_l3_decide(spark: SparkSession, folder: str) -> DataFrame:
    ranked = retrieval.lexical(questions(spark, folder), slices(spark, folder), 20)
    rows = _typed(ranked, spark, folder).select(
        "query_id", "scope", "id", "type", "score", (F.col("id") % 97 * 86400).alias("created"), (F.col("n_chars") % 7 != 0).alias("same_context"), (F.col("n_chars") % 5 != 0).alias("fresh_files"), "quality"
    )
    return decide.reuse(rows, now=97 * 86400, ttl=60 * 86400).select("query_id", "scope", "outcome", "id", "n_grey", "n_isolated", "n_files", "n_judge_reject")


def p05_lexical_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Reuse decisions over the fused routes: candidates that the lexical route did not find, or hardly, need the judge."""
    lexical, vector = _routes(spark, folder)
    fused = retrieval.top_k(retrieval.fuse_weighted(lexical, vector, 0.2), 10)
    rows = _typed(fused, spark, folder).select(
        "query_id", "scope", "id", "type", "score", F.when(F.col("id") % 11 > 0, F.col("lexical")).alias("lexical"), (F.col("id") % 97 * 86400).alias("created"), F.lit(True).alias("same_context"), (F.col("n_chars") % 5 != 0).alias("fresh_files"), "quality"
    )
    return decide.reuse(rows, now=97 * 86400, ttl=97 * 86400, lexical_floor=0.3).select("query_id", "scope", "outcome", "id", "n_grey", "n_files", "n_judge_reject", "n_unsupported")


def r07_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """What looking up all benchmark items adds to the statistics of the slices that were clear hits."""
    ranked = retrieval.with_zone(retrieval.lexical(questions(spark, folder), slices(spark, folder), 5))
    return retrieval.hit_statistics(ranked, 1_700_000_000)


def j04_vector_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The slices behind the best of the vector route, those of one source gone."""
    ranked = retrieval.top_k(retrieval.hashed_top_k(questions(spark, folder), slices(spark, folder), 3), 3)
    docs = read(spark, folder, "documents").filter("doc_id % 7 <> 3")
    stored = docs.select(F.col("lang").alias("scope"), F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("version"))
    return retrieval.with_slices(ranked, stored).select("query_id", "scope", "rank", "id", "source", "version")


def r10_inject_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the best five slices fit a block of 4096 bytes, later ones may still fit; sizes in bytes."""
    ranked = retrieval.lexical(questions(spark, folder), slices(spark, folder), 5)
    sized = retrieval.behind(ranked, slices(spark, folder).select("id", F.octet_length("content").alias("bytes")))
    return decide.pack(sized, 4096).select("query_id", "scope", "ids", "used", "dropped")


def r24_memory_search(spark: SparkSession, folder: str) -> DataFrame:
    ranked = retrieval.lexical(questions(spark, folder), slices(spark, folder), 8, tokenizer=text.tokens_bigram)
    return retrieval.keep_relative(ranked, 0.15, ("query_id", "scope")).select("query_id", "scope", "rank", "id", "score")


def r26_bm25f(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("body"))
    return retrieval.top_k(retrieval.bm25_fields_top_k(questions(spark, folder), docs, ("name", "body"), 3), 3, ("query_id",)).select("query_id", "rank", "id", "score")


def j16_self_search(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other document of a stated set of documents (ids divisible by 100), within the language."""
    own = slices(spark, folder)
    asked = own.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "scope", F.col("content").alias("query"))
    return retrieval.lexical(asked, own, 1, exclude_self=True).select("query_id", "id", "score")


def w02_route_tops(spark: SparkSession, folder: str) -> DataFrame:
    """Best score of all types and of results alone, and the zones of the best result on both axes."""
    ranked = _typed(retrieval.lexical(questions(spark, folder), slices(spark, folder), 20), spark, folder)
    window = Window.partitionBy("query_id", "scope")
    tops = ranked.withColumn("global_top", F.max("score").over(window)).withColumn("result_top", F.max(F.when(F.col("type") == "result", F.col("score"))).over(window))
    rows = tops.filter("type = 'result'").withColumn("zone", numeric.reuse_zone(F.col("score"), F.col("result_top"), F.col("global_top")))
    return rows.select("query_id", "scope", "id", "score", "result_top", "global_top", "zone")


def f08_query_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical support of each query's best document."""
    best = retrieval.lexical(questions(spark, folder), slices(spark, folder), 1)
    rows = retrieval.behind(best, slices(spark, folder).select("id", "content")).join(questions(spark, folder), "query_id")
    return rows.select("query_id", "scope", "id", F.round(text.query_coverage("query", "content"), 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (r01_bm25_topk, r02_hash_vector_topk, r02b_embedding_topk, r03_fuse_weighted, r04_fuse_rrf, r06_bm25_zone, r08_l2_decide, r09_l3_decide, p05_lexical_gate, r07_lookup, j04_vector_slices, r10_inject_plan, r24_memory_search, r26_bm25f, j16_self_search, w02_route_tops, f08_query_coverage)}

_TYPED = """ty AS (SELECT rk.*, n_chars, CASE WHEN rk.id % 3 = 0 THEN 'result' ELSE 'prompt' END AS type, quality FROM rk JOIN documents ON doc_id = rk.id LEFT JOIN labels l ON l.doc_id = rk.id WHERE rank <= 20),
tt AS (SELECT *, max(score) OVER w AS global_top, max(CASE WHEN type = 'result' THEN score END) OVER w AS result_top FROM ty WINDOW w AS (PARTITION BY query_id, scope)),
zz AS (SELECT *, CASE WHEN score <= 0 OR result_top <= 0 OR global_top <= 0 THEN 'miss' WHEN score / result_top >= 8e-1 AND score / global_top >= 45e-2 AND global_top >= 7e-1 THEN 'hit'
  WHEN score / result_top >= 55e-2 AND score / global_top >= 45e-2 AND global_top >= 45e-2 THEN 'grey' ELSE 'miss' END AS zone FROM tt WHERE type = 'result')"""

SQL = {
    "r01_bm25_topk": f"WITH {_BM25} SELECT query_id, scope, rank, id, score, {_ZONE} AS zone FROM rk WHERE rank <= 3",
    "r02_hash_vector_topk": f"WITH {_HASHED} SELECT query_id, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank, id, score FROM hv QUALIFY rank <= 3",
    "r02b_embedding_topk": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS score FROM n a, n b WHERE a.vec_id % 100 = 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5""",
    "r03_fuse_weighted": f"""WITH {_BM25}, {_HASHED},
a AS (SELECT query_id, scope, id, score / top1 AS lexical FROM rk WHERE rank <= 10 AND top1 > 0),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id, scope) AS top FROM hv),
b AS (SELECT query_id, scope, id, score / top AS semantic FROM hr WHERE rank <= 10),
f AS (SELECT query_id, scope, id, round(5e-1 * coalesce(lexical, 0) + 5e-1 * coalesce(semantic, 0), 6) AS score, round(coalesce(lexical, 0), 6) AS lexical FROM a FULL JOIN b USING (query_id, scope, id))
SELECT query_id, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank, id, score, lexical FROM f WHERE score > 0 QUALIFY rank <= 5""",
    "r04_fuse_rrf": f"""WITH {_BM25}, {_HASHED},
u AS (SELECT query_id, scope, id, rank FROM rk WHERE rank <= 10 UNION ALL SELECT query_id, scope, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank FROM hv) WHERE rank <= 10),
f AS (SELECT query_id, scope, id, round(sum(1e0 / (60 + rank)) * 61 / 2, 6) AS score FROM u GROUP BY ALL)
SELECT query_id, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank, id, score FROM f QUALIFY rank <= 5""",
    "r06_bm25_zone": f"WITH {_BM25}, z AS (SELECT scope, {_ZONE} AS zone, score FROM rk WHERE rank <= 10) SELECT scope, zone, count(*) AS n, round(avg(score), 4) AS mean_score FROM z GROUP BY ALL",
    "r08_l2_decide": f"""WITH {_BM25}, z AS (SELECT *, {_ZONE} AS zone FROM rk WHERE rank <= 5)
SELECT query_id, scope, count(*) AS candidates, count(*) FILTER (zone = 'hit') AS hits, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (zone = 'hit'), '') AS hit_ids FROM z GROUP BY ALL""",
    "r09_l3_decide": f"""WITH {_BM25}, {_TYPED},
g AS (SELECT *, CASE WHEN 97 * 86400 - id % 97 * 86400 < 0 OR id % 97 = 0 OR 97 * 86400 - id % 97 * 86400 > 60 * 86400 THEN 'miss' WHEN 97 * 86400 - id % 97 * 86400 > 30 * 86400 THEN 'grey' ELSE 'hit' END AS fz FROM zz),
h AS (SELECT *, CASE WHEN zone = 'miss' OR fz = 'miss' THEN 'miss' WHEN zone = 'grey' OR fz = 'grey' THEN 'grey' ELSE 'hit' END AS z2 FROM g),
o AS (SELECT *, CASE WHEN z2 = 'miss' THEN 'zone' WHEN n_chars % 7 = 0 THEN 'isolated' WHEN n_chars % 5 = 0 THEN 'files' WHEN z2 = 'grey' AND coalesce(quality, 0) <> 1 THEN 'judge' ELSE 'pass' END AS gate FROM h)
SELECT query_id, scope, CASE WHEN bool_or(gate = 'pass') THEN 'reuse' ELSE 'forward' END AS outcome, arg_min(CASE WHEN gate = 'pass' THEN id END, CASE WHEN gate = 'pass' THEN rank END) AS id,
 count(*) FILTER (z2 = 'grey') AS n_grey, count(*) FILTER (gate = 'isolated') AS n_isolated, count(*) FILTER (gate = 'files') AS n_files, count(*) FILTER (gate = 'judge') AS n_judge_reject FROM o GROUP BY ALL""",
    "p05_lexical_gate": f"""WITH {_BM25}, {_HASHED},
a AS (SELECT query_id, scope, id, score / top1 AS lexical FROM rk WHERE rank <= 10 AND top1 > 0),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id, scope) AS top FROM hv),
b AS (SELECT query_id, scope, id, score / top AS semantic FROM hr WHERE rank <= 10),
f AS (SELECT query_id, scope, id, round(2e-1 * coalesce(lexical, 0) + (1 - 2e-1) * coalesce(semantic, 0), 6) AS score, round(coalesce(lexical, 0), 6) AS lexical FROM a FULL JOIN b USING (query_id, scope, id)),
t0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank FROM f WHERE score > 0 QUALIFY rank <= 10),
ty AS (SELECT t0.*, n_chars, CASE WHEN t0.id % 3 = 0 THEN 'result' ELSE 'prompt' END AS type, quality FROM t0 JOIN documents ON doc_id = t0.id LEFT JOIN labels l ON l.doc_id = t0.id),
tt AS (SELECT *, max(score) OVER w AS global_top, max(CASE WHEN type = 'result' THEN score END) OVER w AS result_top FROM ty WINDOW w AS (PARTITION BY query_id, scope)),
zz AS (SELECT *, CASE WHEN score / result_top >= 8e-1 AND score / global_top >= 45e-2 AND global_top >= 7e-1 THEN 'hit' WHEN score / result_top >= 55e-2 AND score / global_top >= 45e-2 AND global_top >= 45e-2 THEN 'grey' ELSE 'miss' END AS zone,
    CASE WHEN id % 97 = 0 THEN 'miss' WHEN 97 - id % 97 > 485e-1 THEN 'grey' ELSE 'hit' END AS fz FROM tt WHERE type = 'result'),
h AS (SELECT *, CASE WHEN zone = 'miss' OR fz = 'miss' THEN 'miss' WHEN zone = 'grey' OR fz = 'grey' THEN 'grey' ELSE 'hit' END AS z0, z0 = 'hit' AND id % 11 > 0 AND lexical < 3e-1 AS blocked, CASE WHEN blocked THEN 'grey' ELSE z0 END AS z FROM zz),
o AS (SELECT *, CASE WHEN z = 'miss' THEN 'zone' WHEN n_chars % 5 = 0 THEN 'files' WHEN z = 'grey' AND coalesce(quality, 0) <> 1 THEN 'judge' ELSE 'pass' END AS gate FROM h)
SELECT query_id, scope, CASE WHEN bool_or(gate = 'pass') THEN 'reuse' ELSE 'forward' END AS outcome, arg_min(CASE WHEN gate = 'pass' THEN id END, CASE WHEN gate = 'pass' THEN rank END) AS id, count(*) FILTER (z = 'grey') AS n_grey,
 count(*) FILTER (gate = 'files') AS n_files, count(*) FILTER (gate = 'judge') AS n_judge_reject, count(*) FILTER (blocked) AS n_unsupported FROM o GROUP BY query_id, scope""",
    "r07_lookup": f"WITH {_BM25}, z AS (SELECT *, {_ZONE} AS zone FROM rk WHERE rank <= 5) SELECT scope, id, count(*) AS hits, 1700000000::BIGINT AS last_used FROM z WHERE zone = 'hit' GROUP BY scope, id",
    "j04_vector_slices": f"""WITH {_HASHED}, r AS (SELECT query_id, scope, id, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id)::INT AS rank FROM hv QUALIFY rank <= 3)
SELECT query_id, scope, rank, id, source, sha256(text) AS version FROM r JOIN documents ON doc_id = id AND lang = scope WHERE id % 7 <> 3""",
    "r10_inject_plan": f"""WITH RECURSIVE {_BM25}, i AS (SELECT query_id, scope, rank, id, strlen(text) AS bytes, strlen(printf('--- slice %d (score=%.2f) ---', id, score)) + 1 AS head FROM rk JOIN documents ON doc_id = id WHERE rank <= 5),
f AS (SELECT DISTINCT query_id, scope, 0::BIGINT AS rank, 8::BIGINT AS used, []::BIGINT[] AS ids, 0 AS dropped FROM i
  UNION ALL SELECT query_id, scope, i.rank, CASE WHEN fits THEN used + head + bytes + 1 ELSE used END, CASE WHEN fits THEN list_append(ids, id) ELSE ids END, dropped + (NOT fits)::INT
  FROM (SELECT f.query_id, f.scope, f.used, f.ids, f.dropped, i.rank, i.id, i.bytes, i.head, NOT (f.used + i.bytes + 8 + 64 > 4096 AND len(f.ids) > 0) AS fits FROM f JOIN i ON i.query_id = f.query_id AND i.scope = f.scope AND i.rank = f.rank + 1) i)
SELECT query_id, scope, array_to_string(list_sort(ids), ',') AS ids, used, dropped FROM f QUALIFY row_number() OVER (PARTITION BY query_id, scope ORDER BY rank DESC) = 1""",
    "r24_memory_search": f"WITH {_BM25} SELECT query_id, scope, rank, id, score FROM rk WHERE score >= 15e-2 * top1 AND rank <= 8",
    "j16_self_search": f"""WITH d AS (SELECT lang AS scope, doc_id AS id, {_WORDS.format("text")} AS t FROM documents),
qt AS (SELECT scope, id AS query_id, unnest(list_distinct(t)) AS term FROM d WHERE id % 100 = 0),
p AS (SELECT scope, id, len(t) AS length, unnest(t) AS term FROM d),
tf AS (SELECT scope, id, length, term, count(*)::DOUBLE AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT scope, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL), st AS (SELECT scope, count(*)::DOUBLE AS docs, avg(len(t)) AS average FROM d GROUP BY scope),
bm AS (SELECT query_id, id, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * (tf * 22e-1) / (tf + 12e-1 * (25e-2 + 75e-2 * length / average))), 6) AS score
  FROM qt JOIN tf USING (scope, term) JOIN df USING (scope, term) JOIN st USING (scope) WHERE query_id <> id GROUP BY ALL)
SELECT query_id, id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""",
    "w02_route_tops": f"WITH {_BM25}, {_TYPED} SELECT query_id, scope, id, score, result_top, global_top, zone FROM zz",
    "f08_query_coverage": f"""WITH {_BM25}, b AS (SELECT query_id, scope, id FROM rk WHERE rank = 1)
SELECT query_id, b.scope, b.id, round(len(list_intersect(q.t, d.t)) / len(q.t), 6) AS coverage FROM b JOIN q USING (query_id) JOIN d ON d.id = b.id""",
}
