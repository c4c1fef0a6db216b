"""BM25 in blocks of queries against the join, and the queries that use it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewell.operators import retrieval

WORDS = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "Op", "qr", "st"]
DATA = "/root/testdata/sf0.001"
#: Queries whose pairs of query and document must not be joined.
BLOCKED = ["r01_bm25_topk", "f08_query_coverage", "r03_fuse_weighted", "r04_fuse_rrf", "p05_lexical_gate", "j16_self_search", "r21_dashboard", "r06_bm25_zone", "r07_lookup", "r08_l2_decide", "r18_verify_replay", "r10_inject_plan", "r24_memory_search", "a15_policy_eval", "w02_route_tops", "a30_top_sources", "r09_l3_decide", "w11_recall_blocks", "r15_assembled", "j05_history_join", "r27_history_search", "r25_auto_recall"]


def _tables(spark):
    docs = [(None if i % 29 == 0 else f"s{i % 3}", i, None if i % 31 == 0 else " ".join(WORDS[(i * j * j + i // 7) % 10] for j in range(1, i % 11 + 1))) for i in range(1, 240)]
    asked = [(i, " ".join(WORDS[(i * 3 + j) % 10] for j in range(i % 5))) for i in range(1, 30)] + [(None, "ab cd")]
    return spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(docs, "scope string, id long, content string")


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "scope", "id", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("size", [retrieval.BROADCAST_BYTES, 700])
@pytest.mark.parametrize("share", [retrieval._SHARE, 0.0, 2.0])
def test_as_the_join_finds_them(spark, monkeypatch, size, share):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
    monkeypatch.setattr(retrieval, "_SHARE", share)
    queries, docs = _tables(spark)
    assert _rows(retrieval.lexical(queries, docs, 3)) == _rows(retrieval.top_k(retrieval.bm25(queries, docs), 3))
    own = docs.filter("id % 4 = 0").select(F.col("id").alias("query_id"), "scope", F.col("content").alias("query"))
    assert _rows(retrieval.lexical(own, docs, 2, exclude_self=True)) == _rows(retrieval.top_k(retrieval.bm25(own, docs, exclude_self=True), 2))


def test_equal_ids_and_documents_that_are_no_results(spark):
    queries, docs = _tables(spark)
    twice = docs.unionAll(docs.filter("id < 40"))
    assert _rows(retrieval.lexical(queries, twice, 3)) == _rows(retrieval.top_k(retrieval.bm25(queries, twice), 3))
    marked = docs.withColumn("open", F.col("id") % 3 > 0)
    wanted = retrieval.top_k(retrieval.bm25(queries, docs).filter("id % 3 > 0"), 3)
    assert _rows(retrieval.lexical(queries, marked, 3)) == _rows(wanted)
    assert retrieval.lexical(queries, docs, 0).count() == 0 and retrieval.lexical(queries.limit(0), docs, 2).count() == 0


@pytest.mark.parametrize("name", BLOCKED)
def test_scored_where_texts_are_read(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS df#" not in plan


@pytest.mark.parametrize("size", [retrieval.BROADCAST_BYTES, 200])
def test_nearest_vectors_as_the_loop_finds_them(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
    vectors = spark.createDataFrame([(i, [float((i * p) % 7 - 3) for p in (1, 2, 5)] + [0.5]) if i else (0, [0.0] * 4) for i in range(90)], "id long, vector array<float>")
    asked = vectors.filter("id % 9 = 0").withColumnRenamed("id", "query_id")
    score = F.round(retrieval.numeric.cosine(F.col("q"), F.col("v")), 6).alias("score")
    pairs = asked.select("query_id", F.col("vector").alias("q")).crossJoin(vectors.select("id", F.col("vector").alias("v"))).select("query_id", "id", score)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    found = retrieval.vector_search(asked, vectors, 4)
    assert rows(found) == rows(retrieval.top_k(pairs, 4, ("query_id",)))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [retrieval.BROADCAST_BYTES, 700])
def test_fields_as_the_join_finds_them(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
    queries, docs = _tables(spark)
    docs = docs.select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("cd_ef "), F.col("scope"))).alias("name"), F.concat(F.coalesce("content", F.lit("")), F.lit(" getAb12 漢字")).alias("body"))
    asked = queries.unionByName(spark.createDataFrame([(90, "getAb12"), (91, "漢字 s1"), (92, "nowhere")], "query_id long, query string"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()), key=str)
    for docs in (docs, docs.unionAll(docs.filter("id < 9")), docs.unionAll(docs.limit(1).withColumn("id", F.lit(None).cast("long"))), docs.limit(0)):
        want = retrieval.top_k(retrieval.bm25_fields(asked, docs, ("name", "body")), 4, ("query_id",))
        assert rows(retrieval.top_k(retrieval.bm25_fields_top_k(asked, docs, ("name", "body"), 4), 4, ("query_id",))) == rows(want)


def test_fields_are_scored_where_texts_are_read(spark):
    plan = __spark_entry__.queries()["r26_bm25f"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS df#" not in plan


@pytest.mark.parametrize("size", [retrieval.BROADCAST_BYTES, 700])
def test_sections_as_the_join_finds_them(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
    queries, docs = _tables(spark)
    i = F.col("id")
    sections = docs.select("id", "content", F.when(i % 4 > 0, F.substring_index("content", " ", 2)).alias("heading"), F.when(i % 3 == 0, "en").otherwise("de").alias("locale"), F.when(i % 37 == 0, "1.2.3").alias("version"))
    asked = queries.filter("query_id is not null").unionByName(spark.createDataFrame([(90, "v1.2.3 ab"), (91, "AB cd")], "query_id long, query string"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))
    found = rows(retrieval.docs_search(asked, sections, "en", 3))
    joined = []
    monkeypatch.setattr(retrieval, "bm25_top_k", lambda *a, **k: joined.append(1))
    asked_terms = asked.select("query_id", "query", retrieval.text.unique_terms(retrieval.text.tokens("query")).alias("terms"))
    named = spark.createDataFrame([(90, "1.2.3")], "query_id long, version string")
    every = retrieval._with_bonuses(asked_terms, named, sections, F.when(F.col("locale") == "en", 1.15).otherwise(1.0)).join(sections.select("id", "content"), "id")
    said = (F.col("query") != "") & F.contains(F.lower("content"), F.lower(F.trim("query")))
    final = every.select("query_id", "id", F.round((F.col("plain") + F.when(said, 1.5).otherwise(0.0)) * F.col("factor"), 8).alias("score"))
    want = rows(retrieval.top_k(retrieval.keep_relative(final, retrieval.FLOOR), 3, ("query_id",)))
    assert found == want and {r[2] for r in found if r[0] == 90} <= {37, 74, 111, 148, 185, 222} and not joined
    assert retrieval.docs_search(asked, sections.unionAll(sections.filter("id = 1")), "en", 3).count() > 0 and not joined


def test_sections_are_scored_where_texts_are_read(spark):
    plan = __spark_entry__.queries()["r29_docs_search"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS df#" not in plan
