"""Full-text history search against an embedded full-text index, phrases by hand, and pages that neither skip nor repeat."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidewell.operators import history

WORDS = ["sort", "list", "Été", "ete", "foo_bar", "foo", "bar", "naïve", "x1", "the", "the", "the", "Ωmega", "don't"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, content string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def test_scores_match_an_embedded_index(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(terms, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 30))) for _ in range(120)] + ["", None]
    db.executemany("insert into t(rowid, terms) values (?, ?)", [(i, t or "") for i, t in enumerate(texts)])
    queries = ['"sort list"', "foo_bar", '"the the the"', "naive omega", '"ete foo bar" sort x1', "nowhere", "the"]
    matches = ['"sort list"', '"foo_bar"', '"the the the"', '"naive" OR "omega"', '"ete foo bar" OR "sort" OR "x1"', '"nowhere"', '"the"']
    want = {(q, i): -s for q, m in enumerate(matches) for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (m,))}
    got = {(r.query_id, r.id): r.score for r in history.search(asked(spark, *queries), table(spark, texts)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    assert len(want) > 200


def test_phrases_and_tokens(spark):
    rows = asked(spark, 'say "Hello  World" again', 'open "quote only', '""', None, "a a A", "名前を foo_Bar").select(history.phrases("query").alias("p")).collect()
    assert [r.p for r in rows] == [[["hello", "world"], ["say"], ["again"]], [["quote", "only"], ["open"]], [], [], [["a"]], [["名前"], ["前を"], ["foo", "bar"]]]


def test_only_adjacent_tokens_make_a_phrase(spark):
    texts = ["red green blue", "green red blue", "red x green", "red green red green", "RED\n\tgreen"]
    got = {r.id for r in history.search(asked(spark, '"red green"'), table(spark, texts)).collect()}
    assert got == {0, 3, 4}
    assert history.search(asked(spark, '"red green"'), table(spark, texts).limit(0)).count() == 0 and history.search(asked(spark), table(spark, texts)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 20])
def test_pages_neither_skip_nor_repeat(spark, size):
    rows = [(q, r.random() < 0.5 and 1.0 or 0.5, f"p{i % 4}", i // 4) for q in (0, 1) for r in [random.Random(q)] for i in range(23)]
    found = spark.createDataFrame(rows, "query_id long, score double, path string, idx long").cache()
    seen, after = [], None
    while True:
        got = history.page(found, size, after).orderBy("query_id", "rank").collect()
        if not got:
            break
        seen += got
        last = {x.query_id: x for x in got}
        after = spark.createDataFrame([(q, x.score, x.path, x.idx) for q, x in last.items()], "query_id long, score double, path string, idx long")
        if len(seen) > 60:
            break
    for q in (0, 1):
        mine = [(x.score, x.path, x.idx) for x in seen if x.query_id == q]
        assert mine == sorted(((s, p, i) for k, s, p, i in rows if k == q), key=lambda x: (-x[0], x[1], x[2]))
    assert history.page(found, 0).count() == 0 and history.page(found, 99).filter(F.col("rank") > history.MOST).count() == 0
