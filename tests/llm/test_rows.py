"""The filtering stages judge rows, not ids: null and repeated ids neither lose clean texts nor keep copies."""

from collections import Counter

from pyspark.sql import functions as F

from fixtures import documents, prose
from test_langid import speak
from tidewell.llm import decontam, jaccard, langid


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_clean_rows_stay_beside_contaminated_ones(spark, monkeypatch):
    item, clean = prose(1, 40, 10**6), [prose(i, 60) for i in range(2, 6)]
    items = spark.createDataFrame([(0, item), (1, prose(99, 40, 10**6))], "item_id long, text string")
    docs = documents(spark, [item, clean[0], clean[1], "x " + item, clean[2], clean[3], None], ids=[None, None, None, 7, 7, 8, None])
    want = Counter([(None, clean[0]), (None, clean[1]), (7, clean[2]), (8, clean[3]), (None, None)])
    assert rows(decontam.remove_contaminated(docs, items)) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    left = decontam.remove_contaminated(docs, items)
    assert rows(left) == want and left.schema == docs.schema


def test_one_row_of_each_component_stays(spark):
    t, u, v, w = (prose(i, 60) for i in range(1, 5))
    texts = [t, t + " x", u, u, u, v, v + " y", v, w, None, "", " \t"]
    ids = [5, 3, 5, 5, 9, None, None, None, 3, None, 4, 4]
    got = rows(jaccard.keep_one(documents(spark, texts, ids=ids)))
    near = [k for k in got if k[0] is None and k[1]]
    assert len(near) == 1 and near[0][1] in (v, v + " y")
    assert got == Counter([(3, t + " x"), (5, u), near[0], (3, w), (None, None), (4, ""), (4, " \t")])
    assert jaccard.keep_one(documents(spark, texts, ids=ids)).columns == documents(spark, []).columns


def test_rows_without_language_go(spark):
    langs = ["aa", "bb"] * 20
    texts = [speak(x, i) for i, x in enumerate(langs)] + ["123 !!", None]
    docs = documents(spark, texts, langs + ["aa", "bb"], ids=[None] * 20 + [7] * 20 + [None, 7])
    assert rows(langid.keep_identified(docs, F.col("lang"), F.col("source"))) == Counter(zip([None] * 20 + [7] * 20, texts[:40]))
