import re

import pytest

from fixtures import documents, prose
from test_jaccard import brute
from test_langid import speak
from test_secretscan import brute as spans_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tidewell.llm import bpe, queries

    texts = [speak("aa", i, 60) for i in range(40)] + [speak("bb", i, 60) for i in range(40)]
    item = prose(5, 30, 10**6)
    texts += [texts[0] + " end", texts[41], texts[3] + "\n" + item, "token=abcdefgh " + speak("aa", 900, 30), "?? 12", None, ""]
    langs = ["aa"] * 40 + ["bb"] * 40 + ["aa", "bb", "aa", "aa", "aa", "aa", "bb"]
    docs = documents(spark, texts, langs).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [i for i, t in enumerate(texts) if t and re.search("[a-z]", t)]
    left = [i for i, _, c in brute(left, [texts[i] for i in left]) if i == c]
    left = [i for i in left if item not in texts[i]]
    assert sorted(got) == sorted(left) and len(left) == 81
    for i in left:
        text = texts[i]
        for span in reversed([s for s in spans_of(text).split(",") if s]):
            _, a, b = span.split(":")
            text = text[: int(a)] + "<secret>" + text[int(b) :]
        assert got[i].ids == bpe.tokenizer(queries.default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
