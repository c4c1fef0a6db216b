import random

from pyspark.sql import functions as F

from fixtures import documents
from test_langid import speak
from tidewell.llm import langid


def test_texts_in_no_modelled_language_are_rejected(spark):
    langs = ["aa", "bb"] * 40
    r = random.Random(3)
    other = [
        "η γρήγορη αλεπού πηδάει πάνω από το σκυλί " * 10,
        " ".join("%032x" % r.getrandbits(128) for _ in range(30)),
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)),
        "これは日本語の文章であり、どの言語のモデルにも当てはまりません。" * 4,
        speak("cc", 1, 60),  # declared by too few documents for a model
    ]
    texts = [speak(x, i) for i, x in enumerate(langs)] + other
    docs = documents(spark, texts, langs + ["aa", "aa", None, "bb", "cc"], ["aa.host.example"] * len(texts))
    got = {x.doc_id: x for x in langid.identify(docs, F.col("lang"), F.col("source")).collect()}
    assert [got[i].language for i in range(80)] == langs
    assert [(got[i].language, got[i].kept, got[i].confidence) for i in range(80, 85)] == [("und", False, 0.0)] * 5


def test_every_language_gets_a_model(spark, monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    r = random.Random(4)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghi"]  # 72
    syllables = {x: [r.choice("bcdfghklmnprst") + r.choice("aeiou") + r.choice("bcdfghklmnprst") for _ in range(4)] for x in names}
    langs = names * 6
    texts = [" ".join("".join(r.choice(syllables[x]) for _ in range(2)) for _ in range(60)) for x in langs]
    rows = documents(spark, texts, langs).select("doc_id", "text", F.col("lang").alias("declared"))
    languages, table = langid.fit_texts(rows)
    assert languages == names and table.shape == (72, 1 << 16)
    scored = langid._text_evidence(langid.evidence_columns(documents(spark, texts, langs), F.col("lang"), None), languages, table)
    assert all(languages[max(range(72), key=lambda i: x.loglik[i])] == langs[x.doc_id] and max(x.loglik) > x.other for x in scored.collect())
