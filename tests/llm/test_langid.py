import random

from pyspark.sql import functions as F

from fixtures import documents
from tidewell.llm import langid

VOWELS = {"aa": ("bdg", "aou"), "bb": ("ptk", "eiy"), "cc": ("mnl", "äöü")}


def speak(lang, seed, n=30):
    r = random.Random(seed)
    c, v = VOWELS[lang]
    return " ".join("".join(r.choice(c) + r.choice(v) for _ in range(r.randrange(1, 5))) for _ in range(n))


def test_text_declaration_and_host(spark):
    langs = ["aa", "bb", "cc"] * 60
    texts = [speak(x, i) for i, x in enumerate(langs)]
    sources = [f"http://{x}.host.example/{x}/1" for x in langs]
    declared = [None if i % 7 == 0 else x for i, x in enumerate(langs)]
    declared[30] = "bb"  # wrong declaration of a text in aa: the text decides
    n = len(texts)
    # A text of two letters that all have: the host decides; without any letters: not identified.
    texts += ["x", "x", "... 123 !!", None, ""]
    declared += [None, None, "aa", "aa", "aa"]
    sources += ["http://aa.host.example/p", "http://bb.host.example/p", "http://aa.host.example/p", None, ""]
    got = {r.doc_id: r for r in langid.identify(documents(spark, texts, declared, sources), F.col("lang"), F.col("source")).collect()}
    assert [got[i].language for i in range(n)] == langs
    assert (got[n].language, got[n + 1].language) == ("aa", "bb")
    assert [(got[i].language, got[i].kept, got[i].confidence) for i in range(n + 2, n + 5)] == [("und", False, 0.0)] * 3
    kept = langid.keep_identified(documents(spark, texts, declared, sources), F.col("lang"), F.col("source"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(n + 2)) and kept.columns == documents(spark, []).columns


def test_markup_and_suffix(spark):
    docs = documents(spark, ['<html lang="de-AT"><body>x', " <HTML class=a LANG=fr>", "<p>", "text"], ["en", None, "es", " PT-br "], ["https://a.b.co.uk/x", "http://x.fr/de/page", "x.org", None])
    got = {r.doc_id: r for r in langid.evidence_columns(docs, F.col("lang"), F.col("source")).collect()}
    assert [got[i].declared for i in range(4)] == ["de", "fr", "es", "pt"]
    assert [(got[i].suffix, got[i].host, got[i].domain) for i in range(4)] == [("uk", "a.b.co.uk", "uk.co"), ("de", "x.fr", "fr.x"), ("org", "x.org", "org.x"), (None, None, None)]


def test_empty_undeclared_and_repeated(spark):
    assert langid.identify(documents(spark, []), F.col("lang"), F.col("source")).count() == 0
    assert [r.kept for r in langid.identify(documents(spark, ["abc", "abc"]), None, None).collect()] == [False, False]
    texts = [speak("aa", 1)] * 30 + [speak("bb", i) for i in range(30)]
    rows = langid.identify(documents(spark, texts, ["aa"] * 30 + ["bb"] * 30, ids=[7] * 30 + [None] * 30), F.col("lang")).collect()
    assert sorted(r.language for r in rows) == ["aa"] * 30 + ["bb"] * 30
