"""Fill-in-the-middle against a plain version of the same rules."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from fixtures import documents
from tidewell.llm import infill


def plain(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(spark, rows, **options):
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = infill.fill_in_middle(df, **options)
    out = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restore(F.col("output"), F.col("form")).alias("back"), "text").collect()
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted((plain(i, t, *options.values()) for i, t in rows), key=repr)
    assert all(r.back == (r.text or "") for r in out)
    return out


def test_matches_plain_version(spark):
    r = random.Random(5)
    pieces = ["a\n", "\n", "word ", "é𝒳\r\n", "\x00\x0b", "<", "P>", "<S", "<M", ">", "end", " x\n", "S>"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(14)))) for i in range(300)]
    out = check(spark, rows)
    assert {x.form for x in out} == {"plain", "psm", "spm"}


def test_edges_and_rates(spark):
    rows = [(1, None), (None, None), (2, ""), (None, "a\nb\nc"), (3, "has <S> in it\nx"), (4, "\n"), (5, "x"), (5, "x"), (5, "y\nz"), (-6, "no newline at the end\nz" * 3)]
    check(spark, rows)
    assert {x.form for x in check(spark, [(i, "a\nb\nc\nd") for i in range(80)], rate=40, spm_rate=0)} == {"plain", "psm"}
    assert infill.fill_in_middle(documents(spark, [])).count() == 0
    got = infill.fill_in_middle(documents(spark, ["a\nb"]).withColumnRenamed("lang", "output").withColumnRenamed("source", "n"))
    assert got.columns == ["doc_id", "text", "n_chars", "kept", "shard", "secret_spans", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_very_long_texts(spark):
    check(spark, [(i, "ab cd é\n" * 60_000 + "tail" * 100_000) for i in range(4)])
    assert infill.unit_ends("x" * 3_000_000 + "\n\ny") == [3_000_001, 3_000_002, 3_000_003]
