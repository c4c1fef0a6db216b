"""Line dedup against a plain version over awkward texts, hot lines and keys included."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures import documents
from tidewell.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(n_lines, n_dropped, kept text) per row; a null id is smaller than all others."""
    rank = lambda i: (-1, 0) if i is None else (0, i)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= 20:
                holders[key].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(x.strip(SPACE).translate(LOWER), ())) >= 3 and max(h) != rank(i) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = linededup.dedup_lines(df, keep_text=True, **options)
    kept = got.select("doc_id", "n_lines", "n_dropped", linededup.apply_runs(F.col("text"), F.col("keep_runs")).alias("kept_text"))
    return sorted((tuple(r) for r in kept.collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    pool = [f"Common line number {k} of the pool" for k in range(12)] + ["short", "", "exactly twenty chars", "nineteen characters", "ÄÖ ünïcode line with ÉÈ letters", "  padded COMMON line number 3 of the pool\t"]
    return [(r.randrange(10**6), "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line {r.random()} of a document" for _ in range(r.randrange(12)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_plain_version(spark, seed):
    rows = corpus(seed, 120) + [(None, None), (None, "Common line number 1 of the pool"), (7, ""), (7, "\n"), (8, "\n\nCommon line number 2 of the pool\n\n")]
    assert found(spark, rows) == plain(rows)


def test_hot_lines_keys_and_repeats(spark, monkeypatch):
    """One line in all documents, one row repeated often, one id in a third of the rows; all through the hot path as well."""
    rows = [(i, f"a line that everyone has got\nline of number {i} in the table\nA LINE that everyone has got ") for i in range(150)]
    rows += [(5, "a line that everyone has got\nthe same row again and again")] * 60 + [(None, f"a line that everyone has got\nnull {i % 3} has this one here") for i in range(60)]
    want = plain(rows)
    assert found(spark, rows) == want
    monkeypatch.setattr(linededup, "HOT_PER_PARTITION", 10**6)  # any line is hot, as far as the sketch reaches
    assert found(spark, rows) == want
    keeper = [r for r in want if r[0] == 149][0]
    assert keeper[2] == 0 and all(r[2] > 0 for r in want if r[0] is not None and r[0] < 149 and r[0] != 5)


def test_least_documents_and_ties(spark):
    rows = [(1, "twice in two documents only"), (2, "twice in two documents only"), (3, "x" * 20 + "\n" + "x" * 20), (4, "X" * 20), (4, "x" * 20), (9, " " + "x" * 20)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert [r[2] for r in got] == [0, 0, 2, 1, 1, 0]


def test_long_text_bitmaps_and_empty_table(spark):
    long = "\n".join(f"line {i % 5000} of a very long document" for i in range(200_000))
    rows = [(1, long), (2, long), (3, "line 17 of a very long document"), (4, "one\n" * 50_000)]
    assert found(spark, rows) == plain(rows)
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = linededup.dedup_lines(df)
    assert "text" not in got.columns and {"lang", "source", "kept", "shard"} <= set(got.columns)
    runs = {r.doc_id: r.keep_runs for r in got.collect()}
    assert runs[3] == [1] and runs[4] == [50_001] and sum(runs[1]) == 200_000 and len(runs[1]) == 81
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_run_lengths(spark):
    r = random.Random(3)
    cases = [(n, sorted(r.sample(range(n), r.randrange(n + 1)))) for n in range(1, 60)]
    df = spark.createDataFrame(cases, "n int, p array<int>")
    for n, p, runs in df.select("n", "p", linededup.run_lengths(F.col("p"), F.col("n"))).collect():
        flags = [k % 2 == 1 for k, length in enumerate(runs) for _ in range(length)]
        assert [i for i, f in enumerate(flags) if f] == p and len(flags) == n


def test_plan_has_one_range_exchange_and_no_python(spark):
    got = linededup.dedup_lines(documents(spark, ["a", "b"]))
    plan = got._jdf.queryExecution().toString()
    assert plan.count("rangepartitioning") >= 1 and "Python" not in plan and "Arrow" not in plan
