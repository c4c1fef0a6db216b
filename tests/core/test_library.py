"""Outcomes, recall blocks, promotions, merges, scans and rate cards on small rows, against folds in plain Python."""

import random

from pyspark.sql import functions as F

from tidewell.functions import records
from tidewell.operators import library, outcomes, retrieval, usage

RECEIPT = "session int, round_no int, seq int, tool string, args string, ok boolean, changes boolean, command string, bookkeeping boolean, reads boolean, output_bytes int, paths array<string>, verify boolean, exercises boolean, review boolean"


def receipts(n=400, seed=5):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        command = r.choice(["", "", "", " a", "b ", "test", None])
        name = (command or "").strip()
        rows.append((seq % 3, seq // 12, seq, r.choice(["read", "task", "grep"]), r.choice("xyz"), r.choice([True, True, False, None]), r.random() < 0.04, command, r.random() < 0.1, r.random() < 0.5,
                     r.choice([0, 9]), [r.choice(["", "p", "q", "r", "s"]) for _ in range(r.randrange(3))], name == "test", name == "b" and r.random() < 0.1, r.random() < 0.1))
    return rows


def folded(rows):
    """Gains, outcomes and debts of each round by one pass over each session."""
    out = {}
    for session in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == session]
        paths, asks, last, verified, worked, failed = set(), set(), {}, {}, set(), set()
        run = debt_age = blind = 0
        debt = False
        for number in sorted({row[1] for row in mine}):
            gain = explored = churn = discriminating = 0
            acted = False
            for _, _, _, tool, args, ok, changes, command, book, reads, size, found, verify, exercises, _ in (row for row in mine if row[1] == number):
                command, ok = (command or "").strip(), bool(ok)
                acted |= changes or command != ""
                if command:
                    gain += (0 if last.get(command) is False else 1) if not ok else 3 if last.get(command) is False else 0 if command in last else 2
                    last[command] = ok
                    churn += ok and changes
                    discriminating += verify or exercises
                    if ok:
                        explored += not verify and command not in worked
                        worked.add(command)
                    else:
                        explored += command not in failed
                        failed.add(command)
                elif not ok:
                    pass
                elif changes:
                    gain, churn = gain + 3, churn + 1
                elif tool == "task":
                    gain, explored = gain + 2, explored + 1
                elif book:
                    gain += 1
                else:
                    new = 0
                    if reads and size > 0 and found:
                        new = len({p for p in found if p} - paths)
                        paths |= set(found)
                    first = (tool, args) not in asks
                    asks.add((tool, args))
                    gain, explored = gain + (new or first), explored + (new or first)
            run = 0 if acted else run + 1
            if discriminating:
                debt, debt_age, blind = False, 0, 0
            else:
                debt, blind = debt or churn > 0, blind + churn
                debt_age += debt
            out[session, number] = (0 if run > 6 else gain, run, explored, churn, discriminating, debt_age, blind)
    return out


def test_rounds_against_a_fold(spark):
    rows = receipts()
    df = spark.createDataFrame(rows, RECEIPT)
    joined = outcomes.round_gains(df).join(outcomes.outcomes(df), ["session", "round_no"])
    got = {(r.session, r.round_no): (r.gain, r.looking, r.exploration, r.churn, r.discriminating, r.debt_age, r.blind) for r in joined.collect()}
    assert got == folded(rows)


def test_only_looking_stops_counting(spark):
    rows = [(0, n, n, "read", str(n), True, False, "", False, True, 9, [f"p{n}"], False, False, False) for n in range(9)]
    gains = outcomes.round_gains(spark.createDataFrame(rows, RECEIPT)).orderBy("round_no").collect()
    assert [g.gain for g in gains] == [1] * 6 + [0] * 3


def test_criteria(spark):
    wanted = spark.createDataFrame([(1, "a", True, ["f", "f", "g"]), (1, "b", True, ["g"]), (1, "c", False, []), (1, "d", True, None)], "task int, criterion string, required boolean, references array<string>")
    findings = spark.createDataFrame([(1, "f", True), (1, "f", True), (1, "g", False)], "task int, finding string, accepted boolean")
    assert {(r.criterion, r.evidence, r.status) for r in outcomes.criteria(wanted, findings).collect()} == {("a", 2, "satisfied"), ("b", 0, "open"), ("c", 0, "satisfied"), ("d", 0, "open")}


def block(hits, budget, frame, note):
    ids, used, omitted = [], frame, 0
    for _, number, head, snippet in hits:
        left, size = budget - used, len(snippet or "")
        length = len(head) + size
        if length > left:
            length = None
            while size > 0:
                if len(head) + size + 3 <= left:
                    length = len(head) + size + 3
                    break
                size -= max(size // 4, 1)
        if length is None:
            omitted += 1
        else:
            ids, used = ids + [number], used + length
    if not ids:
        return ids, 0, omitted
    return ids, used + (note if omitted and used + note <= budget else 0), omitted


def test_recall_blocks_against_a_loop(spark):
    r = random.Random(3)
    hits = {q: [(i, i * 7 % 10, "h" * r.randrange(5, 60), None if r.random() < 0.1 else "s" * r.choice([0, 1, 9, 200, 5000])) for i in range(6)] for q in range(40)}
    df = spark.createDataFrame([(q, *h) for q, rows in hits.items() for h in rows], "query_id int, rank int, id int, head string, snippet string")
    for budget in (90, 300, 1200):
        got = {row.query_id: (row.ids, row.used, row.omitted) for row in library.recall_blocks(df, budget, 50, 30).collect()}
        assert got == {q: block(rows, budget, 50, 30) for q, rows in hits.items()}


def test_adaptation(spark):
    rows = [(0.0, True), (0.5, True), (0.4, False), (0.7, True), (0.6, False)]
    r = library.adaptation(spark.createDataFrame(rows, "tau_low double, relaxed boolean")).first()
    assert (r.entries, r.learned, r.relaxed, r.least, r.median, r.most) == (5, 4, 2, 0.4, 0.6, 0.7)
    none = library.adaptation(spark.createDataFrame([], "tau_low double, relaxed boolean")).first()
    assert (none.entries, none.learned, none.median) == (0, 0, None)


def test_symbols(spark):
    schema = "scope int, seq int, name string"
    primary = spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], schema)
    fallback = spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (1, 5, "b"), (2, 6, "c"), (2, 7, "c")], schema)
    rows = library.merged_symbols(primary, fallback, ("name",)).collect()
    assert sorted((r.seq, r.primary) for r in rows) == [(1, True), (2, True), (4, False), (6, False), (7, False)]


def test_scans(spark):
    known = spark.createDataFrame([("a", 0), ("b", 0), ("c", 80), ("d", 95)], "path string, missing_since long")
    listing = spark.createDataFrame([("a",), ("a",), ("d",)], "path string")
    rows = {r.path: (r.missing_since, r.health, r.gone) for r in library.scanned(known, listing, 100, 10).collect()}
    assert rows == {"a": (0, "ok", False), "b": (100, "missing", False), "c": (80, "missing", True), "d": (0, "ok", False)}


def test_promotions_and_sources(spark):
    entries = spark.createDataFrame([("s", "v", None, 2, 1), ("s", "v", None, 1, 2), ("s", "v", "q", 3, 3)], "slice_id string, version string, query string, promoted_at int, seq int")
    assert {r.seq for r in library.promotions(entries).collect()} == {2, 3}
    hits = spark.createDataFrame([(1, i, s) for i, s in enumerate(["b", " a ", " ", "a", "b", "c", "d", None])], "query_id int, rank int, session string")
    assert [(r.place, r.session, r.hits) for r in library.top_sources(hits).orderBy("place").collect()] == [(1, "b", 2), (2, "a", 2), (3, "c", 1)]


def test_results_attach_once(spark):
    calls = spark.createDataFrame([(1, 1, "x", "t"), (1, 2, "x", "t"), (1, 3, None, "t")], "session int, seq int, call_id string, name string")
    results = spark.createDataFrame([(1, "x", 5, "old"), (1, "x", 6, None), (1, "y", 7, "z")], "session int, call_id string, seq int, content string")
    assert [(r.seq, r.result, r.attached) for r in library.attached(calls, results).orderBy("seq").collect()] == [(1, None, True), (2, None, False), (3, None, False)]


def test_significant_digits(spark):
    r = random.Random(1)
    values = [0.0, 0.27, 1.0, 10.0, 100.0, -2.5, 1e-7, 1e-5, 1.5e-4, 123456789012.0, 1e12, 0.1 + 0.2, 1e300] + [r.uniform(-1, 1) * 10 ** r.randrange(-9, 15) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", records.significant(F.col("v")).alias("s")).collect()
    assert all(x.s == f"{x.v:.12g}" for x in got)


def test_valuations(spark):
    names = "provider string, model string, currency string, mode string, rate_hit double, rate_in double, rate_out double"
    catalog = spark.createDataFrame([("p", "m", "USD", "payg", 1.0, 2.0, 3.0), ("p", "m", "USD", "batch", 1.0, 2.0, 3.0), ("p", "m", "CNY", "payg", 7.0, 14.0, 21.0), ("p", "m", "CNY", "batch", 1.0, 1.0, 1.0)], names)
    quotes = spark.createDataFrame([(1, "P ", "m", "$", 10, 20, 30, 1.0, 2.0, 3.0), (2, "p", "m", "usd", 10, 20, 30, 9.0, 2.0, 3.0), (3, "p", "m", "rmb", 1, 1, 1, 7.0, 14.0, 21.0)], "id int, provider string, model string, currency string, hit int, miss int, output int, rate_hit double, rate_in double, rate_out double")
    rows = {r.id: (r.official, None if r.valuation is None else float(r.valuation)) for r in usage.valuations(quotes, catalog, "CNY").collect()}
    assert rows == {1: (True, 0.00098), 2: (False, None), 3: (True, None)}


def test_version_and_phrase_win(spark):
    sections = spark.createDataFrame([(1, "cache notes", "cache", "en", None), (2, "nothing here", "x", "en", "1.2.3"), (3, "the cache of v1.2.3 is small", "y", "de", None)], "id int, content string, heading string, locale string, version string")
    queries = spark.createDataFrame([(1, "cache of v1.2.3"), (2, "cache notes")], "query_id int, query string")
    rows = retrieval.docs_search(queries, sections, "en").orderBy("query_id", "rank").collect()
    assert [r.id for r in rows if r.query_id == 1] == [2]
    assert rows[0].score == 115.0
    assert next(r.id for r in rows if r.query_id == 2) == 1


def test_searches_beyond_the_broadcast_bound(spark, monkeypatch):
    r = random.Random(2)
    vectors = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)], "id int, vector array<double>")
    asked = vectors.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    docs = spark.createDataFrame([("s", i, " ".join(r.choices("abcdefgh", k=6))) for i in range(30)], "scope string, id int, content string")
    queries = spark.createDataFrame([(i, " ".join(r.choices("abcdefgh", k=3))) for i in range(5)], "query_id int, query string")
    near = [sorted(map(tuple, retrieval.vector_search(asked, vectors, 3).collect())), sorted(map(tuple, retrieval.hashed_search(queries, docs).collect()))]
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 100)
    far = [sorted(map(tuple, retrieval.vector_search(asked, vectors, 3).collect())), sorted(map(tuple, retrieval.hashed_search(queries, docs).collect()))]
    assert near == far and near[0] and near[1]
