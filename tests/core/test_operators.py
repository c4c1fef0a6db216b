import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import catalog, decide, extraction, learning, lifecycle, retrieval, sessions, usage
from tidewell.sources import transcripts
from tidewell.streaming import learners, rollup


def test_bm25_is_scope_local(spark):
    docs = [("a", 1, "cache"), ("a", 2, "cache filler filler filler filler")] + [("b", 10 + i, f"other words {i}") for i in range(20)]
    d = spark.createDataFrame(docs, "scope string, id long, content string")
    q = spark.createDataFrame([(0, "cache", "a")], "query_id long, query string, scope string")
    got = {r.id: r.score for r in retrieval.bm25(q, d).collect()}
    want = math.log(1 + 0.5 / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 3))
    assert got[1] == pytest.approx(want, abs=1e-6) and got[1] > got[2]


def routes(spark):
    lexical = spark.createDataFrame([(0, "s", "a", 5.0), (0, "s", "b", 3.0)], "query_id long, scope string, id string, score double")
    vector = spark.createDataFrame([(0, "s", "a", 0.9), (0, "s", "b", 0.8), (0, "s", "c", 0.7)], lexical.schema)
    return lexical, vector


def test_fusion_constants(spark):
    got = {r.id: (r.score, r.lexical) for r in retrieval.fuse_weighted(*routes(spark)).collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.744444, 0.6), "c": (0.388889, 0.0)}
    ranks = {r.id: r.score for r in retrieval.fuse_ranks(*routes(spark)).collect()}
    assert ranks["a"] == 1.0 and ranks["c"] == pytest.approx(61 / 2 / 63, abs=1e-6)


def test_usage_golden(spark):
    rows = [(1000, 300, 0, 0, 0, False, False, None), (2000, 150, 1600, 100, 2, False, False, [("approved", True, 5, 40), ("skipped", False, 1, 9)]), (600, 150, 0, 0, 0, True, True, None)]
    u = spark.createDataFrame([r[:7] + (r[7] or [],) for r in rows], "tokens_in long, tokens_out long, cache_hit_tokens long, injected_tokens long, slice_hits long, l3_reuse boolean, l3_false_hit boolean, judge array<struct<verdict:string,called:boolean,latency_ms:long,prompt_tokens:long>>")
    s = usage.summarize(u, 0.27, 0.07).first()
    assert s.cost_paid == pytest.approx(((3600 - 1600 - 600) * 0.27 + 1600 * 0.07 + 450 * 0.27) / 1e6)
    assert s.cost_no_cache == pytest.approx((3600 + 600) * 0.27 / 1e6) and s.cost_paid_strict == pytest.approx(s.cost_paid)
    assert (s.judge_decisions, s.judge_calls, s.judge_prompt_tokens, s.judge_latency_ms, s.judge_approved, s.judge_skipped, s.l3_false_hits) == (2, 1, 40, 6, 1, 1, 1)


def test_confusion_constants(spark):
    p = spark.createDataFrame([(True, True)] * 3 + [(True, False)] * 3, "said boolean, truth boolean")
    c = sessions.confusion(p).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.consistency, c.false_approve, c.precision, c.recall, c.f1) == (3, 3, 0, 0, 50.0, 50.0, 0.5, 1.0, 0.666667)


def test_evolve_batch_equals_stream_fold(spark):
    r = random.Random(1)
    rows = [(k, i, i // 2, r.choice(["hit", "hit", "pollution", "x"]), r.random() * 1.3) for k in range(5) for i in range(300)] + [(0, 301, 3, "hit", 1.0), (0, 302, 400, "hit", float("nan"))]
    got = {x.key: x for x in learning.evolve(spark.createDataFrame(rows, "key long, seq long, epoch long, name string, value double")).collect()}
    for k in range(5):
        s = learners.fold((0, 0, 0.0, 0.0, 0.55, 0, 0), [(e, n, v) for kk, _, e, n, v in rows if kk == k])
        assert (got[k].samples, got[k].hit_ewma, got[k].pollution_ewma, got[k].tau, got[k].adjustments) == (s[0], round(s[2], 6), round(s[3], 6), round(s[4], 6), s[6])


def test_streams(spark, tmp_path):
    r = random.Random(2)
    schema = "key long, seq long, epoch long, name string, value double"
    rows = [(k, i, i, r.choice(["hit", "pollution"]), r.random()) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    q = learners.evolve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("evolved").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {x.key: (x.samples, round(x.tau, 6)) for x in spark.table("evolved").collect()}
    assert got == {x.key: (x.samples, x.tau) for x in learning.evolve(df).collect()}
    events = spark.createDataFrame([(f"2024-01-{d:02d} 0{h}:00:00", "s", "m", d) for d in (1, 2, 3) for h in (1, 2)], "t string, source string, model string, total long").select(F.to_timestamp("t").alias("ts"), "source", "model", "total")
    events.write.parquet(str(tmp_path / "ev"))
    stream = learners.daily_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(x.day), x.total, x.requests) for x in spark.table("days").collect()) == [("2024-01-01", 2, 2), ("2024-01-02", 4, 2), ("2024-01-03", 6, 2)]


def test_rollup_receipts_are_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([("f", i, "2024-01-01", "s", "m", 5) for i in range(4)], "file string, offset long, day string, source string, model string, total long")
    for i, b in enumerate((batch, batch, batch.union(spark.createDataFrame([("f", 9, "2024-01-01", "s", "m", 1)], batch.schema)))):
        rollup.upsert_rollup(b, i, str(tmp_path / "receipts"), str(tmp_path / "rollup"))
    got = spark.read.parquet(str(tmp_path / "rollup")).agg(F.sum("total"), F.sum("requests")).first()
    assert tuple(got) == (21, 5)


def test_adapt_freezes_and_relaxes(spark):
    rows = [("a", i, i % 2 == 0) for i in range(100)] + [("b", i, False) for i in range(30)]
    got = {r.slice_id: r for r in learning.adapt(spark.createDataFrame(rows, "slice_id string, seq long, negative boolean")).collect()}
    assert got["a"].tau_low == pytest.approx(0.65) and not got["a"].relaxed
    assert got["b"].tau_low == pytest.approx(0.5) and got["b"].relaxed


def test_gc_order_and_archive(spark, tmp_path):
    day = 86400
    rows = [(1, "prompt", 10 * day, 0, 0, 0, 0, 0.0), (2, "result", 95 * day, 0, 0, 0, 0, 0.0), (3, "result", 50 * day, 0, 0, 0, 0, 0.0), (4, "context", 0, 0, 0, 0, 0, 0.0), (5, "memory", 60 * day, 0, 0, 0, 0, 0.0)]
    s = spark.createDataFrame(rows, "id long, type string, created long, last_used long, hits long, injected long, rejected long, feedback double")
    plan = {r.id: r.reason for r in lifecycle.gc_plan(s, 100 * day, 80, 0.0, 2).collect()}
    assert plan == {1: "expired", 3: "over_cap", 5: "over_cap"}
    left = lifecycle.collect_garbage(s, lifecycle.gc_plan(s, 100 * day, 80, 0.0, 2), str(tmp_path / "archive"))
    assert sorted(r.id for r in left.collect()) == [2, 4] and spark.read.parquet(str(tmp_path / "archive")).count() == 3


def test_journal(spark):
    ops = [("a", 1, "put", 1, 0), ("a", 2, "stat", 0, 1), ("a", 3, "put", 2, 0), ("a", 4, "stat", 0, 5), ("b", 5, "put", 1, 0), ("b", 6, "del", 0, 0), ("b", 7, "stat", 0, 1), ("c", 8, "stat", 0, 1), ("a", 9, "odd", 0, 7)]
    got = lifecycle.replay(spark.createDataFrame(ops, "id string, position long, op string, body long, hits long")).collect()
    assert [(r.id, r.body, r.hits) for r in got] == [("a", 2, 5)]
    base = spark.createDataFrame([('{"ID":"x","Type":3,"Content":"YWI="}',), ("{bad",), ('{"Type":1}',), ("",)], "value string")
    good, skipped = lifecycle.base_slices(base)
    assert [(r.ID, r.content, r.kind) for r in good.collect()] == [("x", "ab", "result")] and skipped == 2


def test_pack_skips_and_continues(spark):
    rows = [(0, "s", 1, 9.0, 5000, 1), (0, "s", 2, 8.0, 100, 2), (0, "s", 3, 7.0, 10, 3)]
    df = spark.createDataFrame(rows, "query_id long, scope string, id long, score double, bytes long, rank int")
    r = decide.pack(df, 4096).first()
    assert (r.ids, r.dropped) == ("1", 2)
    r = decide.pack(df.filter("id > 1").union(spark.createDataFrame([(0, "s", 4, 7.5, 4000, 2)], df.schema)), 4096).first()
    assert (r.ids, r.dropped) == ("2,3", 1)


def test_transcripts_and_extraction(spark, tmp_path):
    call = lambda n, a: {"id": "c", "name": n, "arguments": a}
    import json

    lines = [
        {"role": "user", "content": "Fix  it\n\n\n---\nplease\nplease"},
        {"role": "assistant", "content": "ok", "tool_calls": [call("bash", '{"command": "git status"}'), call("read", '{"path": "./a/b.py"}')]},
        {"role": "tool", "name": "bash", "content": "Error: no"},
        {"role": "assistant", "content": "", "tool_calls": [call("bash", json.dumps('{"command": "git status -s", "nested": {"file": "a/c.py"}}')), call("edit", '{"paths": ["a/b.py", "/abs"]}')]},
        {"role": "user", "content": "Fix  it\n\n\n---\nplease\nplease"},
        {"role": "assistant", "content": "done"},
    ]
    raw = "\n".join(map(json.dumps, lines[:3])) + "\n{bad\n\n" + '{"content": "no role"}\n' + "\n".join(map(json.dumps, lines[3:]))
    (tmp_path / "s1.jsonl").write_text(raw)
    (tmp_path / "skip.txt").write_text("x")
    got = transcripts.read_sessions(spark, str(tmp_path))
    assert got.count() == 6
    kinds = [r.kind for r in transcripts.documents(got).orderBy("line", "part", "kind").collect()]
    assert kinds.count("tool_input") == 4 and kinds.count("tool_error") == kinds.count("tool_output") == 1 and kinds.count("user_text") == 2
    rows = {r.kind: r for r in extraction.extract(got).collect()}
    assert rows["prompt"].content == "Fix  it\n\nplease" and rows["tool_pattern"].content == "bash read bash edit" and rows["result"].content == "done"
    entries = {(r.section, r.value, r["count"]) for r in extraction.context_entries(got).collect()}
    assert entries == {("paths", "a/b.py", 2), ("directories", "a", 3), ("commands", "git status", 2)}


def test_compaction_keeps_head_and_tail():
    long = "é" * 3000 + "END"
    out = extraction.compact(long, 100)
    assert len(out.encode()) <= 100 and out.endswith("END") and out.startswith("é") and extraction.MARKER in out
    assert extraction.compact("```\n---\n\n\nx\n```\n---\na\na", 999) == "```\n---\n\n\nx\n```\na"


def test_oracle_tsv_and_daily(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("# c\n\nx\ty\nz\tw\n")
    assert [(r.a, r.b) for r in transcripts.read_tsv(spark, str(tmp_path / "o.tsv"), ["a", "b"]).collect()] == [("x", "y"), ("z", "w")]
    (tmp_path / "p.tsv").write_text("x\n")
    with pytest.raises(Exception, match="wrong number"):
        transcripts.read_tsv(spark, str(tmp_path / "p.tsv"), ["a", "b"]).collect()
    days = spark.sql("select date'2024-01-01' + cast(id as int) day, id total from range(5)")
    transcripts.write_daily(days, str(tmp_path / "d"))
    assert transcripts.read_daily(spark, str(tmp_path / "d"), "2024-01-02", "2024-01-03").count() == 2


def test_keyset_pages_partition_the_set(spark):
    rows = spark.sql("select id, id % 7 = 0 pinned, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 5 as int)) activity from range(60)")
    seen, after = [], None
    while True:
        got = catalog.page(rows, 11, after).collect()
        if not got:
            break
        seen += [r.id for r in got]
        after = (got[-1].pinned, str(got[-1].activity), got[-1].id)
    assert sorted(seen) == list(range(60)) and len(seen) == 60
    whole = [r.id for r in rows.orderBy(F.desc("pinned"), F.desc("activity"), "id").collect()]
    assert seen == whole


def test_lineage_and_cover(spark):
    r = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent long")
    assert {(x.id, x.root, x.depth) for x in catalog.lineage(r, 5).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}
    p = spark.sql("select array(1,2,3) a, array(1,2) b, array(2) c")
    assert p.select(catalog.covers("a", "b").alias("x"), catalog.covers("a", "c").alias("y")).first() == (True, False)
