"""The online prefetcher: rules step by step, and the stream against the ordered fold over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import prefetch
from tidewell.operators.prefetch import Settings, advance, new_state, plan

SCHEMA = "session string, seq long, name string, read_only boolean"


def walk(state, names, s=Settings(), writers=(), draw=1.0):
    return [advance(state, n, n not in writers, draw, s) for n in names]


def test_plans_follow_counts_and_skip_writers():
    state = new_state()
    out = walk(state, ["read", "grep", "read", "grep", "read", "write", "read"], writers=("write",))
    assert out[0][0] == [] and out[1][0] == [] and out[2][0] == ["grep"] and out[2][1] == ["likely"]
    assert state["counts"] == {"read": {"grep": 2, "write": 1}, "grep": {"read": 2}, "write": {"read": 1}}
    assert "write" not in state["read_only"] and out[-1][0] == ["grep"]
    assert out[3][2:] == (True, True, 1, 0) and out[5][2:] == (False, False, 0, 1)


def test_ties_by_name_and_cost():
    state = new_state() | {"counts": {"a": {"x": 1, "b": 1, "c": 1, "d": 1}}, "read_only": dict.fromkeys("xbcd", True)}
    assert [t for t, _ in plan(state, "a", 1.0, Settings(min_conf=0.1))] == ["b", "c", "d"]
    assert [t for t, _ in plan(state, "a", 1.0, Settings(min_conf=0.1, max_cost=1100))] == ["b", "c"]
    assert plan(state, "a", 1.0, Settings(min_conf=0.1, max_cost=100)) == [] and plan(state, "nothing", 0.0, Settings()) == []


def test_probe_only_where_all_are_below_the_threshold():
    state = new_state() | {"counts": {"a": {"b": 2, "c": 2, "d": 1}}, "read_only": dict.fromkeys("bcd", True)}
    s = Settings(epsilon=0.3)
    assert plan(state, "a", 0.29, s) == [("b", "probe")] and plan(state, "a", 0.3, s) == [] and plan(state, "a", 0.0, Settings()) == []


def test_demotion_and_rotating_probation():
    s = Settings(probation_interval=2)
    state = new_state() | {"counts": {"a": {"b": 3, "c": 2, "d": 1, "e": 6}}, "read_only": dict.fromkeys("bcde", True), "hits": {}, "waste": {"b": 3.0, "c": 3.0, "d": 2.0}}
    seen = [plan(state, "a", 1.0, s) for _ in range(6)]
    assert [p[-1] for p in seen] == [("e", "likely"), ("b", "probation"), ("e", "likely"), ("c", "probation"), ("e", "likely"), ("b", "probation")]
    assert not prefetch._demoted(state, "d", s) and prefetch._demoted(state, "b", s)  # (0+1)/(2+2) is the limit itself
    state["plans"] = {}
    assert all(p[-1][1] == "likely" for p in (plan(state, "a", 1.0, Settings(probation_interval=-1)) for _ in range(20)))
    single = Settings(top_k=1, probation_interval=1)
    assert plan(state, "a", 1.0, single) == [("b", "probation")] or plan(state, "a", 1.0, single)[0][1] == "probation"


def test_feedback_weights_decay():
    state = new_state() | {"proposed": ["x"], "last": "a"}
    walk(state, ["x"])
    state["proposed"] = ["x"]
    walk(state, ["y"])
    assert state["hits"]["x"] == 0.8 and state["waste"]["x"] == 1.0


def steps(seed, n=400):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.05 else f"s{r.randrange(5)}", i // 2, r.choice(["read", "grep", "ls", "write", "run"]), None) for i in range(n)]
    rows += [("s0", n + i, None if i == 3 else "read", None) for i in range(5)]
    return [(s, q, t, t != "write" if t else None) for s, q, t, _ in rows]


def plain(rows, s):
    out = []
    for session in {r[0] for r in rows}:
        state = new_state()
        for key, seq, name, ro, d in sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[2] or "")):
            out.append((key, seq, name, *map(lambda x: tuple(x) if isinstance(x, list) else x, advance(state, name, ro, d, s))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


S = Settings(min_conf=0.3, epsilon=0.5, probation_interval=3)


@pytest.mark.parametrize("partitions", [1, 7])
def test_batch_is_the_fold_for_any_layout(spark, partitions):
    df = spark.createDataFrame(steps(1), SCHEMA).repartition(partitions)
    rows = [tuple(r) for r in df.select("*", prefetch.draw("session", "seq").alias("d")).collect()]
    found = prefetch.online_plans(df, S)
    assert got(found) == plain(rows, S)
    assert {c for r in found.collect() for c in r.channels} == {"likely", "probation", "probe"}
    assert prefetch.online_plans(df.limit(0), S).count() == 0
    total = prefetch.summary(found).agg(F.sum("calls"), F.sum("hits")).first()
    assert total[0] == sum(r.read_only_call for r in found.collect()) and total[1] == sum(r.hits for r in found.collect())


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    """Three runs of one checkpoint, each with new files: state carries on where it stood."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        rows = [r for r in steps(2, 240) if r[2]]
        # Names in order within equal seqs, and a seq never across two runs.
        rows.sort(key=lambda r: (r[1], r[2]))
        cuts = [0, 80, 160, len(rows)]
        cuts = [next((i for i in range(c, len(rows)) if rows[i][1] != rows[i - 1][1]), len(rows)) if 0 < c < len(rows) else c for c in cuts]
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = prefetch.online_plans_stream(stream, S).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
            query.awaitTermination()
        assert got(spark.read.parquet(str(tmp_path / "out"))) == got(prefetch.online_plans(spark.createDataFrame(rows, SCHEMA), S))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
