"""The evolution loop: rules, changes only, versions as of a request's time, and the stream against the batch."""

import random

from pyspark.sql import functions as F

from tidewell.operators import evolution
from tidewell.operators.evolution import advance, new_state

SCHEMA = "key string, seq long, kind string"


def test_engine_rests_and_is_bounded():
    state = new_state()
    moves = [i for i in range(1, 2000) if advance(state, "prefetch_waste")]
    assert moves[:3] == [60, 120, 180] and state["conf"] == 0.95 and len(moves) == 9 and state["tau"] == 0.55
    state = new_state()
    moves = [i for i in range(1, 2000) if advance(state, "inject_pollution")]
    assert moves[0] == 60 and state["tau"] == 0.8 and state["conf"] == 0.5
    state = new_state()
    assert [i for i in range(1, 400) if advance(state, "success")][:1] == [60] and state["tau"] < 0.55
    assert not advance(state, "unknown") and not advance(state, None)


def events(n=900, seed=3):
    r = random.Random(seed)
    return [(f"k{r.randrange(3)}", i, r.choice(["prefetch_hit", "prefetch_waste", "prefetch_waste", "slice_reject", "view", "other"])) for i in range(n)]


def plain(rows):
    out = []
    for key in {r[0] for r in rows}:
        state = new_state()
        for _, seq, kind in sorted(r for r in rows if r[0] == key):
            if advance(state, evolution.SIGNALS.get(kind)):
                out.append((key, seq, state["version"], state["epoch"], state["tau"], state["conf"]))
    return sorted(out)


def test_batch_and_as_of(spark):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changes = evolution.ticks(df)
    found = sorted(tuple(r) for r in changes.collect())
    assert found == plain(rows) and len(found) > 6
    asked = df.filter("kind = 'view'").withColumn("extra", F.lit("x"))
    for r in evolution.as_of(asked, changes).collect():
        before = [c for c in found if c[0] == r.key and c[1] < r.seq]
        assert (r.version, r.tau, r.conf) == ((before[-1][2], before[-1][4], before[-1][5]) if before else (0, 0.55, 0.5)) and r.extra == "x"
    assert evolution.ticks(df.limit(0)).count() == 0 and evolution.as_of(asked, changes.limit(0)).filter("version = 0").count() == asked.count()


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = events(600, 9)
        for a in (0, 250, 400):
            b = {0: 250, 250: 400, 400: 600}[a]
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = evolution.ticks_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
            stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == plain(rows)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
