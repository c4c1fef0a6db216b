"""Lenient logs: every kind of line, limits, exports with counts; telemetry buckets."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import records
from tidewell.operators import usage
from tidewell.sources import logs

LINES = ['{"id": "a", "n": 1, "more": [1]}', "", "   ", None, '{"id": "b", "n"', '{"n": 2}', '{"id": "", "n": 3}', "7", "[]", "null", '{"id": "c", "n": "no number"}', '{"id": "d"}', '{"id": "' + "x" * 200 + '"}']
WANT = ["ok", "blank", "blank", "blank", "corrupt", "no_key", "no_key", "corrupt", "corrupt", "corrupt", "corrupt", "ok", "long"]


def test_status_of_each_line(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(LINES)), "at int, value string")
    scanned = logs.scan(df, "id string, n bigint", "id", most=100)
    assert [r.status for r in scanned.orderBy("at").collect()] == WANT
    assert sorted(tuple(r) for r in logs.records(scanned).collect()) == [("a", 1), ("d", None)]
    counts = logs.export(scanned, str(tmp_path / "out"))
    assert counts == {"ok": 2, "long": 1, "corrupt": 5, "no_key": 2}
    back = logs.read_log(spark, str(tmp_path / "out"), "id string, n bigint", "id")
    assert sorted(tuple(r) for r in logs.records(back).collect()) == [("a", 1), ("d", None)] and back.filter("status <> 'ok'").count() == 0
    assert logs.scan(df.limit(0), "id string", "id").count() == 0 and logs.scan(df, "id string").filter("status = 'no_key'").count() == 0


@pytest.mark.parametrize("ms, want", [(0, "lt_1s"), (999, "lt_1s"), (1000, "s_1_5"), (14_999, "s_5_15"), (60_000, "m_1_5"), (900_000, "m_15_plus")])
def test_latency(spark, ms, want):
    assert spark.range(1).select(records.latency_bucket(F.lit(ms)).alias("x")).first().x == want


def test_counters_and_names(spark):
    rows = [("a", "x", 900_000), ("a", "x", 900_000), ("a", "y", -3), ("a", "y", 2), ("", "x", 1), (None, "x", 1), ("b", "", 1), ("b", None, 1), ("b", "z", 0)]
    got = usage.counters(spark.createDataFrame(rows, "signal string, bucket string, count long")).collect()
    assert sorted(map(tuple, got)) == [("a", "x", 1_000_000), ("a", "y", 2)]
    names = [spark.range(1).select(records.safe_bucket(F.lit(v), "none").alias("x")).first().x for v in (" A--b ", "__", None, "x" * 99)]
    assert names == ["a_b", "none", "none", "x" * 96]
    assert [spark.range(1).select(records.exit_bucket(F.lit(a), F.lit(b), F.lit(c).cast("string")).alias("x")).first().x for a, b, c in ((True, True, "e"), (None, True, "e"), (None, None, "e"), (False, False, None))] == ["cancelled", "recovery_paused", "error", "success"]
