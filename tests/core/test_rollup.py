"""The incremental rollup: crashes at each step, repeated and rewritten records, and the stream that drives it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import rollup

SCHEMA = "file string, offset long, day string, source string, model string, total long"


def batches(seed):
    """Three batches with repeats, rewritten records and days that come again."""
    r = random.Random(seed)
    out, known = [], {}
    for _ in range(3):
        rows = []
        for _ in range(30):
            key = (f"f{r.randrange(3)}", r.randrange(40))
            if key in known and r.random() < 0.6:
                row = known[key]
            else:
                row = (*key, f"2024-01-0{r.randrange(1, 4)}", r.choice("ab"), "x", r.randrange(100))
            if all(x[:2] != key for x in rows) or row in rows:
                rows.append(row)
                known[key] = row
        out.append(rows)
    sums = Counter()
    for _, _, day, source, model, total in known.values():
        sums[day, source, model, "total"] += total
        sums[day, source, model, "n"] += 1
    return out, sorted((d, s, m, sums[d, s, m, "total"], sums[d, s, m, "n"]) for d, s, m, k in sums if k == "n")


def got(spark, folder):
    return sorted(tuple(r) for r in rollup.read_rollup(spark, f"{folder}/rollup").select(F.col("day").cast("string"), "source", "model", "total", "requests").collect())


def feed(spark, rows, i, folder):
    rollup.upsert_rollup(spark.createDataFrame(rows, SCHEMA), i, f"{folder}/receipts", f"{folder}/rollup")


@pytest.mark.parametrize("crash", ["before receipts", "before rollup", "after rollup"])
def test_crash_at_each_step(spark, tmp_path, monkeypatch, crash):
    rows, want = batches(5)
    for i, part in enumerate(rows):
        with monkeypatch.context() as m:
            write = rollup._overwrite

            def broken(df, path, by):
                if crash.startswith("before") and crash.split()[1] in path:
                    raise RuntimeError("lost")
                write(df, path, by)
                if crash == "after rollup" and "rollup" in path:
                    raise RuntimeError("lost")

            m.setattr(rollup, "_overwrite", broken)
            with pytest.raises(RuntimeError):
                feed(spark, part, i, str(tmp_path))
        feed(spark, part, i, str(tmp_path))
    assert got(spark, tmp_path) == want


def test_record_moves_to_another_day(spark, tmp_path):
    feed(spark, [("f", 0, "2024-01-01", "a", "x", 5)], 0, str(tmp_path))
    feed(spark, [("f", 0, "2024-01-02", "a", "x", 5), ("f", 0, "2024-01-02", "a", "x", 5)], 1, str(tmp_path))
    assert got(spark, tmp_path) == [("2024-01-02", "a", "x", 5, 1)]
    feed(spark, [("f", 0, "2024-01-01", "a", "x", 5)], 2, str(tmp_path))  # and back: again another content
    feed(spark, [("f", 0, "2024-01-01", "a", "x", 5)], 3, str(tmp_path))
    feed(spark, [], 4, str(tmp_path))
    assert got(spark, tmp_path) == [("2024-01-01", "a", "x", 5, 1)]


def test_as_a_stream(spark, tmp_path):
    rows, want = batches(8)
    for part in rows:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        take = lambda df, i: rollup.upsert_rollup(df, i, str(tmp_path / "receipts"), str(tmp_path / "rollup"))
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got(spark, tmp_path) == want
