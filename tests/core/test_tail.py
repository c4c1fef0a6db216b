"""The tail of growing logs: appends, partial lines, rewrites and truncations over restarts of one stream."""

import io
import os
import random

from pyspark.sql import functions as F

from tidewell.sources import tail
from tidewell.sources.tail import Range, changes, complete_bytes, read_range


def test_changes():
    a = {"f": [10, 12, 1], "g": [5, 5, 1], "h": [4, 4, 1]}
    b = {"f": [30, 31, 2], "g": [3, 3, 2], "h": [4, 4, 2], "i": [7, 9, 2]}
    assert changes(a, b, 16) == [
        Range("f", 10, 10, 26, False), Range("f", 10, 26, 30, False),
        Range("g", 0, 0, 0, True), Range("g", 0, 0, 3, True),
        Range("h", 0, 0, 0, True), Range("h", 0, 0, 4, True),
        Range("i", 0, 0, 7, False),
    ]
    assert changes(b, b) == [] and changes({}, {}) == []


def test_ranges_share_lines_exactly(monkeypatch):
    monkeypatch.setattr(tail, "_STEP", 7)
    r = random.Random(1)
    for _ in range(300):
        data = b"".join(b"x" * r.choice([0, 1, 3, 20]) + b"\n" for _ in range(r.randrange(12))) + b"partial" * r.randrange(2)
        end = complete_bytes(io.BytesIO(data), len(data))
        assert end == data.rfind(b"\n") + 1
        rows = [row for part in changes({}, {"f": [end, len(data), 1]}, r.randrange(1, 30)) for row in read_range(io.BytesIO(data), part)]
        assert [x[2].encode() for x in rows] == data[:end].split(b"\n")[:-1]
        assert all(data[x[1] : x[1] + len(x[2])] == x[2].encode() for x in rows)


def test_stream_over_restarts(spark, tmp_path):
    logs, out = tmp_path / "logs" / "deep", str(tmp_path / "out")
    logs.mkdir(parents=True)
    tail.register(spark)
    clock = [1_700_000_000]

    def write(name, text, mode="a"):
        with open(logs / name, mode) as f:
            f.write(text)
        clock[0] += 10
        os.utime(logs / name, (clock[0], clock[0]))

    def run():
        stream = spark.readStream.format(tail.NAME).option("path", str(tmp_path / "logs")).option("rangeBytes", "40").load()
        keep = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.path.rsplit("/")[-1], r.line) for r in tail.current(spark.read.parquet(out)).collect())

    write("a.jsonl", "one\ntwo é\nthr")
    write("b.jsonl", "".join(f"line {i}\n" for i in range(30)))
    write("c.txt", "not a log\n")
    first = run()
    assert first == sorted([("a.jsonl", "one"), ("a.jsonl", "two é"), *[("b.jsonl", f"line {i}") for i in range(30)]])
    assert run() == first  # nothing new
    write("a.jsonl", "ee\n")
    write("d.jsonl", "new\n\n")
    second = sorted([*first, ("a.jsonl", "three"), ("d.jsonl", "new"), ("d.jsonl", "")])
    assert run() == second
    write("b.jsonl", "short\n", "w")  # became shorter
    write("a.jsonl", "ONE\nTWO é\nTHREE\n", "w")  # as long as before
    third = sorted([("b.jsonl", "short"), ("a.jsonl", "ONE"), ("a.jsonl", "TWO é"), ("a.jsonl", "THREE"), ("d.jsonl", "new"), ("d.jsonl", "")])
    assert run() == third
    write("d.jsonl", "", "w")
    write("a.jsonl", "FOUR\n")
    assert run() == sorted([x for x in third if x[0] != "d.jsonl"] + [("a.jsonl", "FOUR")])
    stored = spark.read.parquet(out)
    assert stored.filter("line is not null").groupBy("path", "batch", "offset").count().filter("count > 1").count() == 0
