"""The rollup over growing and late events, after crashes and from its command line."""

import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest

from jobs import usage_rollup

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, day, user=1, kind="view", k=None):
    return (i, datetime(2024, 1, day, 12), user, kind, 1.0, '{"k": %d}' % (i if k is None else k))


FIRST = [event(i, 1 + i % 3, user=i % 4) for i in range(30)]
LATE = [event(30, 2, user=5, kind="signup"), event(31, 9), event(31, 9), (None, datetime(2024, 1, 1), 1, "view", 1.0, "{}"), (33, None, 1, "view", 1.0, "{}"), (32, datetime(2024, 1, 9, 23, 59), 10, "view", 1.0, None)]


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def run(spark, folder, **options):
    return usage_rollup.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark", **options)


def out(spark, folder):
    return sorted((tuple(r) for r in usage_rollup.read_output(spark, f"{folder}/out").collect()), key=repr)


def test_growing_and_late_events(spark, tmp_path):
    folder, whole = str(tmp_path / "a"), str(tmp_path / "b")
    put(spark, FIRST, f"{folder}/in")
    one = run(spark, folder)
    assert (one["new_events"], one["days"], one["mark"], one["events"]) == (30, 3, 29, 30)
    before = out(spark, folder)
    assert run(spark, folder)["new_events"] == 0 and out(spark, folder) == before
    put(spark, LATE, f"{folder}/in")
    two = run(spark, folder)
    assert (two["mark_before"], two["new_events"], two["days"], two["mark"], two["events"]) == (29, 4, 2, 32, 14)
    put(spark, FIRST + LATE, f"{whole}/in")
    run(spark, whole)
    assert out(spark, folder) == out(spark, whole)
    totals = spark.read.parquet(f"{folder}/out").selectExpr("sum(total)", "sum(requests)", "sum(turns)").first()
    assert tuple(totals) == (3 * (sum(range(30)) + 31), 32, 1)


@pytest.mark.parametrize("full", [False, True])
def test_crash_between_output_and_mark(spark, tmp_path, monkeypatch, full):
    folder = str(tmp_path)
    put(spark, FIRST, f"{folder}/in")
    run(spark, folder)
    put(spark, LATE, f"{folder}/in")
    with monkeypatch.context() as m:
        m.setattr(usage_rollup, "MARK", "not a schema")  # the mark can be neither read nor written
        with pytest.raises(Exception):
            usage_rollup.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark", full=True)
    assert usage_rollup.high_water(spark, f"{folder}/mark") == 29
    done = run(spark, folder, full=full)
    assert done["mark"] == 32
    whole = str(tmp_path / "whole")
    put(spark, FIRST + LATE, f"{whole}/in")
    run(spark, whole)
    assert out(spark, folder) == out(spark, whole)


def test_empty_source(spark, tmp_path):
    put(spark, [], f"{tmp_path}/in")
    assert run(spark, str(tmp_path)) == {"mark_before": None, "new_events": 0, "days": 0, "mark": None, "events": 0, "rows": 0}


def test_prices_by_provider(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, [event(1, 1, user=1, k=1000), event(2, 1, user=5, k=1000)], f"{folder}/in")
    run(spark, folder)
    costs = {r.provider: r.cost for r in usage_rollup.read_output(spark, f"{folder}/out").collect()}
    assert costs == {"v1": round((500 * 0.5 + 500 * 0.05 + 2000 * 1.5) / 1e6, 9), "default": round((500 * 0.28 + 500 * 0.028 + 2000 * 0.42) / 1e6, 9)}


def test_command_line(spark, tmp_path):
    put(spark, FIRST, f"{tmp_path}/in")
    run(spark, str(tmp_path))
    done = subprocess.run([sys.executable, "jobs/usage_rollup.py", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "0 new events on 0 days" in done.stderr and len(out(spark, str(tmp_path))) == 12
