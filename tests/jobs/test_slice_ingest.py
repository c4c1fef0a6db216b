"""The ingest of slices over growing input, after crashes and from its command line."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import slice_ingest

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "conv_id long, turn long, role string, text string"
FIRST = [(1, 0, "user", "How do I  sort a\tlist?"), (1, 1, "assistant", "Use sorted()."), (1, 2, "user", "thanks"), (2, 0, "system", "be brief"), (2, 1, "user", "look at /home/ann/x.py"), (2, 2, None, "lost"), (2, 3, "user", None), (2, 4, "user", " ?! "), (2, 5, "assistant", "thanks")]
SECOND = [(3, 0, "user", "thanks"), (3, 1, "assistant", "thanks"), (3, 2, "user", "new\x1b[31m words\x1b[0m here"), (1, 0, "user", "How do I  sort a\tlist?")]


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def out(spark, folder):
    return sorted((tuple(r) for r in slice_ingest.read_output(spark, f"{folder}/out").select("conv_id", "turn", "kind", "slice_id", "content", "n_terms").collect()))


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def run(spark, folder, **config):
    return slice_ingest.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", slice_ingest.load_config() | config)


def test_growing_input(spark, folder, tmp_path):
    put(spark, FIRST, f"{folder}/in")
    (one,) = run(spark, folder)
    assert one["rows"] == 9 and one["blank"] == 2 and one["turns"] == 5 and one["slices"] == 5
    before = out(spark, folder)
    assert run(spark, folder) == [] and out(spark, folder) == before
    put(spark, SECOND, f"{folder}/in")
    (two,) = run(spark, folder)
    assert two["rows"] == 4 and two["turns"] == 4 and two["slices"] == 1  # "thanks" is known as a prompt and as a result
    whole = str(tmp_path / "whole")
    put(spark, FIRST + SECOND, f"{whole}/in")
    run(spark, whole)
    assert out(spark, folder) == out(spark, whole)
    ids = [r.slice_id for r in spark.read.parquet(f"{folder}/out/slices").select("slice_id").collect()]
    assert len(ids) == len(set(ids)) == 6
    assert {r[4] for r in out(spark, folder)} >= {"look at <local-home>/x.py", "new words here", "How do I sort a list?"}


@pytest.mark.parametrize("lost", ["commit", "commit and slices"])
def test_crash_after_writing(spark, folder, lost):
    """A batch that wrote some or all of its output but was not committed is run again and changes nothing."""
    put(spark, FIRST, f"{folder}/in")
    run(spark, folder)
    put(spark, SECOND, f"{folder}/in")
    run(spark, folder)
    want = out(spark, folder)
    for path in glob.glob(f"{folder}/checkpoint/commits/*1*") + glob.glob(f"{folder}/checkpoint/commits/.*1*"):
        os.remove(path)
    if "slices" in lost:
        for path in glob.glob(f"{folder}/out/slices/batch=1/*/*.parquet"):
            os.remove(path)
    (again,) = run(spark, folder)
    assert again["batch"] == 1 and out(spark, folder) == want


def test_files_one_by_one_and_hot_copies(spark, folder):
    for i in range(3):
        put(spark, [(i, t, "user", "the same words" if t % 2 else f"own {i} {t}") for t in range(40)], f"{folder}/in")
    counts = run(spark, folder, files_per_batch=1)
    assert [c["batch"] for c in counts] == [0, 1, 2] and [c["slices"] for c in counts] == [21, 20, 20] and len(out(spark, folder)) == 120


def test_no_rows_at_all(spark, folder):
    put(spark, [], f"{folder}/in")
    run(spark, folder)
    put(spark, FIRST, f"{folder}/in")
    run(spark, folder)
    assert len(out(spark, folder)) == 5


def test_command_line(spark, folder):
    put(spark, FIRST, f"{folder}/in")
    run(spark, folder)
    done = subprocess.run([sys.executable, "jobs/slice_ingest.py", f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "0 batches" in done.stderr and len(out(spark, folder)) == 5
