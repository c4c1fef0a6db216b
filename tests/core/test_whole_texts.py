"""Queries over conversations compare and show whole texts."""

import pytest

from tidewell.plans import decisions, extraction, sessions

#: Equal in their first 60 characters only; then equal but for one letter outside ASCII; then beyond 2,048 characters.
TEXTS = ["a" * 60 + "b" * 140, "a" * 60 + "c" * 140, "ä" * 10, "ö" * 10, "ö" * 9 + "ü", "x" * 2049, "x" * 2049]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def similarity(a, b):
    longest = max(len(a), len(b))
    return 0.0 if longest > 2048 else round(1 - distance(a, b) / longest, 6)


def folder(spark, path, texts, turns):
    rows = [(0, turn, "user", t) for turn, t in zip(turns, texts, strict=True)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_false_hits_compare_whole_texts(spark, tmp_path):
    turns = [3 * i for i in range(len(TEXTS))]  # all reused
    got = {r.seq: r for r in sessions.t06_false_hit(spark, folder(spark, tmp_path, TEXTS, turns)).collect()}
    assert got[0].similarity is None and not got[0].false_hit
    for turn, a, b in zip(turns[1:], TEXTS, TEXTS[1:]):
        assert got[turn].similarity == pytest.approx(similarity(a, b)) and got[turn].false_hit == (similarity(a, b) >= 0.3)


def test_request_decisions_compare_whole_texts(spark, tmp_path):
    texts = ["a" * 50 + "b" * 149, "a" * 50 + "c" * 149, "é" * 199, "è" * 199]  # lengths that are reused
    got = {(r.decision, r.false_hit): r.n for r in decisions.r34_request_decisions(spark, folder(spark, tmp_path, texts, range(4))).collect()}
    assert got == {("reuse", False): 4}


def test_cells_hold_whole_texts(spark, tmp_path):
    texts = ["=" + "a" * 300 + "\t\x1b[31mred\x1b[0m\r\n" + "z" * 50, "b" * 201]
    got = {r.turn: r.cell for r in extraction.f21_cells(spark, folder(spark, tmp_path, texts, range(2))).collect()}
    assert got == {0: "'=" + "a" * 300 + " red  " + "z" * 50, 1: "b" * 201}
