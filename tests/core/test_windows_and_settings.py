"""Rolling order statistics, thresholds as of a time, and contexts of sessions, against plain versions and edges."""

import json
import math
import random

import pytest

from tidewell.functions.numeric import Zones
from tidewell.operators import calibration, extraction, usage


def test_rolling_ranks_match_plain_windows(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.choice([-5, 10, 300, 500, 700])) for i in range(150)] + [("c", 1, 900), ("c", 2, 900)]
    df = spark.createDataFrame(rows, "plugin string, seq long, ms long")
    got = {(x.plugin, x.seq): (x.n, x.p99, x.demote) for x in usage.rolling_ranks(df, "plugin", "ms", 500).collect()}
    for plugin in "abc":
        mine = sorted((s, max(m, 0)) for p, s, m in rows if p == plugin)
        for k, (seq, _) in enumerate(mine):
            frame = [m for _, m in mine[max(0, k - 19) : k + 1]]
            p99 = sorted(frame)[max(1, math.ceil(0.99 * len(frame))) - 1]
            assert got[plugin, seq] == (len(frame), p99, len(frame) >= 3 and min(frame[-3:]) >= 500)
    assert not any(x.demote for x in usage.rolling_ranks(df, "plugin", "ms", 0).collect())
    assert usage.rolling_ranks(df.limit(0), "plugin", "ms", 5).count() == 0


ROWS, SETTINGS = "type string, at long, top1 double, top2 double, relevant boolean", "since long, type string, tau_high double, tau_low double, abs_high double, abs_low double"


def zones(history, at, type_):
    begun = [s for s in history if s[0] <= at]
    if not begun:
        return Zones()
    last = max(s[0] for s in begun)
    now = [s for s in begun if s[0] == last]
    own = [s[2:] for s in now if s[1] is not None and s[1] == type_] or [s[2:] for s in now if s[1] is None]
    return Zones(*max(own)) if own else Zones()


def zone(top1, top2, z):
    if top1 is None or top1 <= 0 or top1 < z.abs_low:
        return "miss"
    return "hit" if top1 >= z.abs_high and top1 - (top2 or 0) >= z.tau_low * top1 else "grey"


def test_settings_of_the_time_by_type(spark):
    r = random.Random(2)
    history = [(10, None, 0.8, 0.5, 0.6, 0.3), (10, "result", 0.9, 0.9, 0.9, 0.8), (10, "result", 0.9, 0.95, 0.9, 0.8), (20, "prompt", 0.5, 0.1, 0.2, 0.1), (30, None, 0.9, 0.7, 0.9, 0.5)]
    rows = [(r.choice(["result", "prompt", None]), r.randrange(45), r.choice([None, 0.0, 0.35, 0.6, 0.95]), r.choice([None, 0.1, 0.3]), r.choice([None, True, False])) for _ in range(300)]
    df, settings = spark.createDataFrame(rows, ROWS), spark.createDataFrame(history, SETTINGS)
    judged = calibration.judged(calibration.with_settings(df, settings)).cache()
    assert sorted(map(repr, ((x.type, x.at, x.top1, x.top2, x.zone, x.default_zone) for x in judged.collect()))) == sorted(
        map(repr, ((t, a, p, q, zone(p, q, zones(history, a, t)), zone(p, q, Zones())) for t, a, p, q, _ in rows))
    )
    for x in calibration.drift(judged).collect():
        mine = [row for row in rows if x.type == "*" or row[0] == x.type]
        hits = [row for row in mine if zone(row[2], row[3], zones(history, row[1], row[0])) == "hit"]
        assert (x.n, x.hit) == (len(mine), len(hits)) and x.hit_drift == pytest.approx(100 * (x.hit - x.default_hit) / x.n, abs=1e-6)
    whole = [x for x in calibration.bins_by_type(judged).collect() if x.type == "*"]
    assert sum(x.n for x in whole) == 300 and all(x.precision is None for x in whole if not x.hit)
    empty = calibration.judged(calibration.with_settings(df, settings.limit(0)))
    assert empty.filter("zone <> default_zone").count() == 0 and empty.count() == 300


def test_contexts_of_sessions(spark):
    call = lambda name, **arguments: ("c", name, json.dumps(arguments))
    rows = [
        (1, 0, "assistant", "", [call("read", path="a/b.py"), call("read", file="./a/b.py"), call("bash", command="git status"), call("Bash", command="git status -s")]),
        (1, 1, "assistant", "done", []),
        (2, 0, "assistant", "", [call("read", path="once.py"), call("read", path="/abs"), call("read", path="/abs")]),
        (3, 0, "user", "hi", None),
    ]
    df = spark.createDataFrame(rows, "session long, line long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>")
    got = {r.session: r.content for r in extraction.contexts(df).collect()}
    assert got == {1: "Project context observed from repeated tool calls:\nFrequent paths:\n- a/b.py (2)\nFrequent directories:\n- a (2)\nCommon command heads:\n- git status (2)"}
    kinds = {(r.session, r.kind) for r in extraction.extract(df).collect()}
    assert kinds == {(1, "context"), (1, "tool_pattern"), (1, "result"), (2, "tool_pattern"), (3, "prompt")}
    assert extraction.contexts(df.limit(0)).count() == 0
