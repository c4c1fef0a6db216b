"""The trace converter against a plain version over random steps, and over lines that are no steps."""

import json
import random

from tidewell.sources import traces


def marker(x):
    return f"(chars={x.get('content_chars') or x.get('result_chars') or 0})"


def plain(step):
    rows, said, calls = [], [], []
    events = step.get("timing_events") or []
    tools = {t.get("tool_call_id"): t for t in step.get("tools") or []}
    names = {e.get("tool_call_id"): e.get("tool_name") for e in events if e.get("event_type") == "tool_call"}

    def close():
        if said or calls:
            rows.append(("assistant", "".join(said) or None, None, None, tuple(calls) or None))
        said.clear()
        calls.clear()

    for e in events:
        kind = e.get("event_type")
        if kind == "user_message":
            close()
            rows.append(("user", marker(e), None, None, None))
        elif kind in ("text", "reasoning"):
            said.append(marker(e))
        elif kind == "tool_call":
            calls.append((e.get("tool_call_id"), e.get("tool_name")))
    close()
    out, done = [], set()
    for row in rows:
        out.append(row)
        for i, _ in row[4] or ():
            if i in tools and i not in done:
                done.add(i)
                out.append(("tool", marker(tools[i]), names[i], i, None))
    return out


def step(r, n):
    event = lambda: {k: v for k, v in {"event_type": r.choice(["user_message", "text", "reasoning", "tool_call", "tool_call", "other", None]), "tool_call_id": r.choice(["a", "b", "c", None]), "tool_name": r.choice(["read", "run"]), "content_chars": r.choice([0, 5, None]), "result_chars": r.choice([0, 7, None])}.items() if v is not None or r.random() < 0.5}
    out = {"session_id": f"s{n % 3}", "round_index": r.randrange(4), "timing_events": [event() for _ in range(r.randrange(9))], "tools": [{"tool_call_id": r.choice(["a", "b", None]), "result_chars": r.randrange(3)} for _ in range(r.randrange(4))], "other": {"deep": [1, {"x": 2}]}}
    return {k: v for k, v in out.items() if r.random() < 0.93}


def test_matches_plain_version(spark):
    r = random.Random(2)
    steps = [step(r, n) for n in range(200)]
    df = spark.createDataFrame([(json.dumps(s), n) for n, s in enumerate(steps)], "raw string, line long")
    got = {}
    for x in traces.convert(df).orderBy("line", "part").collect():
        calls = tuple((c.id, c.name) for c in x.tool_calls) if x.tool_calls is not None else None
        got.setdefault((x.session, x.round, x.line), []).append((x.role, x.content, x.name, x.tool_call_id, calls))
    want = {(s.get("session_id", "unknown"), s.get("round_index", 0), n): plain(s) for n, s in enumerate(steps) if plain(s)}
    assert got == want and len(want) > 120


def test_lines_that_are_no_steps(spark):
    df = spark.createDataFrame([("", 0), (None, 1), ("{broken", 2), ("[1, 2]", 3), ("7", 4), ('{"timing_events": "no list", "tools": 3}', 5), ('{"timing_events": [{"event_type": "text"}]}', 6)], "raw string, line long")
    assert [(x.session, x.round, x.line, x.role, x.content) for x in traces.convert(df).collect()] == [("unknown", 0, 6, "assistant", "(chars=0)")]
    assert traces.convert(df.limit(0)).count() == 0
