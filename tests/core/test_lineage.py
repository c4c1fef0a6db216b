"""Lineage of recovered sessions against a plain version: random forests with ties, missing parents, circles and system messages."""

import random

import pytest

from tidewell.operators import lineage

ROWS = "id long, parent long, recovered boolean, preferred boolean, topic string, created long, activity long, turns long"
MESSAGES = "session long, at long, role string, content string"


def origin(rows, i):
    """(origin, in_cycle, found)"""
    path, at = [], i
    while True:
        if at not in rows:
            return at, False, False
        if not rows[at]["recovered"]:
            return at, False, True
        if at in path:
            circle = path[path.index(at) :]
            return min(circle), i in circle, False
        path.append(at)
        if rows[at]["parent"] is None:
            return at, False, False
        at = rows[at]["parent"]


def body(messages):
    return messages[1:] if messages and messages[0][0] == "system" else messages


def covers(a, b):
    return a is not None and b is not None and body(a)[: len(body(b))] == body(b)


def plain(rows, texts):
    out, groups = {}, {}
    for i, r in rows.items():
        o, cycle, found = origin(rows, i)
        early = r["recovered"] and r["parent"] in rows and covers(texts.get(r["parent"]), texts.get(i))
        out[i] = [o, "normal" if not r["recovered"] else "covered_copy" if early else "diverged", False, early, cycle, None, not r["recovered"]]
        if r["recovered"] and not early:
            groups.setdefault((o, found), []).append(i)
    for (o, found), members in groups.items():
        marked = [i for i in members if rows[i]["preferred"]]
        best = None
        if len(marked) == 1:
            best = marked[0]
            out[best][1] = "preferred"
        else:
            longest = max((len(texts[i]) for i in members if i in texts), default=None)
            able = sorted((-rows[c]["activity"], c) for c in members if longest is not None and len(texts.get(c, ())) == longest and c in texts and all(covers(texts[c], texts.get(m)) for m in members))
            if able:
                best = able[0][1]
                if not found or covers(texts[best], texts.get(o)):
                    for m in members:
                        if m != best:
                            out[m][1], out[m][3] = "covered_copy", True
                    if found:
                        out[best][1] = "adopted"
            else:
                best = min(members, key=lambda i: (-rows[i]["turns"], -rows[i]["activity"], i))
        out[best][2] = True
        out[best][6] = not found
    for i, r in rows.items():
        o = out[i][0]
        kin = sorted((rows[j]["created"], j, rows[j]["topic"]) for j in rows if out[j][0] == o and rows[j]["recovered"] and rows[j]["topic"])
        root = rows[o]["topic"] if o in rows and not rows[o]["recovered"] else None
        out[i][5] = root or (kin[0][2] if kin else f"recovery:{o}")
    return sorted((i, *v) for i, v in out.items())


def forest(seed, n=120):
    r = random.Random(seed)
    rows, texts = {}, {}
    for i in range(n):
        recovered = r.random() < 0.75
        parent = r.choice([None, r.randrange(n), max(0, i - 1), i // 3, 10_000 + i % 5]) if recovered else r.choice([None, i])
        rows[i] = {"parent": parent, "recovered": recovered, "preferred": r.random() < 0.08, "topic": r.choice(["", "t1", "t2", None]), "created": r.randrange(5), "activity": r.randrange(4), "turns": r.randrange(3)}
        if r.random() < 0.93:
            story = [(x, f"{i // 20} {k}") for k, x in enumerate(["user", "assistant"] * 3)]
            text = story[: r.randrange(1, 7)] + ([("user", f"own {r.randrange(2)}")] if r.random() < 0.2 else [])
            texts[i] = ([("system", f"v{r.randrange(2)}")] if r.random() < 0.4 else []) + (text if r.random() < 0.95 else [])
            if not texts[i]:
                del texts[i]
    return rows, texts


def found(spark, rows, texts):
    df = spark.createDataFrame([(i, r["parent"], r["recovered"], r["preferred"], r["topic"], r["created"], r["activity"], r["turns"]) for i, r in rows.items()], ROWS)
    messages = spark.createDataFrame([(i, 3 * k, a, b) for i, t in texts.items() for k, (a, b) in enumerate(t)], MESSAGES)
    return sorted(tuple(r) for r in lineage.classify(df, messages).collect())


@pytest.mark.parametrize("seed", range(3))
def test_matches_plain_version(spark, seed):
    rows, texts = forest(seed)
    assert found(spark, rows, texts) == plain(rows, texts)


def case(*records, texts):
    rows = {i: {"parent": p, "recovered": rec, "preferred": False, "topic": "", "created": 0, "activity": a, "turns": 0} for i, p, rec, a in records}
    return rows, {i: [("user", c) for c in t] for i, t in texts.items()}


def test_adopted_leaf_and_its_copies(spark):
    rows, texts = case((1, None, False, 0), (2, 1, True, 5), (3, 2, True, 6), (4, 3, True, 7), texts={1: "ab", 2: "abc", 3: "abcd", 4: "abcd"})
    got = {r[0]: r[1:] for r in found(spark, rows, texts)}
    assert got[3][1:4] == ("adopted", True, False) and got[2][1] == "covered_copy" and got[4][1] == "covered_copy" and got[1][6] and not got[3][6]


def test_circles_and_chains(spark):
    chain = [(i, i - 1 if i else None, bool(i), i) for i in range(40)]
    circle = [(100, 102, True, 1), (101, 100, True, 2), (102, 101, True, 3), (103, 101, True, 4), (104, 103, True, 5), (200, 200, True, 6), (300, 999, True, 1)]
    rows, texts = case(*chain, *circle, texts={i: "x" * (i % 7 + 1) + str(i) for i in [*range(40), *range(100, 105), 200, 300]})
    got = found(spark, rows, texts)
    assert got == plain(rows, texts)
    by = {r[0]: r for r in got}
    assert {i for i in by if by[i][5]} == {100, 101, 102, 200} and by[104][1] == 100 and by[39][1] == 0 and by[300][1] == 999


def test_one_group_of_all_and_no_rows(spark):
    rows, texts = case((0, None, False, 0), *[(i, 0, True, i % 3) for i in range(1, 300)], texts={0: "a", **{i: "a" + "b" * (1 + i % 4) for i in range(1, 300)}})
    assert found(spark, rows, texts) == plain(rows, texts)
    assert found(spark, {}, {}) == []


def test_estimates_do_not_grow_with_the_rounds(spark):
    """A circle of 200: eight rounds. The product of the sides of all joins would be a number of hundreds of digits."""
    rows = spark.createDataFrame([(i, (i + 1) % 200, True) for i in range(200)], "id long, parent long, recovered boolean")
    found = lineage.origins(rows)
    assert {tuple(r) for r in found.collect()} == {(i, 0, True, False) for i in range(200)}
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**60
