"""The stratified draw: exact quotas, any layout, strata too short for their cut, nulls and empty tables."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tidewell.operators import sessions

SCHEMA = "id long, stratum string"


def plain(rows, n, seed):
    sizes = Counter(s for _, s in rows)
    total = sum(sizes.values())
    exact = {s: n * c / total for s, c in sizes.items()}
    seats = {s: int(x) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-round(exact[s] - int(exact[s]), 9), s or ""))
    for s in order[: n - sum(seats.values())]:
        seats[s] += 1
    groups = defaultdict(list)
    for i, s in rows:
        groups[s].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return sorted(i for s, g in groups.items() for _, i in sorted(g)[: seats[s]])


@pytest.mark.parametrize("n", [1, 100, 5000])
def test_draw_is_exact_for_any_layout(spark, n):
    rows = [(i, "hot" if i % 3 else f"s{i % 17}") for i in range(3000)] + [(9000 + i, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, min(n, len(rows)), 4)
    for layout in (df.coalesce(1), df.repartition(9)):
        assert sorted(r.id for r in sessions.draw(layout, n, 4).collect()) == want
    assert n != 100 or sorted(r.id for r in sessions.draw(df, n, 5).collect()) != want


def test_strata_below_their_cut_and_empty_tables(spark):
    few = [(i, f"s{i % 3}") for i in range(9)]
    assert sorted(r.id for r in sessions.draw(spark.createDataFrame(few, SCHEMA), 6, 1).collect()) == plain(few, 6, 1)
    assert sessions.draw(spark.createDataFrame([], SCHEMA), 5, 1).count() == 0 and sessions.draw(spark.createDataFrame(few, SCHEMA), 0, 1).count() == 0
