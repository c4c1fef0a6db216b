"""What small tables do not show: caps, limits of rows, ties in rounding, numbers given before rows are exploded."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import catalog, library
from tidewell.plans import decisions


def test_epochs_count_records_not_signals(spark):
    names = "key long, seq long, l3_reuse boolean, l3_false_hit boolean, tokens_in long, cache_hit_tokens long, judged long, rejected int"
    usage = spark.createDataFrame([(1, s, s == 4, False, 0 if s == 2 else 10, 5, 3, 1) for s in range(1, 6)], names)
    rows = library.evolution_signals(usage).select("seq", "epoch", "name").orderBy("seq", "name").collect()
    assert [tuple(r) for r in rows] == [(s, e, n) for s, e in ((1, 1), (3, 2), (4, 3), (5, 4)) for n in ("hit", "pollution")]


def test_lineage_has_no_limit_of_rows(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        i = F.col("id")
        rows = spark.range(100).select("id", F.when((i % 3 == 0) & (i > 0), F.floor(i / 2)).alias("parent"))
        got = {r.id: (r.root, r.depth) for r in catalog.lineage(rows, 2).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    want = {}
    for n in range(100):
        chain = [n]
        while chain[-1] % 3 == 0 and chain[-1] > 0:
            chain.append(chain[-1] // 2)
        if len(chain) <= 3:
            want[n] = (chain[-1], len(chain) - 1)
    assert got == want


def test_turns_half_way_go_to_the_even_number(spark, tmp_path):
    orders = [(k, k, "O", price, None, "1") for k, price in ((1, 500.0), (2, 1500.0), (3, 2500.0), (4, 2600.0))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.id: r.turns for r in catalog.session_rows(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 2, 4: 3}


@pytest.mark.parametrize("rows", [1_000_500])
def test_counters_have_no_cap(spark, tmp_path, rows):
    spark.range(rows).select((F.col("id") * 0).alias("user_id"), F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.n for r in decisions.a24_run_metrics(spark, str(tmp_path)).collect()} == {rows}
