from collections import Counter

from fixtures import documents, prose
from tidewell.llm import sharding


def check(rows, n, shards=16):
    by = Counter(r.shard for r in rows)
    assert sum(by.values()) == n
    sizes = [by.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))


def test_shards_are_even_whole_and_random(spark):
    texts = [prose(i, i % 50) for i in range(400)]
    df = documents(spark, texts)
    got = sharding.external_shuffle(df, bucket_bytes=4096)
    rows = got.collect()
    check(rows, 400)
    assert sorted(r.doc_id for r in rows) == list(range(400)) and {r.doc_id: r.text for r in rows} == dict(enumerate(texts))
    again = sharding.external_shuffle(df.repartition(7), bucket_bytes=4096).collect()
    place = lambda rs: {r.doc_id: (r.shard, r.slot) for r in rs}
    assert place(rows) == place(again)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 40
    assert place(sharding.external_shuffle(df, seed=7, bucket_bytes=4096).collect()) != place(rows)


def test_repeated_null_and_empty(spark):
    rows = sharding.external_shuffle(documents(spark, ["same"] * 300 + [None, ""], ids=[5] * 300 + [None, 5]), bucket_bytes=128).collect()
    check(rows, 302)
    assert Counter(r.doc_id for r in rows) == {5: 301, None: 1}
    assert sharding.external_shuffle(documents(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    sharding.write_shards(sharding.external_shuffle(documents(spark, [prose(i, 9) for i in range(64)]), shards=4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().filter("count = 16").count() == 4
