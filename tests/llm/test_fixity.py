import hashlib

from pyspark.sql import functions as F

from tidewell.llm import fixity

PAGES = "page_id long, url string, html string, hash string, offset int, status string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], PAGES)


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (1 + i * 37 % 900)) for i in range(700)] + [(None, None, None), (5, None, ""), (5, None, "")]
    first = fixity.page_records(pages(spark, rows)).persist()
    assert first.count() == 703 and first.select("archive", "offset").distinct().count() == 703
    one = {(r.archive, r.offset): r for r in first.collect()}
    hurt, lost = sorted(one, key=str)[3::97], sorted(one, key=str)[50::131]
    damaged = spark.createDataFrame([(*k, "0" * 64) for k in hurt], "archive long, offset long, bad string")
    second = first.join(damaged, ["archive", "offset"], "left").withColumn("hash", F.coalesce("bad", "hash")).select("archive", "offset", "length", "hash")
    second = second.join(spark.createDataFrame(lost, "archive long, offset long"), ["archive", "offset"], "left_anti")
    more = second.union(spark.createDataFrame([(0, 10**7, 9, "1" * 64), (99, 0, 5, "2" * 64)], second.schema)).persist()
    got = {(r.archive, r.offset): r.status for r in fixity.audit(first.drop("page_id"), more).collect()}
    want = {k: "corrupt" for k in hurt} | {k: "missing" for k in lost} | {(0, 10**7): "extra", (99, 0): "extra"}
    assert got == want
    assert fixity.audit(first.drop("page_id"), first.drop("page_id")).count() == 0


def test_records_and_roots(spark):
    r = fixity.page_records(pages(spark, [(1, "u", "ä")])).first()
    body = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nä\r\n\r\n".encode()
    assert (r.archive, r.offset, r.length, r.hash) == (0, 0, len(body), hashlib.sha256(body).hexdigest())
    empty = fixity.page_records(pages(spark, []))
    assert empty.count() == 0 and fixity.audit(empty.drop("page_id"), empty.drop("page_id")).count() == 0


def test_query_judges_records_not_ids(spark, tmp_path):
    """Undamaged pages with null or repeated ids are neither missing nor corrupt."""
    from tidewell.llm import queries

    rows = [(None, "u", "a"), (None, "u", "a"), (None, "v", None), (3, "x", "one"), (3, "x", "two"), (3, "x", "two"), (7, "y", "bad"), (7, "y", None), (60, "y", ""), (11, "z", "lost"), (70, "z", "lost")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.status) for r in queries.op2_merkle_audit(spark, str(tmp_path)).collect()]
    want = [(i, "missing" if i in (11, 70) else "corrupt" if i in (7, 60) and h is not None else "ok") for i, _, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
