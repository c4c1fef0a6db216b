import pytest
from pyspark.sql import functions as F

from tidewell.functions import records as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def usage(**k):
    names = ("prompt_tokens", "completion_tokens", "prompt_cache_hit_tokens", "cached_tokens", "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return F.struct(*[F.lit(k.get(n)).cast("long").alias(n) for n in names], F.lit(k.get("estimator")).cast("string").alias("estimator"))


def test_wire_usage(spark):
    got = lambda **k: (lambda x: x and tuple(x))(one(spark, R.wire_usage(usage(**k))))
    assert got(prompt_tokens=9, completion_tokens=2, cached_tokens=4) == (9, 2, 4)
    assert got(input_tokens=5, output_tokens=1, cache_read_input_tokens=7, cache_creation_input_tokens=1) == (13, 1, 7)
    assert got() is None and got(prompt_tokens=3, estimator="bytes") is None


@pytest.mark.parametrize("value,want", [("rmb", "CNY"), ("￥", "CNY"), ("us$", "USD"), ("chf", "CHF"), (" €", "EUR"), ("credits", "credits"), ("", "")])
def test_currency(spark, value, want):
    assert one(spark, R.currency(F.lit(value))) == want


def test_buckets(spark):
    assert [one(spark, R.cache_bucket(F.lit(h), F.lit(m))) for h, m in ((0, 0), (0, 5), (1, 9), (3, 7), (3, 3), (8, 2), (9, 1))] == ["unknown", "0", "1_24", "25_49", "50_74", "75_89", "90_100"]
    assert one(spark, R.tool_error_bucket(F.lit("Access DENIED"))) == "permission" and one(spark, R.tool_error_bucket(F.lit("no such file"))) == "not_found"
    assert [one(spark, R.language_bucket(F.lit(x))) for x in ("zh-CN", "EN", "", "fr")] == ["zh", "en", "auto", "other"]
    assert [one(spark, R.finish_bucket(F.lit(x))) for x in ("Stop", "", "odd")] == ["stop", "unknown", "other"]


@pytest.mark.parametrize("a,b,want", [("queued", "running", True), ("queued", "waiting", False), ("running", "running", False), ("failed", "running", False), ("running", "odd", True), ("failed", "odd", False), ("odd", "running", True), ("waiting", "failed", True)])
def test_transitions(spark, a, b, want):
    assert one(spark, R.valid_transition(F.lit(a), F.lit(b))) is want


def test_leases_filters_and_display(spark):
    see = lambda s, r, lease: tuple(one(spark, R.reconciled(F.lit(s), F.lit(r), F.lit(lease), F.lit(10))))
    assert see("running", "alive", 10) == ("stale", "exited") and see("failed", "alive", 9) == ("failed", "exited") and see("running", "alive", 11) == ("running", "alive")
    now = F.lit("2024-03-05 12:00:00").cast("timestamp")
    at = lambda t, what: one(spark, R.active_since(F.lit(t).cast("timestamp"), what, now))
    assert at("2024-03-05 00:00:00", "today") and at("2024-03-04 23:00:00", "yesterday") and not at("2024-03-03 23:00:00", "yesterday") and at("2024-03-03 23:00:00", "older")
    assert at("2024-03-04 00:00:00", "36h") and not at("2024-03-04 00:00:00", "35h") and at("2001-01-01 00:00:00", "nonsense")
    assert [one(spark, R.format_usd(F.lit(v))) for v in (1.5, 0.00004, -0.25, 2.0, 0.00005)] == ["1.5", "0", "-0.25", "2", "0.0001"]
    assert [one(spark, R.format_duration(F.lit(v))) for v in (41.6, 83.0, 3720.0)] == ["42s", "1m23s", "1h2m"]
    assert one(spark, R.strip_head(F.lit("x-bill: 1\n\n x-bill: 2\nHello\nx-bill: 3"), ("x-bill:",))) == "Hello\nx-bill: 3"
    assert one(spark, R.strip_head(F.lit("Hi\nx-bill: 3"), ("x-bill:",))) == "Hi\nx-bill: 3"
    assert one(spark, R.strip_head(F.lit("x-bill: 3"), ("x-bill:",))) == ""
