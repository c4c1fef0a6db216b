import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import numeric, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value,want",
    [("Hello wörld_1 你好!", ["hello", "wörld_1", "你", "好"]), ("", []), ("fooBar语言x", ["foobar", "语", "言", "x"]), ("--", [])],
)
def test_tokens(spark, value, want):
    assert one(spark, text.tokens("t"), t=value) == want


def test_other_tokenizers(spark):
    assert one(spark, text.tokens_bigram("t"), t="Fix 缓存命中 の bug") == ["fix", "缓存", "存命", "命中", "の", "bug"]
    assert one(spark, text.tokens_code("t"), t="getHTTPUser2 snake_case x") == ["gethttpuser2", "get", "httpuser", "snake_case", "snake", "case", "x"]
    assert one(spark, text.tokens_code("t"), t="缓存命") == ["缓", "存", "缓存", "命", "存命"]
    assert one(spark, text.tokens_hashed("t"), t="Foo_bar é 修x1") == ["Foo", "bar", "修", "x1"]


@pytest.mark.parametrize("value,want", [("a", 3826002220), ("foobar", 3214735720), ("修", 2571587262), ("", 2166136261)])
def test_fnv(spark, value, want):
    assert one(spark, text.fnv1a32("t"), t=value) == want


def test_coverage_and_similarity(spark):
    assert one(spark, text.query_coverage("q", "c"), q="cache miss cache", c="the cache") == 0.5
    assert one(spark, text.query_coverage("q", "c"), q="?!", c="x") == 0.0
    assert one(spark, text.edit_similarity(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, text.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, text.edit_similarity(F.repeat(F.lit("a"), 2049), F.lit("a"))) == 0.0


def test_presentation(spark):
    assert one(spark, text.normalize_space("t"), t="  a \n\t b ") == "a b"
    long = "x " * 50 + "needle here " + "y " * 50
    cut = one(spark, text.snippet("t", "q", 20), t=long, q="needle")
    assert cut.startswith("...") and cut.endswith("...") and "needle" in cut and len(cut) == 26
    assert one(spark, text.snippet("t", "q", 200), t="short", q="z") == "short"
    assert one(spark, text.escape_markers("t"), t="a [REUSE] b [/reuse]") == "a [\\reuse] b [\\/reuse]"
    assert one(spark, text.strip_terminal("t"), t="\x1b[31mred\x1b[0m \x1b]0;t\x07ok \x1b[9") == "red ok [9"
    assert one(spark, text.tsv_cell("t"), t="=1\t+2") == "'=1 +2"
    assert one(spark, text.redact_home("t"), t="see /home/me/x and C:\\Users\\Bob\\y") == "see <local-home>/x and <local-home>\\y"


@pytest.mark.parametrize("value,want", [("git commit -m x", "git commit"), ("git -v", "git"), ("ls -la", "ls"), ("/bin/ls", ""), ("", ""), ("FOO=1 make", ""), ("'npm' run", "npm run")])
def test_command_heads(spark, value, want):
    assert one(spark, text.command_head("t"), t=value) == want


@pytest.mark.parametrize("value,want", [("./a/../b/c.go", "b/c.go"), ("/abs", None), ("..", None), ("../x", None), ("~/x", None), ("http://x", None), ("C:\\x", None), ("a\\b", "a/b"), ("", None), ("'q.txt'", "q.txt")])
def test_paths(spark, value, want):
    assert one(spark, text.relative_path("t"), t=value) == want


def test_keys_and_order(spark):
    assert one(spark, text.subject_key("t"), t=" Build Tool . Go_Version!. ._-") == "build_tool.go_version"
    assert one(spark, text.title_key("t"), t="A b-C 你1") == "abc你1"
    assert one(spark, text.subsequence_rank("t", "/modl"), t="/Model") == 1
    assert one(spark, text.subsequence_rank("t", "/mo"), t="/Model") == 0
    assert one(spark, text.subsequence_rank("t", "z"), t="/Model") is None
    tools = spark.sql("select array(named_struct('name', 'b', 'k', 1), named_struct('name', null, 'k', 2), named_struct('name', 'a', 'k', 3), named_struct('name', 'b', 'k', 4)) t")
    assert [x["k"] for x in tools.select(text.sort_tools(F.col("t")).alias("x")).first().x] == [3, 1, 4, 2]


def test_messages(spark):
    m = spark.sql("select array(named_struct('role', 'user', 'content', ' a  b '), named_struct('role', 'assistant', 'content', 'c'), named_struct('role', 'user', 'content', ' ')) m")
    assert m.select(text.last_user_text(F.col("m")).alias("x")).first().x == "a b"
    p = spark.sql("select array(named_struct('type', 'text', 'text', 'x'), named_struct('type', 'image', 'text', 'no'), named_struct('type', 'text', 'text', 'y')) p")
    assert p.select(text.content_text(F.col("p")).alias("x")).first().x == "xy"


def test_slice_ids(spark):
    import hashlib

    assert one(spark, text.slice_id("t", "result"), t="x") == hashlib.sha256(bytes([3, 1]) + b"x").hexdigest()[:16]
    assert one(spark, text.replay_id("t", "v-"), t="x") == "v-" + hashlib.sha256(b"x").hexdigest()[:16]


@pytest.mark.parametrize("score,top,want", [(0.7, 0.7, "hit"), (0.69, 0.69, "grey"), (0.44, 0.44, "miss"), (0.56, 0.7, "hit"), (0.4, 0.7, "grey"), (0.38, 0.7, "miss"), (0.0, 1.0, "miss"), (float("nan"), 1.0, "miss"), (float("inf"), 1.0, "miss")])
def test_zones(spark, score, top, want):
    assert one(spark, numeric.zone(F.col("s"), F.col("t")), s=score, t=top) == want


def test_other_zones(spark):
    assert one(spark, numeric.winner_zone(F.lit(1.0), F.lit(0.4))) == "hit"
    assert one(spark, numeric.winner_zone(F.lit(1.0), F.lit(0.5))) == "grey"
    assert one(spark, numeric.reuse_zone(F.lit(0.8), F.lit(0.8), F.lit(1.0))) == "hit"
    assert one(spark, numeric.reuse_zone(F.lit(0.4), F.lit(0.4), F.lit(1.0))) == "miss"
    for age, want in ((0, "hit"), (50, "hit"), (51, "grey"), (101, "grey"), (102, "miss"), (-1, "miss")):
        assert one(spark, numeric.freshness_zone(F.lit(1000 - age), F.lit(1000), F.lit(101))) == want


@pytest.mark.parametrize("ratio,want", [(0.69, "none"), (0.70, "halt_prefetch"), (0.80, "degrade_inject"), (0.90, "degrade_tier"), (1.0, "hard_stop")])
def test_budget(spark, ratio, want):
    assert one(spark, numeric.budget_action(F.col("s"), F.lit(1.0)), s=ratio) == want


def test_weights(spark):
    w = lambda **k: one(spark, numeric.value_weight(*[F.lit(k.get(n, 0)) for n in ("created", "last_used", "hits", "injected", "rejected")], F.lit(k.get("feedback", 0.0)), F.lit(k.get("now", 100 * 86400))))
    assert w(created=70 * 86400) == pytest.approx(0.5 * 0.5 / 3)
    assert w() == pytest.approx(0.5 * 0.5 / 3)
    assert w(created=100 * 86400, hits=100, feedback=1.0) == 1.0
    assert w(created=100 * 86400, injected=1, rejected=1) == pytest.approx(1.5 / 4 * 2 / 4)
    assert w(created=1, feedback=float("nan"), now=10**9) == 0.001
    assert one(spark, numeric.beta_mean(F.lit(0.0), F.lit(1.0))) == pytest.approx(1 / 3)
    assert one(spark, numeric.wilson_low(F.lit(0.5), F.lit(0.0))) == 0.0
    assert one(spark, numeric.calibration_bin(F.lit(1.0))) == 9 and one(spark, numeric.calibration_bin(F.lit(float("nan")))) == 0
    assert one(spark, numeric.provider_of(F.lit("a/b"))) == "a" and one(spark, numeric.provider_of(F.lit("b"))) == "default"
    assert math.isclose(one(spark, numeric.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))), 2**-0.5)
