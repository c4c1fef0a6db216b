"""Registered queries of sessions, extraction, learning, evaluation and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import catalog, decide, learning, sessions
from ..sources.tables import events, questions, read, slices
from .retrieval import _BM25, _FNV


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("line"), "role", F.col("text").alias("content"))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tool steps: errors failed."""
    return read(spark, folder, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"))


def w06_turns(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.turns(lines(spark, folder)).select("session", "line", "role", "turn_no")


def w13_final_result(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.final_results(lines(spark, folder)).select("session", "line", F.sha2("content", 256).alias("version"))


def w08_context(spark: SparkSession, folder: str) -> DataFrame:
    hits = lines(spark, folder).filter(F.lower("content").contains("the ")).groupBy("session").agg(F.min("line").alias("hit"))
    return sessions.context(lines(spark, folder), hits, 2).select("session", "line", "hit", "role")


def a08_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.transitions(steps(spark, folder))


def r13_prefetch_plan(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.prefetch_plan(sessions.transitions(steps(spark, folder)), ("view", "click", "purchase")).select("prev", "next", "rank", "probability")


def w07_parallel_groups(spark: SparkSession, folder: str) -> DataFrame:
    calls = steps(spark, folder).withColumn("parallel", F.col("name").isin("view", "click", "signup"))
    grouped = sessions.parallel_groups(calls, 3)
    return grouped.groupBy("session", "group_no").agg(F.count(F.lit(1)).alias("calls"), F.min("seq").alias("first_seq"))


def a11_tool_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = steps(spark, folder).withColumn("name", F.concat(F.lit("tool"), (F.col("session") % 7).cast("string")))
    return sessions.tool_rates(rows)


def a10_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds end at each sign-up; dispatched and succeeded steps of each."""
    order = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps(spark, folder).withColumn("round_no", F.sum((F.col("name") == "signup").cast("int")).over(order)).filter("name <> 'signup'")
    return rows.groupBy("session", "round_no").agg(F.count(F.lit(1)).alias("dispatched"), F.count_if("ok").alias("succeeded"))


def t06_false_hit(spark: SparkSession, folder: str) -> DataFrame:
    asked = lines(spark, folder).filter("role = 'user'").select("session", F.col("line").alias("seq"), F.col("content").alias("query"), (F.col("line") % 3 != 1).alias("reused"))
    return sessions.false_hits(asked, 0.3).select("session", "seq", "similarity", "false_hit")


def f15_slice_ids(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.prompt_slices(lines(spark, folder)).select("session", "turn_no", "slice_id", text.replay_id("content", "v-").alias("replay"))


def x02_upsert(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).select("user_id", "event_type", "event_id", "k")
    return sessions.latest(e, ["user_id", "event_type"], [F.desc("event_id")])


def s12_quotas(spark: SparkSession, folder: str) -> DataFrame:
    strata = read(spark, folder, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return sessions.quotas(strata, 137)


def s12_draw(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 137 documents by language and source."""
    rows = read(spark, folder, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"))
    return sessions.draw(rows, 137, 11, "doc_id")


def w12_hold_out(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "labels").select("doc_id", "quality")
    return sessions.hold_out(rows, ["doc_id"], 0.7)


def t01_ewma_fold(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    name = F.when(F.col("event_type").isin("click", "purchase"), "hit").when(F.col("event_type") == "error", "pollution").otherwise("other")
    value = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", F.col("value") / 40).otherwise(F.col("value") / 5)
    return learning.evolve(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("epoch"), name.alias("name"), value.alias("value")))


def t02_adaptive(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return learning.adapt(e.select((F.col("user_id") % 40).alias("slice_id"), F.col("event_id").alias("seq"), ((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)).alias("negative")))


def t03_beta_posterior(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").filter("event_type in ('click', 'error', 'view')")
    return learning.beta_posterior(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("hit")))


def a12_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """A length rule as the judge, labels as the truth."""
    rows = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    return sessions.confusion(rows.select((F.col("n_chars") > 600).alias("said"), (F.col("quality") == 1).alias("truth")))


def a14_calibration_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    return sessions.calibration(rows.select(F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("ratio"), (F.col("quality") == 1).alias("good")))


def a15_policy_eval(spark: SparkSession, folder: str) -> DataFrame:
    """One threshold against three zones on each query's best two documents; the truth is the best one's label."""
    from ..operators import retrieval

    ranked = retrieval.lexical(questions(spark, folder), slices(spark, folder), 2, ("query_id",))
    tops = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("best"))
    judged = tops.join(read(spark, folder, "labels").select(F.col("doc_id").alias("best"), "quality"), "best", "left").withColumn("zone", numeric.winner_zone(F.col("top1"), F.col("top2")))
    wrong = F.coalesce(F.col("quality"), F.lit(0)) != 1
    return judged.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("top1") >= 20).alias("single_reuse"),
        F.count_if((F.col("top1") >= 20) & wrong).alias("single_wrong"),
        F.count_if(F.col("zone") == "hit").alias("zoned_reuse"),
        F.count_if((F.col("zone") == "hit") & wrong).alias("zoned_wrong"),
        F.count_if(F.col("zone") == "grey").alias("grey"),
    )


def r11_judge_chain(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 4 != 0).alias("same_files"), numeric.zone(F.col("n_chars") / 3000, F.lit(0.9)).alias("zone"), F.when(F.col("doc_id") % 5 < 3, "yes").when(F.col("doc_id") % 5 == 3, "no").alias("verdict")
    )
    return decide.judge_chain(rows).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_if("judge_called").alias("called"))


def n08_freshness(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select((F.col("event_id") * 300).alias("created"), "event_type")
    zone = numeric.freshness_zone(F.col("created"), F.lit(2_500_000), F.lit(1_200_001))
    return e.groupBy("event_type", zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def n12_memory_freshness(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    day = F.col("event_id") % 500 * 86400
    kind = F.when(F.col("user_id") % 3 == 0, "reference").when(F.col("user_id") % 3 == 1, "user").otherwise("project")
    volatility = F.when(F.col("event_type") == "click", "volatile").when(F.col("event_type") == "view", "stable").when(F.col("event_type") == "signup", "evergreen").otherwise("")
    expires = F.when(F.col("event_id") % 17 == 0, day + 30 * 86400)
    fresh = numeric.memory_freshness(day, day, F.when(F.col("event_id") % 9 == 0, day + 100 * 86400), expires, volatility, kind, F.lit(500 * 86400))
    return e.groupBy("event_type", kind.alias("kind"), fresh.alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


def n19_budget_actions(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "customer")
    return o.groupBy(numeric.budget_action(F.col("c_acctbal"), F.lit(9000.0)).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def n11_wilson(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("h"), F.count(F.lit(1)).alias("n"))
    mean = numeric.beta_mean(F.col("h"), F.col("n") - F.col("h"))
    return e.select("user_id", F.round(mean, 6).alias("mean"), F.round(numeric.wilson_low(mean, F.col("n").cast("double")), 6).alias("low"))


def w14_keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), F.col("o_orderdate").alias("activity"))
    return catalog.page(rows, 50, after=(False, "1998-01-01 00:00:00", 100))


def a20_topic_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.topics(catalog.session_rows(spark, folder))


def a21_counters(spark: SparkSession, folder: str) -> DataFrame:
    s = catalog.session_rows(spark, folder)
    return s.groupBy("scope").agg(F.count(F.lit(1)).alias("sessions"), F.count_if("recovered").alias("recovered"), F.count_if(F.col("health") == "corrupt").alias("corrupt"), F.count_distinct("topic").alias("topics"))


def w15_preferred_leaf(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.preferred(catalog.session_rows(spark, folder)).select("topic", "id", "turns")


def j09_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sessions of which each third continues the one at half its number."""
    rows = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") > 0), F.floor(F.col("o_orderkey") / 2)).alias("parent"))
    return catalog.lineage(rows, 16).groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max("depth").alias("depth"))


def p09_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.filter(F.lower("c_name").like("%00001%") & F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", "c_name", "o_orderstatus")


def f13_edit_similarity(spark: SparkSession, folder: str) -> DataFrame:
    names = read(spark, folder, "nation").select("n_name", F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("next_name"))
    return names.filter("next_name is not null").select("n_name", "next_name", F.round(text.edit_similarity(F.col("n_name"), F.col("next_name")), 6).alias("similarity"))


def f_text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts, terms, hashes and keys of all documents."""
    d = read(spark, folder, "documents")
    return d.select(
        "doc_id",
        F.size(text.tokens("text")).alias("n_tokens"),
        F.size(text.unique_terms(text.tokens("text"))).alias("n_terms"),
        text.content_version("text").alias("version"),
        text.fnv1a32(F.concat_ws(":", "lang", "source")).alias("fnv"),
        F.char_length(text.normalize_space("text")).alias("n_normal"),
        text.subject_key(F.concat(F.col("lang"), F.lit(". "), F.upper("source"), F.lit("._x_"))).alias("subject"),
    )


def r30_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of healthy topics of the last days, ten a scope."""
    s = catalog.session_rows(spark, folder).filter("health = 'ok' and not recovered")
    order = Window.partitionBy("scope").orderBy(F.desc("activity"), "id")
    return s.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("scope", "rank", "id", "topic", "activity")


QUERIES = {
    f.__name__: f
    for f in (
        w06_turns, w13_final_result, w08_context, a08_bigrams, r13_prefetch_plan, w07_parallel_groups, a11_tool_rates, a10_rounds, t06_false_hit, f15_slice_ids, x02_upsert, s12_quotas, s12_draw, w12_hold_out, t01_ewma_fold, t02_adaptive,
        t03_beta_posterior, a12_confusion, a14_calibration_bins, a15_policy_eval, r11_judge_chain, n08_freshness, n12_memory_freshness, n19_budget_actions, n11_wilson, w14_keyset_page, a20_topic_rollup, a21_counters, w15_preferred_leaf,
        j09_lineage, p09_search, f13_edit_similarity, f_text_forms, r30_listing,
    )
}

_TR = """x AS (SELECT event_type AS prev, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events), c AS (SELECT prev, next, count(*) AS n FROM x WHERE next IS NOT NULL GROUP BY ALL), t AS (SELECT *, round(n / sum(n) OVER (PARTITION BY prev), 6) AS probability FROM c)"""
_S = """s AS (SELECT o_orderkey AS id, o_orderpriority AS scope, o_custkey % 200 AS topic, (o_totalprice / 1000)::BIGINT AS turns, CASE WHEN o_orderkey % 29 = 0 THEN 'corrupt' WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE 'valid' END AS turns_state,
 o_orderkey % 4 = 0 AS recovered, CASE WHEN o_orderkey % 12 = 0 THEN 'preferred' WHEN o_orderkey % 12 = 4 THEN 'diverged' WHEN o_orderkey % 12 = 8 THEN 'covered_copy' ELSE '' END AS role, CASE WHEN o_orderkey % 37 = 0 THEN 'corrupt' WHEN o_orderkey % 41 = 0 THEN 'missing' ELSE 'ok' END AS health, o_orderdate AS activity FROM orders)"""

#: DuckDB's edit distance counts bytes: each letter outside ASCII becomes a control character that texts do not hold (29 at most).
SINGLE_BYTES = """a AS (SELECT (SELECT coalesce(string_agg(DISTINCT c, ''), '') FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE unicode(c) > 127) AS letters,
(SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(1, 128) AS t(i) WHERE (i < 32 OR i = 127) AND i NOT IN (9, 10, 13)) AS bytes)"""

SQL = {
    "w06_turns": "SELECT conv_id AS session, turn AS line, role, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS turn_no FROM conversations",
    "w13_final_result": "SELECT conv_id AS session, max(turn) AS line, sha256(arg_max(text, turn)) AS version FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "w08_context": "WITH h AS (SELECT conv_id, min(turn) AS hit FROM conversations WHERE contains(lower(text), 'the ') GROUP BY conv_id) SELECT c.conv_id AS session, turn AS line, hit, role FROM conversations c JOIN h USING (conv_id) WHERE abs(turn - hit) <= 2",
    "a08_bigrams": f"WITH {_TR} SELECT * FROM t",
    "r13_prefetch_plan": f"WITH {_TR} SELECT prev, next, row_number() OVER (PARTITION BY prev ORDER BY probability DESC, next) AS rank, probability FROM t WHERE next IN ('view', 'click', 'purchase') QUALIFY rank <= 3 AND rank * 200 <= 1000",
    "w07_parallel_groups": """WITH p AS (SELECT user_id, event_id, event_type IN ('view', 'click', 'signup') AS par FROM events), a AS (SELECT *, (NOT par OR NOT coalesce(lag(par) OVER (PARTITION BY user_id ORDER BY event_id), false))::INT AS st FROM p),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS isl FROM a), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, isl ORDER BY event_id) - 1) % 3 = 0 AS hd FROM b),
d AS (SELECT *, (sum(hd::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS group_no FROM c) SELECT user_id AS session, group_no, count(*) AS calls, min(event_id) AS first_seq FROM d GROUP BY ALL""",
    "a11_tool_rates": "SELECT 'tool' || (user_id % 7) AS name, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, round(avg(value), 6) AS mean_duration, round(1e0 - count(*) FILTER (event_type = 'error') / count(*), 6) AS success_rate FROM events GROUP BY ALL",
    "a10_rounds": """WITH r AS (SELECT user_id AS session, event_type, (sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS round_no FROM events)
SELECT session, round_no, count(*) AS dispatched, count(*) FILTER (event_type <> 'error') AS succeeded FROM r WHERE event_type <> 'signup' GROUP BY ALL""",
    "t06_false_hit": f"""WITH {SINGLE_BYTES}, q AS (SELECT conv_id AS session, turn AS seq, translate(text, letters, bytes) AS query, turn % 3 <> 1 AS reused FROM conversations, a WHERE role = 'user'),
l AS (SELECT *, lag(query) OVER w AS b, lag(reused) OVER w AS r, greatest(length(b), length(query)) AS longest FROM q WINDOW w AS (PARTITION BY session ORDER BY seq)),
d AS (SELECT session, seq, CASE WHEN r AND longest > 2048 THEN 0e0 WHEN r THEN round(1e0 - levenshtein(b, query) / longest, 6) END AS similarity FROM l) SELECT *, coalesce(similarity >= 3e-1, false) AS false_hit FROM d""",
    "x02_upsert": "SELECT user_id, event_type, event_id, json_extract(props, '$.k')::BIGINT AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "s12_quotas": """WITH s AS (SELECT lang || '/' || source AS stratum, count(*) AS size FROM documents GROUP BY ALL), e AS (SELECT *, size * 137 / sum(size) OVER () AS x FROM s), f AS (SELECT *, floor(x)::BIGINT AS seats FROM e),
g AS (SELECT *, 137 - sum(seats) OVER () AS rest, row_number() OVER (ORDER BY round(x - seats, 9) DESC, stratum) AS spot FROM f) SELECT stratum, size, seats + (spot <= rest)::INT AS seats FROM g""",
    "s12_draw": """WITH s AS (SELECT lang || '/' || source AS stratum, count(*) AS size FROM documents GROUP BY ALL), e AS (SELECT *, size * 137 / sum(size) OVER () AS x FROM s), f AS (SELECT *, floor(x)::BIGINT AS seats FROM e),
g AS (SELECT *, 137 - sum(seats) OVER () AS rest, row_number() OVER (ORDER BY round(x - seats, 9) DESC, stratum) AS spot FROM f),
q AS (SELECT stratum, seats + (spot <= rest)::INT AS seats FROM g), r AS (SELECT doc_id, lang || '/' || source AS stratum, row_number() OVER (PARTITION BY lang || '/' || source ORDER BY md5('11:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, stratum FROM r JOIN q USING (stratum) WHERE n <= seats""",
    "w12_hold_out": "WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS spot, count(*) OVER () AS n FROM labels) SELECT doc_id, quality, spot <= least(greatest(floor(n * 7e-1), 1), n - 1) AS train FROM r",
    "t01_ewma_fold": """WITH RECURSIVE e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id // 10 AS epoch, CASE WHEN event_type IN ('click', 'purchase') THEN 'hit' WHEN event_type = 'error' THEN 'pollution' ELSE 'other' END AS name,
 least(greatest(CASE WHEN event_type = 'purchase' THEN 1e0 WHEN event_type = 'error' THEN value / 40 ELSE value / 5 END, 0e0), 1e0) AS v FROM events),
f AS (SELECT key, 0::BIGINT AS i, 0e0 AS hit, 0e0 AS pol, 55e-2 AS tau, 0::BIGINT AS frozen, 0::BIGINT AS changes FROM (SELECT DISTINCT user_id AS key FROM events)
 UNION ALL SELECT key, i, hit, pol, tau2, CASE WHEN tau2 <> tau THEN epoch + 60 ELSE frozen END, changes + (tau2 <> tau)::INT FROM (SELECT *, CASE WHEN name <> 'other' AND i >= 20 AND epoch >= 60 AND epoch >= frozen THEN least(greatest(CASE WHEN pol >= 3e-1 THEN tau + 5e-2 WHEN hit >= 7e-1 AND pol <= 1e-1 THEN tau - 5e-2 ELSE tau END, 3e-1), 8e-1) ELSE tau END AS tau2
  FROM (SELECT f.key, e.i, e.epoch, e.name, CASE WHEN e.name = 'hit' THEN 1e-1 * e.v + 9e-1 * f.hit ELSE f.hit END AS hit, CASE WHEN e.name = 'pollution' THEN 1e-1 * e.v + 9e-1 * f.pol ELSE f.pol END AS pol, f.tau, f.frozen, f.changes FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)))
SELECT key, i AS samples, round(hit, 6) AS hit_ewma, round(pol, 6) AS pollution_ewma, round(tau, 6) AS tau, changes AS adjustments FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1""",
    "t03_beta_posterior": """WITH r AS (SELECT user_id AS key, event_type <> 'error' AS hit, 8e-1 ** (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1) AS w FROM events WHERE event_type IN ('click', 'error', 'view')),
s AS (SELECT key, sum(CASE WHEN hit THEN w ELSE 0 END) AS h, sum(CASE WHEN hit THEN 0 ELSE w END) AS x FROM r GROUP BY key), m AS (SELECT *, (h + 1) / (h + x + 2) AS mean, h + x AS n FROM s)
SELECT key, round(h, 6) AS hits, round(x, 6) AS waste, round(mean, 6) AS mean, round((mean + 1645e-3 * 1645e-3 / (2 * n) - 1645e-3 * sqrt(mean * (1 - mean) / n + 1645e-3 * 1645e-3 / (4 * n * n))) / (1 + 1645e-3 * 1645e-3 / n), 6) AS low, mean < 25e-2 AS demoted FROM m""",
    "a12_confusion": """WITH p AS (SELECT n_chars > 600 AS said, quality = 1 AS truth FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND NOT truth) AS tn, count(*) FILTER (NOT said AND truth) AS fn, count(*) AS n FROM p)
SELECT tp, fp, tn, fn, round(100e0 * (tp + tn) / n, 6) AS consistency, round(100e0 * fp / n, 6) AS false_approve, round(100e0 * fn / n, 6) AS false_reject, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""",
    "a14_calibration_bins": """WITH r AS (SELECT least(n_chars / 5e3, 1e0) AS ratio, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(9, floor(ratio * 10))::INT AS bin, count(*) AS n, count(*) FILTER (good) AS good, round(avg(ratio), 6) AS mean_ratio FROM r GROUP BY ALL)
SELECT s.bin::INT AS bin, coalesce(n, 0) AS n, coalesce(good, 0) AS good, mean_ratio, round(CASE WHEN n > 0 THEN 100e0 * good / n ELSE 0e0 END, 6) AS precision FROM (SELECT unnest(range(10)) AS bin) s LEFT JOIN b ON b.bin = s.bin""",
    "r11_judge_chain": """WITH r AS (SELECT n_chars % 4 <> 0 AS same, CASE WHEN n_chars <= 0 THEN 'miss' WHEN n_chars / 3e3 / 9e-1 >= 8e-1 THEN 'hit' WHEN n_chars / 3e3 / 9e-1 >= 55e-2 THEN 'grey' ELSE 'miss' END AS zone, doc_id % 5 AS v FROM documents),
d AS (SELECT same AND zone = 'grey' AS called, CASE WHEN NOT same THEN 'fingerprint_reject' WHEN zone = 'miss' THEN 'zone_reject' WHEN zone = 'hit' THEN 'approved' WHEN v < 3 THEN 'approved' WHEN v = 3 THEN 'declined' ELSE 'fail_closed' END AS decision FROM r) SELECT decision, count(*) AS n, count(*) FILTER (called) AS called FROM d GROUP BY decision""",
    "n08_freshness": """WITH r AS (SELECT event_type, event_id * 300 AS c, 2500000 - event_id * 300 AS age FROM events) SELECT event_type, CASE WHEN c <= 0 OR age < 0 OR age > 1200001 THEN 'miss' WHEN age > 600000 THEN 'grey' ELSE 'hit' END AS zone, count(*) AS n FROM r GROUP BY ALL""",
    "n12_memory_freshness": """WITH r AS (SELECT *, event_id % 500 AS d, CASE user_id % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'user' ELSE 'project' END AS kind FROM events),
a AS (SELECT *, d + CASE WHEN event_id % 9 = 0 THEN 100 ELSE 0 END AS since, CASE event_type WHEN 'view' THEN 90 WHEN 'click' THEN 7 ELSE CASE kind WHEN 'reference' THEN 14 WHEN 'user' THEN 90 ELSE 30 END END AS f, CASE event_type WHEN 'view' THEN 365 WHEN 'click' THEN 30 ELSE CASE kind WHEN 'reference' THEN 45 WHEN 'user' THEN 365 ELSE 180 END END AS c FROM r)
SELECT event_type, kind, CASE WHEN event_id % 17 = 0 AND 500 > d + 30 THEN 'expired' WHEN since > 500 THEN 'current' WHEN event_type = 'signup' THEN 'fresh' WHEN 500 - since <= f THEN 'fresh' WHEN 500 - since <= c THEN 'current' ELSE 'stale' END AS freshness, count(*) AS n FROM a GROUP BY ALL""",
    "n19_budget_actions": "WITH r AS (SELECT c_acctbal / 9e3 AS x FROM customer) SELECT CASE WHEN x >= 1 THEN 'hard_stop' WHEN x >= 9e-1 THEN 'degrade_tier' WHEN x >= 8e-1 THEN 'degrade_inject' WHEN x >= 7e-1 THEN 'halt_prefetch' ELSE 'none' END AS action, count(*) AS n FROM r GROUP BY ALL",
    "n11_wilson": """WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS h, count(*)::DOUBLE AS n FROM events GROUP BY user_id), m AS (SELECT *, (h + 1e0) / (n + 2e0) AS mean FROM r)
SELECT user_id, round(mean, 6) AS mean, round((mean + 1645e-3 * 1645e-3 / (2 * n) - 1645e-3 * sqrt(mean * (1 - mean) / n + 1645e-3 * 1645e-3 / (4 * n * n))) / (1 + 1645e-3 * 1645e-3 / n), 6) AS low FROM m""",
    "w14_keyset_page": """SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' AS pinned, o_orderdate AS activity FROM orders WHERE NOT (o_orderpriority = '1-URGENT') AND (o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey > 100)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
    "a20_topic_rollup": f"""WITH {_S} SELECT scope, topic, greatest((sum(CASE WHEN NOT recovered AND turns_state = 'valid' THEN turns ELSE 0 END))::BIGINT, max(CASE WHEN recovered AND role <> 'covered_copy' AND turns_state = 'valid' THEN turns ELSE 0 END)) AS turns,
 CASE WHEN count(*) FILTER (role <> 'covered_copy' AND turns_state = 'corrupt') > 0 THEN 'corrupt' WHEN count(*) FILTER (role <> 'covered_copy' AND turns_state = 'unknown') > 0 THEN 'unknown' ELSE 'valid' END AS turns_state, max(activity) AS activity,
 CASE WHEN count(*) FILTER (recovered AND role = 'preferred') > 0 THEN 'preferred' WHEN count(*) FILTER (recovered AND role = 'diverged') > 0 THEN 'diverged' WHEN count(*) FILTER (role <> 'covered_copy') = 0 THEN 'recovery_only' ELSE '' END AS recovery,
 CASE WHEN count(*) FILTER (role <> 'covered_copy' AND health = 'corrupt') > 0 THEN 'corrupt' WHEN count(*) FILTER (role <> 'covered_copy' AND health = 'missing') > 0 THEN 'missing' ELSE 'ok' END AS health FROM s GROUP BY scope, topic""",
    "a21_counters": f"WITH {_S} SELECT scope, count(*) AS sessions, count(*) FILTER (recovered) AS recovered, count(*) FILTER (health = 'corrupt') AS corrupt, count(DISTINCT topic) AS topics FROM s GROUP BY scope",
    "w15_preferred_leaf": f"""WITH {_S} SELECT topic, id, turns FROM s WHERE recovered QUALIFY row_number() OVER (PARTITION BY topic ORDER BY CASE role WHEN 'preferred' THEN 2 ELSE 1 END DESC, turns DESC, activity DESC, id) = 1""",
    "j09_lineage": """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey > 0 THEN o_orderkey // 2 END AS parent FROM orders), r AS (SELECT id, id AS root, 0 AS depth FROM o WHERE parent IS NULL UNION ALL SELECT o.id, r.root, r.depth + 1 FROM r JOIN o ON o.parent = r.id WHERE r.depth < 16)
SELECT root, count(*) AS members, max(depth) AS depth FROM r GROUP BY root""",
    "p09_search": "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_name) LIKE '%00001%' AND o_orderstatus IN ('O', 'F')",
    "f13_edit_similarity": "WITH n AS (SELECT n_name, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next_name FROM nation) SELECT n_name, next_name, round(1e0 - levenshtein(n_name, next_name) / greatest(length(n_name), length(next_name)), 6) AS similarity FROM n WHERE next_name IS NOT NULL",
    "r30_listing": f"WITH {_S} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY activity DESC, id) AS rank, id, topic, activity FROM s WHERE health = 'ok' AND NOT recovered QUALIFY rank <= 10",
    "f15_slice_ids": """WITH t AS (SELECT conv_id AS session, role, trim(text) AS content, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS turn_no FROM conversations),
u AS (SELECT session, turn_no, substr(sha256('\\x00\\x01'::BLOB || encode(content)), 1, 16) AS slice_id, 'v-' || substr(sha256(content), 1, 16) AS replay FROM t WHERE role = 'user' AND content <> '') SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY session, slice_id ORDER BY turn_no) = 1""",
    "a15_policy_eval": f"""WITH {_BM25}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM bm), t AS (SELECT query_id, max(score) FILTER (r = 1) AS t1, max(score) FILTER (r = 2) AS t2, max(id) FILTER (r = 1) AS best FROM k WHERE r <= 2 GROUP BY query_id),
z AS (SELECT t1, CASE WHEN t1 <= 0 OR t1 < 45e-2 THEN 'miss' WHEN t1 >= 7e-1 AND t1 - coalesce(t2, 0) >= 55e-2 * t1 THEN 'hit' ELSE 'grey' END AS zone, coalesce(quality, 0) <> 1 AS wrong FROM t LEFT JOIN labels ON doc_id = best)
SELECT count(*) AS queries, count(*) FILTER (t1 >= 20) AS single_reuse, count(*) FILTER (t1 >= 20 AND wrong) AS single_wrong, count(*) FILTER (zone = 'hit') AS zoned_reuse, count(*) FILTER (zone = 'hit' AND wrong) AS zoned_wrong, count(*) FILTER (zone = 'grey') AS grey FROM z""",
    "t02_adaptive": """WITH RECURSIVE e AS (SELECT user_id % 40 AS slice_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS i, event_type = 'error' AND user_id % 3 = 0 AS neg FROM events),
f AS (SELECT slice_id, 0::BIGINT AS i, 0 AS pos, 0 AS neg, 0e0 AS ewma, 0e0 AS tau, false AS relaxed, 0 AS frozen FROM (SELECT DISTINCT slice_id FROM e)
 UNION ALL SELECT slice_id, i, pos, neg, ewma, CASE WHEN ch THEN moved ELSE tau END, CASE WHEN ch THEN NOT up ELSE relaxed END, CASE WHEN ch THEN 60 ELSE greatest(frozen - 1, 0) END
 FROM (SELECT *, frozen = 0 AND pos + neg >= 20 AND moved <> base AS ch FROM (SELECT *, least(greatest(CASE WHEN up THEN base + 5e-2 WHEN ewma < 2e-1 / 2 AND pos >= 20 THEN base - 5e-2 ELSE base END, 3e-1), 9e-1) AS moved FROM (SELECT *, ewma > 2e-1 AS up, CASE WHEN tau > 0 THEN tau ELSE 55e-2 END AS base FROM
 (SELECT f.slice_id, e.i, f.pos + (NOT e.neg)::INT AS pos, f.neg + e.neg::INT AS neg, CASE WHEN e.neg THEN 1e-1 + 9e-1 * f.ewma ELSE 9e-1 * f.ewma END AS ewma, f.tau, f.relaxed, f.frozen FROM f JOIN e ON e.slice_id = f.slice_id AND e.i = f.i + 1)))))
SELECT slice_id, pos, neg, round(ewma, 6) AS neg_ewma, round(tau, 6) AS tau_low, relaxed FROM f QUALIFY row_number() OVER (PARTITION BY slice_id ORDER BY i DESC) = 1""",
    "f_text_forms": f"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_]+'))::INT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_]+')))::INT AS n_terms, sha256(text) AS version,
 {_FNV.format("(lang || ':' || source)")}::BIGINT AS fnv, length(trim(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g')))::INT AS n_normal, lower(lang) || '.' || lower(source) || '.x' AS subject FROM documents""",
}
