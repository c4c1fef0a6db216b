"""The registered queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fixity, infill, jaccard, langid, linededup, mil, outliers, paragraphs, secretscan, sharding
from .common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    """The installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.reject_outliers(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages laid out as archives, against a replica in which some records are damaged or lost."""
    pages = _table(spark, sf_dir, "pages")
    damaged = F.when(F.col("page_id") % 53 == 7, F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    laid = materialize(fixity.page_records(pages, damaged), "records")
    second = laid.filter("page_id % 59 <> 11 or page_id is null").select("archive", "offset", F.col("replica_length").alias("length"), F.col("replica_hash").alias("hash"))
    first = laid.select("page_id", "archive", "offset", "length", "hash")
    found = fixity.audit(first.drop("page_id"), second)
    return first.join(found, ["archive", "offset"], "left").select(
        "page_id", "archive", F.col("offset").alias("rec_offset"), F.col("length").alias("rec_length"), F.col("hash").alias("rec_sha256"), F.coalesce("status", F.lit("ok")).alias("status")
    )


OP2_SQL = """
WITH r AS (SELECT page_id, CAST(floor(page_id / 256) AS BIGINT) AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages)
SELECT page_id, archive,
    CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rec_offset,
    CAST(strlen(rec) AS BIGINT) AS rec_length, sha256(rec) AS rec_sha256,
    CASE WHEN page_id % 59 = 11 THEN 'missing' WHEN page_id % 53 = 7 THEN 'corrupt' ELSE 'ok' END AS status
FROM r"""


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), default_tokenizer(), keep_ids=False)


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep_attention=False)


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their declared language, and their source as the host."""
    return langid.identify(_table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in secretscan.RULES if r.base],
        F.sha2(secretscan.span_digest(F.col("secret_spans"), True), 256).alias("base_sha256"),
        secretscan.span_digest(F.col("secret_spans"), False).alias("spans"),
    )


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered_words", "item_words", F.round(F.col("covered_words") / F.col("item_words"), 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.external_shuffle(_table(spark, sf_dir, "documents"), shards=16)
    return dealt.select(
        "doc_id",
        sharding.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=True)
    kept = linededup.apply_runs(F.col("text"), F.col("keep_runs"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


OP11_SQL = """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
d AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT l.doc_id, l.i, l.line, d.k IS NOT NULL AND l.doc_id <> d.keeper AS dropped FROM l LEFT JOIN d ON d.k = l.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM v GROUP BY doc_id"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = infill.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM t),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, n, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_robust_outliers": op1_robust_outliers,
        "op2_merkle_audit": op2_merkle_audit,
        "op3_tree_bpe": op3_tree_bpe,
        "op4_attention_mil": op4_attention_mil,
        "op5_language_fusion": op5_language_fusion,
        "op6_secret_scan": op6_secret_scan,
        "op7_string_tiling": op7_string_tiling,
        "op8_paragraph_minhash": op8_paragraph_minhash,
        "op9_external_shuffle": op9_external_shuffle,
        "op10_jaccard_components": op10_jaccard_components,
        "op11_line_dedup": op11_line_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle_audit": OP2_SQL, "op10_jaccard_components": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
