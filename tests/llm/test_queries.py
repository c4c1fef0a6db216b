"""The registered operator queries on the smallest tables: SQL twins where there are any, else columns and row counts."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from tidewell.llm import queries  # noqa: E402

FIRST = {
    "op1_robust_outliers": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_tree_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_attention_mil": ["doc_id", "held_out", "score", "predicted"],
    "op5_language_fusion": ["doc_id", "language", "confidence", "kept"],
    "op6_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_external_shuffle": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_jaccard_components": ["doc_id", "n_shingles", "component_id"],
    "op11_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    got = queries.queries()[name](spark, FOLDER)
    rows = got.collect()
    if name in FIRST:
        assert got.columns[: len(FIRST[name])] == FIRST[name]
        assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for t in ("documents", "pages"):
            c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
        want = c.sql(queries.oracle_sql()[name])
        order = [want.columns.index(x) for x in got.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
