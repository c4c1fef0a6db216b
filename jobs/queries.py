"""The jobs as registered queries: each runs twice over the whole table into a folder of its own and gives back its output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.usage import SQL as _USAGE

from . import slice_ingest, usage_rollup


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; a temporary folder only where no shared one is set, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewell-jobs-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_slice_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations with their slices; the second run finds nothing new."""
    folder = _folder(spark, "job1_slice_ingest")
    for _ in range(2):
        # A pattern, since the table may be a folder or one file, and streams take a file by pattern only.
        slice_ingest.run(spark, f"{sf_dir}/conversations.parque[t]", f"{folder}/out", f"{folder}/checkpoint")
    found = slice_ingest.read_output(spark, f"{folder}/out")
    return found.select("conv_id", "turn", "kind", "slice_id", "content_version", "n_chars", "n_terms", F.sha2("content", 256).alias("content_sha256"))


def job2_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all events with costs; the second run is above the mark and finds nothing."""
    folder = _folder(spark, "job2_usage_rollup")
    for _ in range(2):
        usage_rollup.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/mark")
    return usage_rollup.read_output(spark, f"{folder}/out")


QUERIES = {f.__name__: f for f in (job1_slice_ingest, job2_usage_rollup)}
SQL = {
    "job1_slice_ingest": r"""WITH t AS (SELECT conv_id, turn, role || '_text' AS kind, CASE role WHEN 'user' THEN '\x00\x01'::BLOB ELSE '\x03\x01'::BLOB END AS head, trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g')) AS c
    FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '[\p{L}\p{Nd}_]'))
SELECT conv_id, turn, kind, substr(sha256(head || encode(c)), 1, 16) AS slice_id, sha256(c) AS content_version, length(c)::INT AS n_chars, len(regexp_extract_all(lower(c), '[\p{L}\p{Nd}_]+'))::INT AS n_terms, sha256(c) AS content_sha256 FROM t""",
    "job2_usage_rollup": f"""WITH a AS ({_USAGE["a07_rollup"]}), p AS (SELECT *, CASE WHEN instr(model, '/') > 1 THEN split_part(model, '/', 1) ELSE 'default' END AS provider FROM a)
SELECT *, round(((prompt - cache_hit) * CASE provider WHEN 'v1' THEN 5e-1 ELSE 28e-2 END + cache_hit * CASE provider WHEN 'v1' THEN 5e-2 ELSE 28e-3 END + completion * CASE provider WHEN 'v1' THEN 15e-1 ELSE 42e-2 END) / 1e6, 9) AS cost FROM p""",
}
