"""Documents into training tokens: each stage takes what the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontam, jaccard, langid, secretscan
from tidewell.llm.common import shared_dir
from tidewell.llm.queries import default_tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; `lang` is the declared language, `source` the host."""
    return langid.keep_identified(docs, F.col("lang"), F.col("source"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that link at a similarity of 0.75, the one with the smallest id."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    columns = docs.columns
    cleaned = secretscan.redact(secretscan.scan_secrets(docs))
    return cleaned.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the digests of ids and decoded text."""
    return bpe.encode(docs, default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]

#: No SQL expresses the language models and the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
