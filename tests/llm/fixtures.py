"""Small documents with the awkward cases: nulls, empty and long texts, repeated rows, ties and clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int, secret_spans string"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """A table of documents with extra columns whose names clash with results."""
    rows = [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None, "x", 99, "y")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 500) -> str:
    r = random.Random(seed)
    return " ".join("w%s" % r.randrange(vocabulary) + ("." if r.random() < 0.1 else "") for _ in range(n))
