"""Fill-in-the-middle: the offsets of a text's lines come from the Split pre-tokenizer of the tokenizers library with isolated
regular-expression matches, which needs no training; how many there are is n, and two ranks among them cut the text.

Only two numbers drawn from the key and the text go to Python and three come back; slicing, ordering and rebuilding are
column expressions. Each row stands for itself: no exchange.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packaging import ship

LINES = "[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


@lru_cache(maxsize=8)
def _splitter(pattern: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), behavior="isolated")


def unit_ends(text: str, pattern: str = LINES) -> list[int]:
    """Where each match of `pattern`, taken left to right, ends, in code points."""
    return [end for _, (_, end) in _splitter(pattern).pre_tokenize_str(text)]


def draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of 8 digits of the hex sha256 of ``seed:key`` as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(pattern: str):
    """n and the code points before the first and the second cut of each text, by the two numbers drawn for it."""

    @F.arrow_udf("n bigint, first bigint, second bigint")
    def cuts(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        found: list[tuple[int, int, int]] = []
        for text, a, b in zip(texts, low, high, strict=True):
            ends = unit_ends(text.as_py(), pattern)
            n = len(ends)
            found.append((n, *(ends[r - 1] if r else 0 for r in sorted((a.as_py() % (n + 1), b.as_py() % (n + 1))))))
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["n", "first", "second"])

    return cuts


def restore(output: Column, form: Column) -> Column:
    """The text from its transformed form: a text with a mark stays plain, so each mark of the others is there once."""
    parts = F.split(output, "<[PSM]>", -1)
    rebuilt = F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
    return rebuilt.when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, pattern: str = LINES) -> DataFrame:
    """Per row of `docs`: its columns, `n` (units of the text), `form`, `prefix_chars`, `middle_chars` (code points, null if
    plain) and `output`.

    `rate` and `spm_rate` are percentages. The form is plain (output is the text) if the text is null or empty, holds one of
    MARKS or is not drawn; psm is ``<P>prefix<S>suffix<M>middle`` and spm ``<S>suffix<P>prefix<M>middle``, where prefix or
    middle or suffix may be empty. A null text is an empty one; a null key draws as the empty string does; rows with equal
    keys draw alike and are cut each by its own text. Texts are read whole, at any length. An empty table gives an empty
    result. Columns of `docs` named as the results are replaced, names starting with ``__`` are reserved.
    """
    ship(docs.sparkSession)
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    body = F.col("__body")
    whole = docs.select(*columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__body"), h1.alias("__h1"), h2.alias("__h2"), h3.alias("__h3"), h4.alias("__h4"))
    cut = whole.withColumn("__cut", _cuts(pattern)("__body", "__h1", "__h2"))
    plain = (body == "") | body.contains(MARKS[0]) | body.contains(MARKS[1]) | body.contains(MARKS[2]) | (F.col("__h3") % 100 >= rate)
    formed = cut.withColumn("form", F.when(plain, "plain").when(F.col("__h4") % 100 < spm_rate, "spm").otherwise("psm"))
    first, second, form = F.col("__cut.first").cast("int"), F.col("__cut.second").cast("int"), F.col("form")
    prefix, middle, suffix = body.substr(F.lit(1), first), body.substr(first + 1, second - first), body.substr(second + 1, F.lit(2**31 - 1))
    p, s, m = map(F.lit, MARKS)
    output = F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(body)
    chars = lambda value: F.when(form != "plain", value)
    return formed.select(*columns, F.col("__cut.n").alias("n"), "form", chars(F.col("__cut.first")).alias("prefix_chars"), chars(F.col("__cut.second") - F.col("__cut.first")).alias("middle_chars"), output.alias("output"))
