"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query. The index maps every trigram of these queries to the
documents that hold it; postings are intersected per conjunction by a grouped count, and only the candidates are verified
with the expression itself. Rules without a mandatory trigram scan every text. All of it is DataFrame code.

The index covers whole texts and all documents. It keeps postings for the trigrams that some rule asks for: others could
never be looked up, and their number would be that of all text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .trigrams import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `group` of a match must have `least` characters, other matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: str = ""
    base: bool = False


#: The base rules in their contract's order, then the further kinds. Fixed values.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "(?i)", True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "", True),
    Rule("hex", r"[0-9a-f]+", 0, 24, "", True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
BLOCK = 128


def _running(lengths: Column) -> Column:
    """Running sums of an int array in blocks, so that the work per element is bounded however many matches a text has."""
    block = lambda a, b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = lambda a: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")))
    sums = lambda a: F.transform(blocks(a), lambda b: total(block(a, b)))
    return let(
        lengths,
        lambda a: let(
            sums(a),
            lambda s: F.flatten(
                F.transform(
                    blocks(a),
                    lambda b: let(
                        F.struct(total(F.slice(s, F.lit(1), b)).alias("before"), block(a, b).alias("own")),
                        lambda x: F.transform(x["own"], lambda _, i: x["before"] + total(F.slice(x["own"], F.lit(1), i + 1))),
                    ),
                )
            ),
        ),
    )


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule as an array of structs; positions are code points.

    A text is the pieces between the matches and the matches themselves, so a match ends after as many pieces and matches.
    """
    pattern = F.lit(rule.flags + rule.pattern)
    found = F.struct(
        F.split(text, rule.flags + rule.pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )

    def spans(x: Column) -> Column:
        ends = _running(F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["whole"])), x["whole"], lambda p, w: F.char_length(p) + F.char_length(w)))
        rows = F.zip_with(
            F.arrays_zip(x["whole"], x["part"]),
            ends,
            lambda m, e: F.struct((e - F.char_length(m["whole"])).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(rule.kind).alias("kind"), F.char_length(m["part"]).alias("n")),
        )
        kept = F.filter(rows, lambda r: r["n"] >= rule.least)
        return F.transform(kept, lambda r: F.struct(r["start"], r["rank"], r["end"], r["kind"]))

    return let(found, spans).cast(SPAN)


def _screen(text: Column, rule: Rule) -> Column:
    """Whether a rule that scans fully can have a span at all: a run of the least length, for patterns that are one run."""
    run = rule.pattern[:-1] + "{%d,}" % rule.least if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("[") else rule.pattern
    return text.rlike(rule.flags + run)


def _postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram) for each document and trigram it holds, in lower case."""
    held = let(F.lower(F.col("text")), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): the ranks of the rules whose trigram query the document's postings fulfil. Only documents with any."""
    spark = docs.sparkSession
    terms = [(trigram, rank, k, len(term)) for rank, rule in enumerate(rules) for k, term in enumerate(sorted(trigram_query(rule.pattern), key=sorted)) for trigram in sorted(term)]
    if not terms:
        return docs.select("doc_id", F.array().cast("array<int>").alias("rules")).limit(0)
    asked = F.broadcast(spark.createDataFrame(terms, "trigram string, rank int, term int, needed int"))  # as long as the rules
    postings = _postings(docs, sorted({t[0] for t in terms}))
    met = (
        postings.distinct().join(asked, "trigram").groupBy("doc_id", "rank", "term", "needed").agg(F.count(F.lit(1)).alias("held"))
    )
    return met.filter("held = needed").groupBy("doc_id").agg(F.collect_set("rank").alias("rules"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `secret_spans`: array of (start, rank, end, kind) by start, then rank; positions are code points.

    A null text has no spans, nor has an empty one; documents with a null or repeated doc_id are verified each on its own
    text, with the candidate rules of all rows of that id; an empty table gives an empty result. A column of the input named
    secret_spans is replaced.
    """
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c != "secret_spans"]
    found = candidates(docs.select("doc_id", "text"), rules).select(F.col("doc_id").alias("__id"), F.col("rules").alias("__rules"))
    joined = docs.alias("d").join(found, F.col("d.doc_id").eqNullSafe(F.col("__id")), "left")
    text, none = F.coalesce(F.col("d.text"), F.lit("")), F.array().cast(SPAN)
    each = []
    for rank, rule in enumerate(rules):
        possible = _screen(text, rule) if trigram_query(rule.pattern) == ANY else F.array_contains("__rules", rank)
        each.append(F.when(possible, _spans(text, rule, rank)).otherwise(none))
    return joined.select(*columns, F.sort_array(F.concat(*each)).alias("secret_spans"))


def redact(docs: DataFrame, spans: str = "secret_spans", mark: str = "<secret>") -> DataFrame:
    """`text` with every span replaced by `mark`; overlapping spans merge. Drops the span column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
        F.struct(
            F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            x["end"].alias("at"),
        )
    )
    folded = F.aggregate(F.col(spans), state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return docs.withColumn("text", F.when(F.size(spans) > 0, folded).otherwise(F.col("text"))).drop(spans)


def span_digest(spans: Column, base_only: bool, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    bases = F.array(*[F.lit(k) for k, r in enumerate(rules) if r.base])
    kept = F.filter(spans, lambda s: F.array_contains(bases, s["rank"])) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
