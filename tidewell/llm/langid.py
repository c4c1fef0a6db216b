"""Language identification by Bayesian evidence fusion.

Four pieces of evidence, each a likelihood or prior over the languages:

- the text: log-likelihoods of its letter pairs under a model per language, tempered, since pairs are not independent;
- the language that the markup (or a metadata column) declares;
- the suffix of the address, and a language segment in its path;
- the host: how its other documents read, smoothed towards its registered domain and that towards all documents.

The text models are fitted on a bounded sample of documents per declared language (SAMPLE). Everything else is counted over
all documents by grouped aggregation of the text posteriors, so that a declaration or a host is trusted as far as the corpus
bears it out; a document's own share is taken out of its host's counts.

The set of languages is open: beside them stand two models of no language, one of Latin and one of other letters, in which
all pairs of a kind are alike. A text that one of them explains better than each language does, by more than OTHER_PRIOR, is in none of them, whatever is declared: foreign scripts,
noise, languages without a model. Such texts are not counted as evidence for others.

Plan: one Python scan turns texts into a table of a few numbers per document; the rest are aggregates with map-side partial
sums and joins on hosts, which are broadcast only after a check of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packaging import ship
from . import kernel
from .common import broadcast_checked, materialize

SAMPLE, LEAST_DOCUMENTS = 300, 5
#: Languages that are fitted or scored at a time: a bound on memory, not on their number.
AT_ONCE = 64
#: Pairs whose evidence counts in full, and the share of their log-likelihood that is used.
PAIRS, TEMPER = 400, 0.5
#: Pseudo-counts of declarations and suffixes, and strengths of the domain and the global prior.
ALPHA, HOST_PRIOR, DOMAIN_PRIOR = 0.5, 5.0, 20.0
CONFIDENT = 0.5
#: The prior of a text in no modelled language, and the shares of pairs of ASCII letters alone in the two models of no language.
OTHER_PRIOR, OTHER_ASCII = 1e-6, (0.9, 0.1)
UNKNOWN = "und"


def evidence_columns(docs: DataFrame, declared: Column | None, address: Column | None) -> DataFrame:
    """(doc_id, text, declared, suffix, host, domain); what is missing is null.

    The declaration is the `lang` attribute of a leading html tag, else the column given. The suffix is the last label of the
    host, or a two-letter first segment of the path.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("string")
    clean = lambda c: F.when(F.length(F.trim(c)) > 0, F.regexp_extract(F.lower(F.trim(c)), "^([a-z0-9]+)", 1))
    markup = F.when(text.rlike("^\\s*<"), F.nullif(F.regexp_extract(text, "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    address = none if address is None else address.cast("string")
    host = F.nullif(F.lower(F.regexp_extract(address, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1)), F.lit(""))
    segment = F.nullif(F.regexp_extract(address, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    suffix = F.coalesce(F.lower(segment), F.when(host.contains("."), F.element_at(F.split(host, "\\."), -1)))
    domain = F.array_join(F.slice(F.reverse(F.split(host, "\\.")), 1, 2), ".")
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.lower(markup), none if declared is None else clean(declared)).alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain"))


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring bytes of letters (others and both ends are blanks) in lower case, and where each text's start."""
    data, offsets = kernel.bytes_of(pc.binary_join_element_wise(" ", pc.utf8_lower(texts), " ", ""))
    letters = np.where(((data >= 97) & (data <= 122)) | (data >= 128), data, np.uint8(32))
    codes = letters[:-1].astype(np.int32) * 256 + letters[1:] if len(data) > 1 else np.zeros(0, np.int32)
    keep = codes != 32 * 256 + 32
    ends = offsets[1:-1] - 1
    keep[ends[(ends >= 0) & (ends < len(codes))]] = False  # pairs across two texts
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[np.clip(offsets - np.concatenate([[0], np.ones(len(offsets) - 1, np.int64)]), 0, len(codes))]


def fit_texts(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each pair of bytes in each, from `sample` documents of each declared language.

    The sample takes the first by a hash of the id; the limit bounds it where ids repeat. Languages are all those declared by
    LEAST_DOCUMENTS documents or more.
    """
    counts = rows.filter("declared is not null and text <> ''").groupBy("declared").agg(F.count(F.lit(1)).alias("k"))
    languages = sorted(r.declared for r in counts.filter(F.col("k") >= LEAST_DOCUMENTS).collect())
    table = np.zeros((len(languages), 1 << 16), np.float32)
    for at in range(0, len(languages), AT_ONCE):
        table[at : at + AT_ONCE] = _fit_some(rows, languages[at : at + AT_ONCE], sample)
    return languages, table


def _fit_some(rows: DataFrame, languages: list[str], sample: int) -> np.ndarray:
    table = np.full((len(languages), 1 << 16), 0.02)
    order = F.xxhash64("doc_id")
    own = rows.filter(F.col("declared").isin(languages) & (F.col("text") != "")).withColumn("h", order)
    first = own.select("declared", "h").withColumn("at", F.row_number().over(Window.partitionBy("declared").orderBy("h"))).filter(F.col("at") <= sample)
    some = own.join(F.broadcast(first.select("declared", "h").distinct()), ["declared", "h"], "left_semi").select("declared", "text")
    texts: dict[str, list[str]] = {}
    for r in some.limit(2 * sample * max(1, len(languages))).collect():
        texts.setdefault(r.declared, []).append(r.text)
    for i, language in enumerate(languages):
        table[i] += _counts(pa.array(texts.get(language, []), pa.string()))
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _counts(texts: pa.Array) -> np.ndarray:
    """Pairs of the texts. Texts that the other half of the sample does not explain are left out, so that foreign ones do not
    become part of the language, unless these are most."""
    codes, at = _pairs(texts)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    half, none = np.arange(len(n)) % 2, _no_language()
    own_log, none_log = np.zeros(len(n)), np.max([np.bincount(owner, x[codes], len(n)) for x in none], axis=0)
    for h in (0, 1):
        own = half[owner] == h
        table = np.bincount(codes[~own], minlength=1 << 16) + 0.02
        own_log += np.bincount(owner[own], np.log(table / table.sum())[codes[own]], len(n))
    good = (own_log - none_log) * TEMPER * np.minimum(n, PAIRS) / np.maximum(n, 1) >= math.log(OTHER_PRIOR)
    return np.bincount(codes[good[owner]] if 2 * good.sum() >= len(n) else codes, minlength=1 << 16)


def _no_language() -> np.ndarray:
    """The log-probabilities of each pair in no language, one row for each share of OTHER_ASCII: pairs of ASCII letters and
    blanks are alike, and so are all others."""
    symbol = np.arange(256)
    plain = ((symbol >= 97) & (symbol <= 122)) | (symbol == 32)
    letter = plain | (symbol >= 128)
    ascii_pairs = (plain[:, None] & plain).reshape(-1)
    others = (letter[:, None] & letter).reshape(-1) & ~ascii_pairs
    table = np.zeros((len(OTHER_ASCII), 1 << 16), np.float32)
    for i, share in enumerate(OTHER_ASCII):
        table[i, ascii_pairs] = np.log(share / (ascii_pairs.sum() - 1))  # but two blanks
        table[i, others] = np.log((1 - share) / others.sum())
    return table


def _text_evidence(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """Adds `pairs` (letter pairs), `loglik`: the tempered log-likelihood of the text in each language, and `other`: that in
    none."""
    k = len(languages)
    every = np.concatenate([table, _no_language()])
    blocks = [np.ascontiguousarray(every[at : at + AT_ONCE].T) for at in range(0, len(every), AT_ONCE)]
    width = len(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                codes, at = _pairs(part.column("text"))
                n = np.diff(at)
                sums = np.zeros((len(n), width))
                full = np.flatnonzero(n)
                for b, flat in enumerate(blocks if len(full) else []):
                    sums[full, b * AT_ONCE : (b + 1) * AT_ONCE] = np.add.reduceat(flat[codes], at[:-1][full], axis=0, dtype=np.float64)
                scaled = sums * (TEMPER * np.minimum(n, PAIRS) / np.maximum(n, 1))[:, None]
                columns = {k: part.column(k) for k in ("doc_id", "declared", "suffix", "host", "domain")}
                columns["pairs"] = pa.array(n)
                columns["loglik"] = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * k).astype(np.int32)), pa.array(scaled[:, :k].reshape(-1)))
                columns["other"] = pa.array(scaled[:, k:].max(1))
                yield pa.RecordBatch.from_pydict(columns)

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(kernel.lean(run), f"doc_id {kind}, declared string, suffix string, host string, domain string, pairs long, loglik array<double>, other double")


def _normal(logs: Column) -> Column:
    """Probabilities of an array of log weights."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def _sums(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Per value of `key`: the sums of the text posteriors, as an array."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("soft")[i]) for i in range(k)]).alias(f"{key}_sums"))


def identify(docs: DataFrame, declared: Column | None = None, address: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row of `docs`: doc_id, language, confidence (its posterior) and kept: whether a language was identified, that is
    the text holds letters, a language explains it better than the models of none, and the posterior is CONFIDENT or more; else
    the language is "und".

    Null and empty texts, and texts without letters, are not identified; their confidence, and that of texts in no modelled
    language, is 0. Missing declarations, addresses and hosts are no
    evidence. Repeated rows are judged alike; without any declared language nothing is identified; an empty table gives an
    empty result. Of the input only doc_id, text and the given columns are read.
    """
    rows = evidence_columns(docs, declared, address)
    languages, table = fit_texts(rows, sample)
    if not languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    k = len(languages)
    seen = materialize(_text_evidence(rows, languages, table), "text-evidence")
    seen = seen.withColumn("explained", (F.col("pairs") > 0) & (F.array_max("loglik") >= F.col("other") + math.log(OTHER_PRIOR)))
    seen = seen.withColumn("soft", F.when(F.col("explained"), _normal(F.col("loglik"))).otherwise(F.array(*[F.lit(0.0)] * k)))

    total = [x or 0.0 for x in seen.agg(*[F.sum(F.col("soft")[i]) for i in range(k)]).first()]
    share = [(x + 1) / (sum(total) + k) for x in total]
    tables = {key: materialize(_sums(seen, key, k), key) for key in ("declared", "suffix", "host", "domain")}
    kinds = {key: max(1, tables[key].count()) for key in ("declared", "suffix")}
    joined = seen
    for key, t in tables.items():
        joined = joined.join(broadcast_checked(t, 64 + 8 * k), key, "left")

    def weight(i: int) -> Column:
        """The log posterior of language i, up to a constant."""
        log = F.col("loglik")[i]
        for key in ("declared", "suffix"):
            own = F.col(f"{key}_sums")[i] - F.col("soft")[i]
            log = log + F.coalesce(F.log((F.greatest(own, F.lit(0.0)) + ALPHA) / (F.lit(total[i]) + ALPHA * kinds[key])), F.lit(0.0))

        def smoothed(key: str, strength: float, prior: Column) -> Column:
            size = F.aggregate(f"{key}_sums", F.lit(0.0), lambda s, x: s + x) - F.aggregate("soft", F.lit(0.0), lambda s, x: s + x)
            own = F.greatest(F.col(f"{key}_sums")[i] - F.col("soft")[i], F.lit(0.0))
            return F.coalesce((own + prior * strength) / (F.greatest(size, F.lit(0.0)) + strength), prior)

        return log + F.log(smoothed("host", HOST_PRIOR, smoothed("domain", DOMAIN_PRIOR, F.lit(share[i]))))

    fused = joined.select("doc_id", "explained", F.array(*[weight(i) for i in range(k)]).alias("logs"))
    fused = fused.select("doc_id", "explained", _normal(F.col("logs")).alias("p"))
    best = F.array_max("p")
    kept = F.col("explained") & (best >= CONFIDENT)
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("p", best).cast("int"))
    return fused.select("doc_id", F.when(kept, name).otherwise(F.lit(UNKNOWN)).alias("language"), F.when(F.col("explained"), best).otherwise(F.lit(0.0)).alias("confidence"), kept.alias("kept"))


def keep_identified(docs: DataFrame, declared: Column | None = None, address: Column | None = None) -> DataFrame:
    """`docs` without the rows whose language is not identified. Each row is judged by its own text and evidence; ids may be
    null or repeated."""
    missing = F.lit("")
    seen = [F.coalesce(F.lit(None) if c is None else c.cast("string"), missing) for c in (F.col("text"), declared, address)]
    key = F.struct(F.col("doc_id"), F.unhex(F.md5(F.concat_ws("\x00", *seen).cast("binary"))).alias("digest"))
    found = identify(docs.withColumn("doc_id", key), declared, address).filter("kept").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.digest").alias("__digest")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (key["digest"] == found["__digest"]), "left_semi")
