"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of PASSAGE words is encoded by a small network over counts of its characters and
words; gated attention weighs the passages, and the weighted sum of their encodings gives the document's score. Only documents
are labelled; the attention learns from these labels which passages tell.

Training happens on the driver, on a bounded sample of labelled documents (SAMPLE for each label, the first by a hash of the
id, so the sample does not depend on the layout). Scoring is a map over all documents with a model of some kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packaging import ship
from . import kernel

PASSAGE, SAMPLE, HIDDEN, GATES, EPOCHS, BATCH = 64, 2000, 24, 12, 40, 128
CUT = 0.7

_CLASSES = 48


def _byte_classes() -> np.ndarray:
    """The class of each byte: letters by group, digits, single marks, white space, bytes of other characters."""
    table = np.full(256, 47, np.int64)
    for k, c in enumerate("aeiounrstlhdc"):
        table[ord(c)] = k
    for c in range(ord("a"), ord("z") + 1):
        table[c] = min(table[c], 13)
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = 14
    for c in range(ord("0"), ord("9") + 1):
        table[c] = 15
    for k, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[]_{|}~"):
        table[ord(c)] = 16 + k
    table[32], table[10] = 45, 46
    return table


_TABLE = _byte_classes()
FEATURES = _CLASSES + 7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts (one row each) and where each text's passages start. A text without words is
    one passage."""
    data, offsets = kernel.bytes_of(texts)
    words = kernel.Words(data, offsets)
    counts = words.counts()
    number = np.maximum(1, -(-counts // PASSAGE))
    at = np.concatenate([[0], np.cumsum(number)])
    rows = int(at[-1])
    place = np.arange(len(words.starts)) - np.repeat(words.at[:-1], counts)
    passage = np.repeat(at[:-1], counts) + place // PASSAGE
    # A byte belongs to the passage of the last word that starts at or before it, within its text.
    text_of = np.repeat(np.arange(len(counts)), np.diff(offsets))
    last = np.cumsum(np.bincount(words.starts, minlength=len(data)) if len(data) else np.zeros(0, np.int64)) - 1
    of_byte = at[:-1][text_of]
    ok = (last >= 0) & (last >= words.at[:-1][text_of])
    of_byte[ok] = passage[last[ok]]
    hist = np.bincount(of_byte * _CLASSES + _TABLE[data], minlength=rows * _CLASSES).reshape(rows, _CLASSES).astype(np.float64)
    size = hist.sum(1, keepdims=True)
    out = np.zeros((rows, FEATURES))
    out[:, :_CLASSES] = np.sqrt(hist / np.maximum(size, 1))
    n = np.bincount(passage, minlength=rows).astype(np.float64)
    hashes = words.hashes()
    m = np.maximum(n, 1)
    base = _CLASSES
    if len(hashes):
        first = data[words.starts]
        final = data[words.starts + words.lengths - 1]
        upper = (first >= 65) & (first <= 90)
        second = data[np.minimum(words.starts + 1, len(data) - 1)]
        shout = upper & (words.lengths > 1) & (second >= 65) & (second <= 90)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        odd = (final < 128) & (_TABLE[final] >= 16) & (_TABLE[final] <= 44) & (final != 44) & (final != 46)
        for k, x in enumerate((upper, shout, same, odd)):
            out[:, base + k] = np.bincount(passage, weights=x, minlength=rows) / m
        out[:, base + 4] = np.log1p(np.bincount(passage, weights=words.lengths, minlength=rows) / m)
        # Words in windows of five that the text holds more than once.
        values, w_at = kernel.shingles(hashes, words.at)
        owner = np.repeat(np.arange(len(counts)), np.diff(w_at))
        key = kernel.mix(values + owner.astype(np.uint64))
        _, inverse, k = np.unique(key, return_inverse=True, return_counts=True)
        start = np.repeat(words.at[:-1], np.diff(w_at)) + np.arange(len(values)) - np.repeat(w_at[:-1], np.diff(w_at))
        out[:, base + 5] = np.bincount(passage[start], weights=k[inverse] > 1, minlength=rows) / m
    out[:, base + 6] = np.log1p(np.repeat(counts, number)) / 5
    return out, at


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score, with the scaling of the features."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and the attention weight of each passage in its bag."""
        _, score, attention, *_ = _forward(self.w, (features - self.mean) / self.scale, at)
        return score, attention


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray):
    sizes = np.diff(at)
    h = np.tanh(x @ w["e"] + w["eb"])
    v, u = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    logit = (v * u) @ w["a"]
    top = np.repeat(np.maximum.reduceat(logit, at[:-1]), sizes)
    weight = np.exp(logit - top)
    weight /= np.repeat(np.add.reduceat(weight, at[:-1]), sizes)
    z = np.add.reduceat(weight[:, None] * h, at[:-1])
    score = _sigmoid(z @ w["c"] + w["cb"])
    return z, score, weight, h, v, u


def train(features: np.ndarray, at: np.ndarray, labels: np.ndarray, seed: int = 3) -> Model:
    """Fit by Adam on the class-balanced log loss."""
    r = np.random.RandomState(seed)
    mean, scale = features.mean(0), features.std(0) + 0.02
    x = (features - mean) / scale
    w = {
        "e": r.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), "eb": np.zeros(HIDDEN),
        "v": r.randn(HIDDEN, GATES) / np.sqrt(HIDDEN), "u": r.randn(HIDDEN, GATES) / np.sqrt(HIDDEN), "a": r.randn(GATES) / np.sqrt(GATES),
        "c": r.randn(HIDDEN) / np.sqrt(HIDDEN), "cb": np.zeros(1),
    }
    m, s, t = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    share = np.clip(labels.mean(), 0.02, 0.98)
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = r.permutation(len(labels))
        for b in range(0, len(order), BATCH):
            bags = order[b : b + BATCH]
            sizes = at[bags + 1] - at[bags]
            own = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(at[bags] - own[:-1], sizes) + np.arange(own[-1])
            xb, y = x[rows], labels[bags]
            z, score, weight, h, v, u = _forward(w, xb, own)
            d = (score - y) * balance[bags] / len(bags)
            g = {"c": z.T @ d, "cb": np.array([d.sum()])}
            dz = np.repeat(d[:, None] * w["c"], sizes, axis=0)
            dh = weight[:, None] * dz
            dw = (h * dz).sum(1)
            dl = weight * (dw - np.repeat(np.add.reduceat(weight * dw, own[:-1]), sizes))
            g["a"] = (v * u).T @ dl
            dv, du = dl[:, None] * w["a"] * u * (1 - v * v), dl[:, None] * w["a"] * v * u * (1 - u)
            g["v"], g["u"] = h.T @ dv, h.T @ du
            dh += dv @ w["v"].T + du @ w["u"].T
            de = dh * (1 - h * h)
            g["e"], g["eb"] = xb.T @ de, de.sum(0)
            t += 1
            for k in w:
                grad = g[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                w[k] = w[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    """Documents that never take part in training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` labelled documents of each quality, none of them held out; None if one label lacks."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    picked = None
    for label in (0, 1):
        some = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    y = np.array([r.quality for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    parts = [passages(part.column("text")) for part in kernel.chunks(pa.RecordBatch.from_pydict({"text": pa.array([r.text for r in rows], pa.string())}))]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return train(np.concatenate([f for f, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]), y)


def score(docs: DataFrame, model: Model | None, keep_attention: bool = True) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from CUT on) and with `keep_attention` the weights
    of its passages.

    Null and empty texts are one empty passage; without a model every score is 0.5. Repeated rows are scored each; a null
    doc_id is not held out; an empty table gives an empty result. Only text is scored; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                features, at = passages(part.column("text"))
                value, attention = model.scores(features, at) if model else (np.full(part.num_rows, 0.5), np.repeat(1 / np.diff(at), np.diff(at)))
                columns = {"doc_id": part.column("doc_id"), "score": pa.array(value)}
                if keep_attention:
                    columns["attention"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(attention))
                yield pa.RecordBatch.from_pydict(columns)

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = rows.mapInArrow(kernel.lean(run), f"doc_id {kind}, score double" + ", attention array<double>" * keep_attention)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), *["attention"] * keep_attention)


def classify(docs: DataFrame, labels: DataFrame, keep_attention: bool = True) -> DataFrame:
    """Fit on `labels` and score all of `docs`."""
    return score(docs, fit(docs, labels), keep_attention)
