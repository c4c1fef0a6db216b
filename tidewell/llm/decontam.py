"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of words (letters and digits in lower case). Documents that share a seed of SEED
words with an item are tiled with it: the longest common stretches are marked first, each word at most once, found by
Karp-Rabin hashes of falling lengths. The share of an item's words that tiles cover tells contamination; as tiles may lie in
any order, reordered passages are found too.

The items are the stated query set: they go to the executors in blocks of at most BLOCK_BYTES, one pass over the documents
for each block. Documents are read in one scan and never shuffled; a document's work is bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packaging import ship
from . import kernel

SEED, TILE, COVERAGE = 4, 4, 0.5
BLOCK_BYTES = 8 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


class _Windows:
    """Karp-Rabin hashes of all windows of any length of one sequence."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _B, np.uint64)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:-1])])
            self.powers = powers
        self.n = len(words)

    def hashes(self, size: int) -> np.ndarray:
        """Equal windows have equal hashes: sums are brought to the same power."""
        count = max(0, self.n - size + 1)
        with np.errstate(over="ignore"):
            return (self.sums[size : size + count] - self.sums[:count]) * self.powers[: self.n + 1][::-1][:count] if count else np.zeros(0, np.uint64)


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` have no marked word."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[size:] == sums[:-size]


def tile(doc: np.ndarray, item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in item, start in doc, length), longest first."""
    taken_d, taken_t = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    shared = np.isin(doc, item)
    if shared.sum() < least:
        return []
    # Only stretches of shared words can match; what lies between is left out, one stop word for each gap.
    near = shared | np.concatenate([[False], shared[:-1]])
    place = np.flatnonzero(near)
    words = np.where(shared, doc, np.uint64(0))[place]
    taken_d = ~shared[place]
    tiles, size = [], max(least, min(32, len(item)))
    powers_of = max(len(words), len(item))
    pad = lambda x: np.concatenate([x, np.zeros(powers_of - len(x), np.uint64)])  # noqa: E731  equal lengths: comparable hashes
    wd, wt = _Windows(pad(words)), _Windows(pad(item))
    while True:
        hd, ht = wd.hashes(size)[: max(0, len(words) - size + 1)], wt.hashes(size)[: max(0, len(item) - size + 1)]
        found, longest = [], 0
        if len(hd) and len(ht):
            free_t = np.flatnonzero(_free(taken_t, size))
            by_hash: dict[int, list[int]] = {}
            for t in free_t.tolist():
                by_hash.setdefault(int(ht[t]), []).append(t)
            hits = np.flatnonzero(_free(taken_d, size) & np.isin(hd, ht[free_t])) if len(free_t) else []
            for d in hits:
                for t in by_hash.get(int(hd[d]), ()):
                    if d and t and words[d - 1] == item[t - 1] and not taken_d[d - 1] and not taken_t[t - 1]:
                        continue  # part of a longer one
                    k = 0
                    while d + k < len(words) and t + k < len(item) and words[d + k] == item[t + k] and not taken_d[d + k] and not taken_t[t + k]:
                        k += 1
                    if k >= size:
                        found.append((k, -t, -int(d)))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k, t, d in sorted(found, reverse=True):
            t, d = -t, -d
            if not taken_t[t : t + k].any() and not taken_d[d : d + k].any():
                taken_t[t : t + k] = taken_d[d : d + k] = True
                tiles.append((t, int(place[d]), k))
        if found:
            continue  # what was partly covered may hold another match of this length
        if size == least:
            return tiles
        size = max(least, size // 2)


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = kernel.Words(*kernel.bytes_of(pc.utf8_lower(texts)), kernel.SAME, kernel.NO_WORD)
    return words.hashes(), words.at


def _judge(items: list[tuple[int, str]], coverage: float) -> Callable[[pa.RecordBatch], dict[str, list]]:
    """A function that finds the rows of a batch that hold an item: row, item_id, covered, words, tiles."""
    hashes, at = _hashes(pa.array([t for _, t in items], pa.string()))
    sequences = [hashes[a:b] for a, b in zip(at, at[1:], strict=False)]
    seeds, seeds_at = kernel.shingles(hashes, at, SEED)
    order = np.argsort(seeds, kind="stable")
    keys, owners = seeds[order], np.repeat(np.arange(len(items)), np.diff(seeds_at))[order]
    bits = 20
    mask = np.zeros(1 << bits, bool)
    mask[keys >> np.uint64(64 - bits)] = True
    names = [i for i, _ in items]

    def judge(part: pa.RecordBatch) -> dict[str, list]:
        words, at = _hashes(part.column("text"))
        own, own_at = kernel.shingles(words, at, SEED)
        likely = np.flatnonzero(mask[own >> np.uint64(64 - bits)])
        low, high = np.searchsorted(keys, own[likely], "left"), np.searchsorted(keys, own[likely], "right")
        hit = high > low
        rows = np.searchsorted(own_at, likely[hit], "right") - 1
        pairs = {(int(r), int(o)) for r, a, b in zip(rows, low[hit], high[hit], strict=True) for o in owners[a:b]}
        out = {k: [] for k in ("row", "item_id", "covered", "words", "tiles")}
        for r, o in sorted(pairs):
            item = sequences[o]
            tiles = tile(words[at[r] : at[r + 1]], item, min(TILE, len(item)))
            covered = sum(k for _, _, k in tiles)
            if covered >= coverage * len(item):
                for name, x in zip(out, (r, names[o], covered, len(item), [{"item_start": t, "doc_start": d, "length": k} for t, d, k in tiles]), strict=True):
                    out[name].append(x)
        return out

    return judge


def _pass(docs: DataFrame, items: list[tuple[int, str]], coverage: float) -> DataFrame:
    judge = _judge(items, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch):
                out = judge(part)
                tile_type = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(out["row"], pa.int64())),
                        "item_id": pa.array(out["item_id"], pa.int64()),
                        "covered_words": pa.array(out["covered"], pa.int64()),
                        "item_words": pa.array(out["words"], pa.int64()),
                        "tiles": pa.array(out["tiles"], tile_type),
                    }
                )

    ship(docs.sparkSession)
    return docs.mapInArrow(kernel.lean(run), "doc_id long, item_id long, covered_words long, item_words long, tiles array<struct<item_start:int,doc_start:int,length:int>>")


def _clean(docs: DataFrame, items: list[tuple[int, str]], coverage: float) -> DataFrame:
    """The rows of `docs` that hold none of the items; each row is judged by its own text."""
    judge = _judge(items, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            filled = batch.set_column(at, "text", pc.fill_null(batch.column(at), ""))
            start = 0
            for part in kernel.chunks(filled):
                keep = np.ones(part.num_rows, bool)
                keep[judge(part)["row"]] = False
                yield batch.slice(start, part.num_rows).filter(pa.array(keep))
                start += part.num_rows

    ship(docs.sparkSession)
    return docs.mapInArrow(kernel.lean(run), docs.schema)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with a text, in blocks of about BLOCK_BYTES; at least one block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("text <> ''")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, tiles): documents whose tiles cover at least `coverage` of an item.

    Null or empty texts and items share no seed; an item of fewer than SEED words, which may be any phrase, is found where a
    document's text is that item. Of equally long tiles the one that starts last in the item, then in the document, is marked first. Repeated rows give repeated results; rows with a null doc_id or item_id keep it; empty tables give an empty
    result. Only doc_id, text and item_id are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = None
    for block in _blocks(benchmark):
        found = _pass(rows, block, coverage)
        out = found if out is None else out.union(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """`docs` without the rows whose text holds an item; ids play no part, so null and repeated ones are no matter."""
    for block in _blocks(benchmark):
        docs = _clean(docs, block, coverage)
    return docs
