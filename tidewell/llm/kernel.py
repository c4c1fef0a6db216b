"""Vectorised word work over Arrow batches: word boundaries, word hashes and five-word shingles of many texts at once.

A word's hash takes its length and then its bytes, eight at a time, and mixes after each step, so that words of up to eight
bytes and equal length never collide and longer ones only by chance; a shingle's hash mixes those of its words, so the white
space between words is no matter. All hashes have 64 bits.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
CHUNK = 1 << 19

_U = np.uint64
#: Odd multipliers. Fixed values.
_STEPS = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_RANGE = np.arange(256)
SPACE = (_RANGE == 0x20) | ((_RANGE >= 0x09) & (_RANGE <= 0x0D))
#: All ASCII but letters and digits.
NO_WORD = (_RANGE < 128) & ~(((_RANGE >= 48) & (_RANGE <= 57)) | ((_RANGE >= 65) & (_RANGE <= 90)) | ((_RANGE >= 97) & (_RANGE <= 122)))
SAME = _RANGE.astype(np.uint8)
LOWER = np.where((_RANGE >= 65) & (_RANGE <= 90), _RANGE + 32, _RANGE).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of about `size` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    lengths = np.diff(offsets_of(batch.column(column)))
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, giving freed memory back to the system at its end: an idle worker otherwise keeps it beside the JVM's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def offsets_of(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each string starts in them (one more for the end)."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of many texts: `starts` and `lengths` in the bytes, and `at`: where each text's words start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SAME, space: np.ndarray = SPACE):
        self.data, self.offsets = table[data], offsets
        inside = ~space[data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        rows = offsets[:-1][offsets[:-1] < len(data)]
        head[rows] |= inside[rows]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:] | head[1:]
        self.inside = inside
        self.starts = np.flatnonzero(head)
        self.lengths = np.flatnonzero(tail) + 1 - self.starts
        self.at = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """One hash per word: a chain over its bytes in groups of eight, each step a bijection of the state."""
        if not len(self.starts):
            return np.zeros(0, _U)
        packed = self.data[self.inside].astype(_U)
        first = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(packed)) - np.repeat(first, self.lengths)
        groups = -(-self.lengths // 8)
        heads = np.flatnonzero((place & 7) == 0)
        lanes = np.bitwise_or.reduceat(packed << ((place & 7) << 3).astype(_U), heads)
        lane = np.cumsum(groups) - groups
        out = mix(self.lengths.astype(_U))
        now, step = np.arange(len(out)), 0
        while len(now):
            out[now] = mix(out[now] ^ lanes[lane[now] + step])
            step += 1
            now = now[groups[now] > step]
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `k` words per text and where each text's windows start; of shorter texts that have words the
    whole sequence is the one window."""
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - k + 1)
        full = np.zeros(n, _U)
        for j in range(k):
            full += hashes[j : j + n] * _STEPS[j]
        full = mix(full)
        sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        out_at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(out_at[-1]), _U)
        long = np.flatnonzero(counts >= k)
        if len(long):
            into = np.repeat(out_at[long] - (np.cumsum(sizes[long]) - sizes[long]), sizes[long]) + np.arange(int(sizes[long].sum()))
            out[into] = full[into - np.repeat(out_at[long], sizes[long]) + np.repeat(at[long], sizes[long])]
        for m in range(1, k):
            short = np.flatnonzero(counts == m)
            if len(short):
                value = np.full(len(short), _U(m))
                for j in range(m):
                    value += hashes[at[short] + j] * _STEPS[j]
                out[out_at[short]] = mix(value)
    return out, out_at


def sort_distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    values = values.copy()
    bounds = at.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    heads = at[:-1][at[:-1] < len(values)]
    keep[heads] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept_before[at]


def text_shingles(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct five-word shingles of each text, where each text's start, and the word counts."""
    words = Words(*bytes_of(texts), LOWER if lower else SAME)
    values, at = shingles(words.hashes(), words.at)
    return *sort_distinct(values, at), words.counts()


def list_array(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list<int64> over flat values, without copies per row."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def sketches(values: np.ndarray, at: np.ndarray, classes: int, least: int = 0) -> pa.Array:
    """How many of each text's values fall into each class of hash, at most 127: list<int8>; null for texts of fewer than
    `least` values."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes >= least)
    row = np.repeat(np.arange(len(full)), sizes[full])
    own = values if len(full) == len(sizes) else values[np.repeat(at[:-1][full] - (np.cumsum(sizes[full]) - sizes[full]), sizes[full]) + np.arange(len(row))]
    counts = np.bincount(row * classes + (own % np.uint64(classes)).astype(np.int64), minlength=len(full) * classes).clip(max=127).astype(np.int8)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, classes, dtype=np.int32)), pa.array(counts))
    if len(full) == len(sizes):
        return lists
    index = np.full(len(sizes), -1)
    index[full] = np.arange(len(full))
    return lists.take(pa.array(index, mask=index < 0))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each stretch of `width` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(values: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """Places at which a value is the least within `radius` places of its own text. What a place is depends on its
    neighbourhood alone, so equal stretches of different texts have the same anchors, save near their ends.

    Of equal values in reach of each other (periodic texts) one in every `radius` + 1 places stays.
    """
    n = np.diff(at)
    if not len(values):
        return np.zeros(0, np.int64)
    shift = (np.arange(len(n)) + 1) * radius
    spaced = np.full(len(values) + (len(n) + 1) * radius, np.iinfo(np.uint64).max, _U)
    to = np.arange(len(values)) + np.repeat(shift, n)
    spaced[to] = values
    low = np.full(len(spaced), np.iinfo(np.uint64).max, _U)
    low[radius : len(spaced) - radius] = sliding_min(spaced, 2 * radius + 1)
    found = np.flatnonzero(values == low[to])
    owner = np.searchsorted(at, found, side="right")
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found) > radius) | (owner[1:] != owner[:-1])
    since = found - np.repeat(found[new], np.diff(np.append(np.flatnonzero(new), len(found))))
    block = since // (radius + 1)
    keep = new.copy()
    keep[1:] |= block[1:] != block[:-1]
    return found[keep]
