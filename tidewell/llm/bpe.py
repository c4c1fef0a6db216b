"""BPE encoding by tree concatenation.

A long text is cut into halves until the pieces are short; the pieces of all texts of a batch are encoded together, and
neighbours are joined pairwise up the tree. At each join the ids near the cut may be wrong, so a window around it is encoded
anew and grown until it shares a token, at the same place, with each side; the ids beyond these tokens stay.

Why that is exact: a sequence of tokens is the byte-pair encoding of its pretoken if and only if each two neighbours are what
their own bytes encode to, for merges in the order of their ids. A side and the window that share a token can thus change over
at it: all neighbours of the result are neighbours in one of them. Where a pretoken ends is a matter of the characters behind
the shared token, which the window has, as it reaches further than any lookahead or special token. A join thus gives what
encoding the joined text at once would give, and so does the root. Long runs without any break need no larger windows.

Texts are independent: nothing is shuffled, a batch's memory is bounded, and a lost task is just run again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.packaging import ship
from . import kernel

#: Texts of more bytes are cut.
PIECE = 1 << 12
#: Bytes of a join's first window on each side.
WINDOW = 64
#: Characters of texts that are encoded together.
BATCH = 1 << 21


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, with truncation and padding off."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Characters on which all Unicode tables and both regular-expression engines agree: printable ASCII, tab, line ends and
#: Latin letters with marks.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00c0-\\u017f]*")
#: How a byte-level vocabulary splits a text into pretokens. Fixed value.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, object, bool]:
    """All tokens' bytes end to end, each id's start and length in them, a quicker encoder of the same vocabulary, and whether the
    file is a plain byte-level BPE in which each merge makes the next higher id, so that ids rank the merges.

    Without that there is no quicker encoder (None), and texts are encoded whole.
    """
    tok, alphabet = tokenizer(path), _byte_alphabet()
    spec = json.loads(tok.to_str())
    size = tok.get_vocab_size(with_added_tokens=True)
    texts = [tok.id_to_token(i) or "" for i in range(size)]
    as_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in texts]
    lengths = np.array([len(b) for b in as_bytes], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
    base = size - len(tok.get_added_tokens_decoder()) - len(merges)
    pre = spec["pre_tokenizer"] or {}
    plain = spec["model"]["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["post_processor"] is None
    plain = plain and not spec["model"].get("ignore_merges") and base == 256 and all(texts[256 + k] == a + b for k, (a, b) in enumerate(merges))
    quick = None
    if plain:
        try:
            import tiktoken

            quick = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks={as_bytes[i]: i for i in range(256 + len(merges))}, special_tokens={})
        except ImportError:
            pass
    return np.frombuffer(b"".join(as_bytes), np.uint8), starts, lengths, quick, plain


class Piece:
    """The bytes of a text with its ids and where each one starts in them."""

    __slots__ = ("data", "ids", "starts")

    def __init__(self, data: bytes, ids: np.ndarray, starts: np.ndarray):
        self.data, self.ids, self.starts = data, ids, starts

    @classmethod
    def of(cls, data: bytes, ids: np.ndarray, lengths: np.ndarray) -> Piece:
        n = lengths[ids]
        return cls(data, ids, np.cumsum(n) - n)


def _forward(data: bytes, at: int) -> int:
    """The first place from `at` on where a character starts."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _shared(a: Piece, first: int, b: Piece, shift: int, low: int, high: int) -> tuple[int, int] | None:
    """The numbers of the first token that `a` (from token `first` on) and `b` both have at one place, `b` lying `shift` behind;
    the token lies between the places `low` and `high` of `a`."""
    own = a.starts[first : int(np.searchsorted(a.starts, high))]
    at = np.searchsorted(own, low)
    own = own[at:]
    if not len(own):
        return None
    place = np.searchsorted(b.starts, own - shift)
    inside = place < len(b.starts)
    ends = np.append(own[1:], len(a.data))[: len(own)]
    hit = inside & (ends <= high)
    hit[inside] &= (b.starts[place[inside]] == own[inside] - shift) & (b.ids[place[inside]] == a.ids[first + at :][: len(own)][inside])
    found = np.flatnonzero(hit)
    return (first + int(at) + int(found[0]), int(place[found[0]])) if len(found) else None


class _Join:
    """A join of two neighbours: asks for windows of growing size until both sides agree with one."""

    def __init__(self, left: Piece, right: Piece, reach: int):
        self.left, self.right, self.reach, self.size, self.done = left, right, reach, WINDOW + reach, None

    def window(self) -> bytes:
        left, right = self.left, self.right
        token = int(np.searchsorted(left.starts, len(left.data) - self.size, side="right")) - 1
        while token > 0 and left.data[left.starts[token]] & 0xC0 == 0x80:
            token -= 1
        self.token = max(0, token)
        self.start = int(left.starts[self.token]) if token > 0 else 0
        self.stop = _forward(right.data, min(len(right.data), self.size))
        return left.data[self.start :] + right.data[: self.stop]

    def take(self, piece: Piece) -> None:
        """Accept the window if it shares a token with the left side well before the cut and one with the right side well before
        its own end."""
        left, right, cut = self.left, self.right, len(self.left.data)
        first = (0, 0) if not self.start else _shared(left, self.token, piece, self.start, self.start, cut - self.reach)
        last = None
        if self.stop == len(right.data):
            last = (len(right.ids), len(piece.ids))  # nothing of the right side is kept
        elif first:
            last = _shared(right, 0, piece, self.start - cut, 0, self.stop - self.reach)
        if not first or not last or first[1] > last[1]:
            self.size *= 2
            return
        (a, k), (b, m) = first, last
        self.done = Piece(
            left.data + right.data,
            np.concatenate([left.ids[:a], piece.ids[k:m], right.ids[b:]]),
            np.concatenate([left.starts[:a], piece.starts[k:m] + self.start, right.starts[b:] + cut]),
        )


def encode_texts(texts: list[str], path: str, piece_bytes: int = PIECE) -> list[np.ndarray]:
    """The ids of each text, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Texts of PLAIN characters without special tokens take the quicker encoder, all others the tokenizer itself.
    """
    tok, (_, _, lengths, quick, plain) = tokenizer(path), vocabulary(path)
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    reach = max([16, *(len(x.encode()) + 2 for x in names)])

    def encode(parts: list[str], easy: list[bool]) -> list[np.ndarray]:
        hard = iter(tok.encode_batch_fast([p for p, e in zip(parts, easy, strict=True) if not e], add_special_tokens=False))
        return [quick.encode_to_numpy(p, disallowed_special=()) if e else np.array(next(hard).ids, np.uint32) for p, e in zip(parts, easy, strict=True)]

    easy = [quick is not None and PLAIN.fullmatch(t) is not None and not any(x in t for x in names) for t in texts]
    level: list[list] = []
    for text in texts:
        data = text.encode()
        parts = 1
        while plain and len(data) > parts * piece_bytes:
            parts *= 2
        cuts = [_forward(data, len(data) * k // parts) for k in range(parts + 1)]
        level.append([data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    ids = iter(encode([p.decode() for parts in level for p in parts], [e for e, parts in zip(easy, level, strict=True) for _ in parts]))
    level = [[Piece.of(p, next(ids), lengths) if len(parts) > 1 else Piece(p, next(ids), None) for p in parts] for parts in level]
    while any(len(p) > 1 for p in level):
        joins = [[_Join(a, b, reach) for a, b in zip(p[::2], p[1::2], strict=True)] if len(p) > 1 else [] for p in level]
        open_ = [(j, e) for own, e in zip(joins, easy, strict=True) for j in own]
        while open_:
            windows = [j.window() for j, _ in open_]
            for (j, _), data, got in zip(open_, windows, encode([w.decode() for w in windows], [e for _, e in open_]), strict=True):
                j.take(Piece.of(data, got, lengths))
            open_ = [x for x in open_ if x[0].done is None]
        level = [[j.done for j in own] if own else p for own, p in zip(joins, level, strict=True)]
    return [root.ids for (root,) in level]


def decode_ids(ids: list[np.ndarray], path: str) -> list[str]:
    """What Tokenizer.decode(ids, skip_special_tokens=False) gives for each: the tokens' bytes, as UTF-8."""
    table, starts, lengths, _, plain = vocabulary(path)
    if not plain:
        return tokenizer(path).decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
    out = []
    for own in ids:
        n = lengths[own]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[own] - (ends - n), n)
        out.append(table[at].tobytes().decode("utf-8", "replace"))
    return out


def _slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about BATCH characters."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= BATCH:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, path: str, piece_bytes: int = PIECE, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256
    (of the decoded text), with `keep_ids` the ids and with `keep_text` the decoded text.

    A null text is empty and has no ids; each row stands for itself, so null or repeated doc_ids are no matter; an empty
    table gives an empty result. Other columns are not read. `path` is a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            for part in _slices(texts):
                tokens = encode_texts(texts[part], path, piece_bytes)
                decoded = decode_ids(tokens, path)
                columns = {
                    "doc_id": ids[part],
                    "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                }
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens).astype(np.int32)))
                if keep_text:
                    columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return docs.select("doc_id", "text").mapInArrow(kernel.lean(run), schema)
