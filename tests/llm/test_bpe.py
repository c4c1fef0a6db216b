import hashlib

import numpy as np
import pytest

from fixtures import documents, prose
from tidewell.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    None,
    "Hello  world's end",
    prose(1, 4000),
    "a" * 5000,
    " " * 4001 + "x" + "\n" * 3000,
    "x<|endoftext|>" * 400,
    ("é𝄞日本 " * 700) + "​" * 500,
    "don't we'll  \n\n they've " * 300,
    "".join(chr(0x4E00 + i % 3000) for i in range(4000)),
    "12345" * 900 + "!!!" * 800,
]


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_trees_equal_the_library(piece):
    tok = bpe.tokenizer(PATH)
    texts = [t or "" for t in TEXTS]
    for text, got in zip(texts, bpe.encode_texts(texts, PATH, piece_bytes=piece), strict=True):
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids, text[:30]


def test_query_columns(spark):
    got = {r.doc_id: r for r in bpe.encode(documents(spark, TEXTS), PATH, piece_bytes=100, keep_text=True).collect()}
    tok = bpe.tokenizer(PATH)
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, t or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(documents(spark, []), PATH).count() == 0
    assert bpe.encode(documents(spark, ["a", "a"], ids=[None, None]), PATH).count() == 2


def test_quick_encoder_and_decoder_equal_the_library():
    import random

    tok, r = bpe.tokenizer(PATH), random.Random(3)
    assert bpe.vocabulary(PATH)[3] is not None
    letters = "  \n\t\r'stvemldr.,!#$0123456789abcXYZéßÿŁĳ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(3000)]
    got = bpe.encode_texts(texts, PATH)
    assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    odd = [np.array([r.randrange(50257) for _ in range(r.randrange(30))], np.uint32) for _ in range(300)]
    assert bpe.decode_ids(odd, PATH) == [tok.decode(o.tolist(), skip_special_tokens=False) for o in odd]


def test_long_texts_at_production_settings():
    """Equal to the library, and windows stay short even where a text has no break at all."""
    import random

    tok, r = bpe.tokenizer(PATH), random.Random(9)
    letters = "".join(r.choice("abcdefghij") for _ in range(60_000))
    texts = [letters, letters.upper() + "é" * 9000, prose(2, 20_000), "日本" * 9000 + "<|endoftext|>" * 900, "0123456789" * 3000, "=-" * 9000 + " " * 9000 + "'re'll" * 3000, "𝄞" * 6000]
    texts += ["".join(r.choice(["ab", " ", "  ", "\n", "'s", "'", "12", "é", "!!", "…", "<|endoftext|>", "the", "ing"]) for _ in range(12_000)) for _ in range(6)]
    seen, window = [], bpe._Join.window

    def counted(self):
        seen.append(len(w := window(self)))
        return w

    bpe._Join.window = counted
    try:
        got = bpe.encode_texts(texts, PATH)
    finally:
        bpe._Join.window = window
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t[:20]
    assert sum(seen) < sum(len(t.encode()) for t in texts)
