import random

import numpy as np

from fixtures import documents, prose
from tidewell.llm import decontam


def brute(doc, item, least):
    """Greedy string tiling as defined: again and again mark the longest common stretch of unmarked words."""
    md, mt, covered = [False] * len(doc), [False] * len(item), []
    while True:
        best = 0
        for t in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while t + k < len(item) and d + k < len(doc) and item[t + k] == doc[d + k] and not mt[t + k] and not md[d + k]:
                    k += 1
                if k > best:
                    best, at = k, (t, d)
        if best < least:
            return covered
        covered.append(best)
        for k in range(best):
            mt[at[0] + k] = md[at[1] + k] = True


def test_tiles_match_brute_force():
    r = random.Random(4)
    for n in range(150):
        v = 3 if n < 30 else 12
        item = [r.randrange(v) for _ in range(r.randrange(1, 40))]
        doc = [r.randrange(v) for _ in range(r.randrange(60))] + item[len(item) // 2 :] + [99] + item[: len(item) // 2]
        own = decontam.tile(np.array(doc, np.uint64) + np.uint64(7), np.array(item, np.uint64) + np.uint64(7), 4)
        want = brute(doc, item, 4)
        assert not want or max(k for _, _, k in own) == want[0]
        if v == 12:
            assert sum(k for _, _, k in own) >= 0.9 * sum(want)
        used_d, used_t = set(), set()
        for t, d, k in own:
            assert item[t : t + k] == doc[d : d + k] and k >= 4
            assert not used_t & set(range(t, t + k)) and not used_d & set(range(d, d + k))
            used_t |= set(range(t, t + k))
            used_d |= set(range(d, d + k))


ITEM = prose(1, 40, 10**6)


def test_exact_near_reordered_and_clean(spark):
    w = ITEM.split()
    moved = " ".join(w[20:] + ["between"] + w[:20])
    near = " ".join("x" if i in (9, 27) else t for i, t in enumerate(w))
    texts = [prose(2, 300) + " " + ITEM + " " + prose(3, 5000), ITEM.upper() + "!", moved, near, " ".join(w[:15]), prose(4, 400), None, "", "ÉTÉ à la mer avec nous"]
    items = spark.createDataFrame([(0, ITEM, 1), (1, None, 1), (2, "", 1), (3, "été à la mer avec nous", 1)], "item_id long, text string, covered_words int")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents(spark, texts), items).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (8, 3)}
    left = decontam.remove_contaminated(documents(spark, texts), items)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7] and left.columns == documents(spark, []).columns


def test_blocks_empty_and_null_ids(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(50 + i, 30, 10**6)) for i in range(9)], "item_id long, text string")
    docs = documents(spark, [prose(50 + i, 30, 10**6) for i in range(9)] * 2, ids=list(range(9)) + [None] * 9)
    whole = sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    parts = sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, items).collect())
    assert whole == parts and len(whole) == 18
    assert decontam.contaminated(documents(spark, []), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_short_items_pieces_of_four_words_and_long_texts(spark):
    words = prose(7, 24, 10**6).split()
    pieces = " zzz ".join(" ".join(words[k : k + 4]) for k in (20, 8, 0, 16, 4, 12))  # reordered in pieces of a seed each
    texts = ["One two, three", "one two three four", "x one two three", "one", "Four little words here", pieces, prose(8, 60_000) + " " + " ".join(words) + " end", "one one one"]
    items = spark.createDataFrame([(0, "one two three"), (1, "one"), (2, "four little words here!"), (3, " ".join(words)), (4, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.covered_words, r.item_words) for r in decontam.contaminated(documents(spark, texts), items).collect()}
    assert got == {(0, 0, 3, 3), (3, 1, 1, 1), (4, 2, 4, 4), (5, 3, 24, 24), (6, 3, 24, 24)}


def test_query_matches_brute_force(spark):
    """All pairs of a small table, tiled as defined."""
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 30))) for _ in range(12)]
    texts = []
    for i in range(60):
        w = items[i % 12].split()
        k = r.randrange(1, len(w))
        texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(20))] + w[k:][: r.randrange(1, 30)] + ["gap"] + w[: r.randrange(0, k + 1)]))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.covered_words for x in decontam.contaminated(documents(spark, texts), table).collect()}
    number = {w: k for k, w in enumerate([*vocabulary, "gap"])}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = ([number[w] for w in t.split()] for t in (text, item))
            covered = sum(brute(a, b, 4))
            if (d, i) in got or 2 * covered >= len(b):  # equally long tiles may be marked in another order
                assert abs(got.get((d, i), 0) - covered) <= 4 and ((d, i) in got or 2 * (covered - 4) < len(b))
    assert len(got) > 20
