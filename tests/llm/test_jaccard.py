import random
import re

from fixtures import documents, prose
from tidewell.llm import jaccard


def brute(ids, texts):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((ids[i], len(sets[i]), least[find(i)]) for i in range(len(sets))), key=str)


def edited(text, r, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = "z%d" % r.randrange(10**6)
    return " ".join(w)


def run(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(documents(spark, texts, ids=ids)).collect()]
    assert sorted(got, key=str) == brute(ids, texts)


def test_components_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " ", "one two", "One  two", "one two three", "a b c d e", "A b c\nd e"]
    base = prose(77, 120, 4000)
    texts += [edited(base, r, 0.02 * (i % 5)) for i in range(60)]  # a large near group, partly only linked in chains
    line = prose(5, 25, 4000)
    texts += [line + " " + prose(100 + i, 8 + i % 30, 4000) for i in range(60)]  # a line that many short documents share
    for k in range(25):
        t = prose(1000 + k, 40 + k, 4000)
        texts += [t, edited(t, r, 0.03), edited(t, r, 0.05)]
    texts += [base, base, texts[20]]
    r.shuffle(texts)
    run(spark, texts)


def test_null_and_repeated_ids(spark):
    t, u = prose(1, 50), prose(2, 50)
    run(spark, [t, t, u, u, u + " x", prose(3, 9), None], [5, None, None, None, 9, None, None])


def test_one_id_with_two_texts(spark):
    t, u = prose(1, 50), prose(2, 50)
    got = {(x.doc_id, x.component_id) for x in jaccard.jaccard_components(documents(spark, [t, u, u + " x", t], ids=[5, 5, 7, 3])).collect()}
    assert got == {(5, 3), (5, 5), (7, 5), (3, 3)}


def test_empty_table(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_keep_one(spark):
    t = prose(1, 50)
    assert sorted(x.doc_id for x in jaccard.keep_one(documents(spark, [t, t, prose(2, 50), "", ""])).collect()) == [0, 2, 3, 4]
