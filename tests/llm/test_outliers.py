import random
import re
from collections import Counter

import numpy as np
from fixtures import documents, prose
from tidewell.llm import outliers


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_statistics(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t ", "a b a b a b a b a b a b", "one\ntwo\none\n\n \none", "ä#*$%&|<> \x0b \x1c x y z\xa0q"]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(80))) for _ in range(60)] + [prose(1, 9000) + " " + prose(1, 40)]
    got = {x.doc_id: x for x in outliers.reject_outliers(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(t), t


def test_planted_outliers_in_hot_and_small_groups(spark):
    clean = [prose(i, 60 + i % 40, 5000) for i in range(700)]
    junk = [" ".join(w + "###" for w in prose(9000 + i, 60, 5000).split()) for i in range(12)] + [prose(9500 + i, 60, 5000).upper().replace(" ", "!! ") for i in range(12)]
    langs = ["en"] * 400 + ["de"] * 150 + [None] * 150 + ["en", "de", None] * 8
    sources = ["hot"] * 400 + [f"s{i % 50}" for i in range(150)] + [None] * 150 + ["hot", "s1", None] * 8
    got = {r.doc_id: r.kept for r in outliers.reject_outliers(documents(spark, clean + junk, langs, sources)).collect()}
    assert sum(not got[i] for i in range(700)) <= 7
    assert not any(got[i] for i in range(700, 724))


def test_empty_tiny_and_repeated(spark):
    assert outliers.reject_outliers(documents(spark, [])).count() == 0
    rows = outliers.reject_outliers(documents(spark, [prose(1, 50)] * 3 + [None], ids=[1, 1, None, None])).collect()
    assert sorted(r.kept for r in rows) == [False, True, True, True]


def quantile(x, p):
    return np.sort(x, axis=0)[max(0, int(np.ceil(p * len(x))) - 1)]


def determinant(x):
    """The minimum-covariance-determinant estimate of the rows of x, by plain concentration from the same starts."""
    floor = outliers.FLOOR
    med = quantile(x, 0.5)
    z = np.abs(x - med) / (1.4826 * quantile(np.abs(x - med), 0.5) + floor)
    fit = lambda rows, factor: (rows.mean(0), np.cov(rows.T, bias=True).reshape(x.shape[1], -1) * factor + np.eye(x.shape[1]) * floor**2)

    def step(d):
        m, c = fit(x[d <= quantile(d, outliers.SHARE)], outliers.CONSISTENCY)
        return m, c, np.linalg.slogdet(c)[1]

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    found = [step(distance(*step(d)[:2])) for d in ((z * z).sum(1), z.sum(1), z.max(1))]
    m, c, _ = min(found, key=lambda f: f[2])
    return m, c, distance, step, fit


def test_estimates_match_plain_concentration(spark):
    r = random.Random(8)
    texts = [prose(i, 40 + r.randrange(60), 4000) + " #!" * r.randrange(3) + " A B" * r.randrange(2) for i in range(260)] + ["ab## " * 3 + prose(900 + i, 30, 4000).upper() for i in range(30)]
    langs = ["en"] * 200 + ["de"] * 60 + ["en", "de", None] * 10
    sources = ["hot"] * 150 + [f"s{i % 9}" for i in range(110)] + ["hot", "s1", None] * 10
    got = {x.doc_id: x for x in outliers.reject_outliers(documents(spark, texts, langs, sources)).collect()}
    ids = [i for i in got if not got[i].base_failed]
    x = np.array([[got[i][k] for k in outliers.DIMS] for i in ids])
    keys = [("*", langs[i], (langs[i], sources[i])) for i in ids]
    groups = {g: np.array([g in k for k in keys]) for k in keys for g in k}
    state = {g: determinant(x[rows]) for g, rows in groups.items()}
    now = {g: v[:2] for g, v in state.items()}
    last = {g: np.linalg.slogdet(c)[1] for g, (_, c) in now.items()}
    for _ in range(outliers.MOST):  # all groups go on until none falls
        new = {g: state[g][3](state[g][2](*now[g])) for g in now}
        fall = max(last[g] - new[g][2] for g in now)
        now, last = {g: v[:2] for g, v in new.items()}, {g: v[2] for g, v in new.items()}
        if fall <= outliers.SETTLED:
            break
    final = {}
    for g, rows in groups.items():
        inside = x[rows][state[g][2](*now[g]) <= outliers.CUT]
        final[g] = (*state[g][4](inside, 1.0), len(inside))

    def averaged(g, around):
        m, c, n = final[g]
        share = n / (n + outliers.PRIOR)
        return m * share + around[0] * (1 - share), c * share + around[1] * (1 - share)

    for i, v, (_, lang, own) in zip(ids, x, keys, strict=True):
        of_lang = averaged(lang, final["*"])
        share = final[own][2] / (final[own][2] + outliers.PRIOR)
        d = sum(k * ((v - m) @ np.linalg.inv(c) @ (v - m)) for k, (m, c) in ((share, averaged(own, of_lang)), (1 - share, of_lang)))
        assert abs(got[i].distance - d) <= 1e-6 * max(1, d), i
        assert got[i].kept == (d <= outliers.CUT)
