import zlib

import numpy as np
import pyarrow as pa

from fixtures import documents, prose
from tidewell.llm import mil


def corpus():
    texts, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        t = prose(i, 150)
        if not good:  # only one passage of several is bad
            w = t.split()
            w[70:120] = [x + "$$$" for x in w[70:120]]
            t = " ".join(w)
        texts.append(t)
        labels.append(int(good))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    docs = documents(spark, texts + [None, "", texts[1]], ids=[*range(400), 400, 401, None])
    known = spark.createDataFrame([(i, q, 0, "x") for i, q in enumerate(labels)], "doc_id long, quality int, toxic int, score string")
    got = {r.doc_id: r for r in mil.classify(docs, known).collect()}
    assert len(got) == 403
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(out)) for i in range(400)) and not got[None].held_out
    assert np.mean([got[i].predicted == labels[i] for i in out]) >= 0.95
    assert all(0 <= r.score <= 1 and abs(sum(r.attention) - 1) < 1e-6 and r.predicted == int(r.score >= 0.7) for r in got.values())
    # The attention finds the bad passage.
    bad = [got[i].attention for i in out if labels[i] == 0]
    assert np.mean([a[1] for a in bad]) > np.mean([a[0] for a in bad])


def test_held_out_labels_do_not_matter(spark):
    texts, labels = corpus()
    docs = documents(spark, texts)
    known = [(i, q) for i, q in enumerate(labels)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in known]
    a, b = ({r.doc_id: r.score for r in mil.classify(docs, spark.createDataFrame(k, "doc_id long, quality int")).collect()} for k in (known, turned))
    assert a == b


def test_gradient_of_bags_and_edge_cases(spark):
    features, at = mil.passages(pa.array(["", "a b", "x " * 130, "\n\n é"], pa.string()))
    assert np.diff(at).tolist() == [1, 1, 3, 1] and np.isfinite(features).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in mil.classify(documents(spark, ["a", None]), none).collect()] == [0.5, 0.5]
    assert mil.classify(documents(spark, []), none).count() == 0
