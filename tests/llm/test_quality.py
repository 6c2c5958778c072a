"""The field's marginals against enumeration, its gradient-fitted accuracy on held-out documents, odd rows."""

import itertools

import numpy as np

from lumenlog.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    field = quality.Field(np.zeros(16), np.ones(16), r.normal(size=97) * 0.3, r.normal(size=(2, 2)))
    texts = ["A b c\nd, e! f f\n\nZ 12 3", "one line", "x\ny", None]
    good, size, per = field.marginals(texts)
    x, _, _ = quality.line_features(texts)
    s = field.inputs(x, per) @ field.weights
    at = 0
    for n in per:
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert np.allclose(good[at : at + n], ones / total)
        at += n
    scores = field.scores(texts)
    assert np.isclose(scores[0], (good[:4] * size[:4]).sum() / size[:4].sum(), atol=1e-5)
    assert np.isclose(scores[3], good[-1])


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 500
    assert np.mean([p == y for _, p, y in held]) > 0.98
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "\n" * 5000, 5.0), (2, "word " * 20000, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, None), (7, 1)], "doc_id long, quality int")
    field = quality.fit(docs, labels)
    out = quality.classify(docs, field).collect()
    assert [r.score for r in out] == [0.5] * 4 and all(r.predicted == 1 for r in out)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, quality.fit(docs, labels)).collect())
    assert quality.classify(docs.filter("false"), field).collect() == []
