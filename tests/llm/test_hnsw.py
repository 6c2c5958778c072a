"""Recall against brute force, exact scores, common vectors, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from lumenlog.llm import hnsw, queries

SF = "/root/testdata/sf0.1"


def truth(ids, vectors, every, k):
    out = {}
    for i, v in zip(ids, vectors):
        if i % every == 0:
            out[i] = sorted((-s, j) for s, j in zip(vectors @ v, ids) if j != i)[:k]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want, got = truth(ids, vectors, 20, 20), {}
    by_id = dict(zip(ids, vectors))
    for r in queries.op3_ann(spark, SF).collect():
        assert r.query_id != r.vec_id and np.isclose(r.score, by_id[r.query_id] @ by_id[r.vec_id], rtol=1e-12)
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert got.keys() == want.keys()
    for x in got.values():
        assert [r for r, _, _ in sorted(x)] == list(range(1, 21)) and sorted(x) == sorted(x, key=lambda y: y[1:])
    assert np.mean([len({j for _, j in want[q]} & {j for _, _, j in got[q]}) / 20 for q in want]) > 0.95


def test_clusters_norms_and_a_common_vector():
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 16))
    v = centres[r.integers(0, 30, 4000)] + 0.05 * r.normal(size=(4000, 16))
    v *= r.uniform(0.5, 2, size=(4000, 1))
    v[1000:2400] = v[999]
    ids = np.arange(4000)
    at, found, scores = hnsw.find(hnsw.build(ids, v), ids[::20], v[::20], 20)
    hits = []
    for n, (i, q) in enumerate(zip(ids[::20], v[::20])):
        exact = np.sort(np.delete(v @ q, i))[::-1][:20]
        hits.append(np.mean(scores[at == n] >= exact[-1] - 1e-9))
        order = list(zip(-scores[at == n], found[at == n]))
        assert order == sorted(order)
    assert np.mean(hits) > 0.9


def test_odd_rows(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.5]), (20, [0.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [1.0]), (6, [float("inf")]), (None, [9.0, 9.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, rank int")
    rows = [tuple(r) for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, rows_per_shard=3, queries_per_block=1).collect()]
    assert sorted(rows) == [(0, 1, 7, 1.25), (0, 2, 7, 1.25), (0, 3, 8, 1.25), (0, 4, 4, 1.0)]
    assert hnsw.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).collect() == []
