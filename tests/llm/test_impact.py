"""Exact top-k against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from lumenlog.llm import impact


def test_matches_brute_force_for_any_round():
    r = np.random.default_rng(2)
    for n, width, spread in ((1, 3, 5), (40, 1, 3), (700, 16, 200), (3000, 8, 2), (500, 64, 60)):
        v = np.floor(r.normal(size=(n, width)) * spread)
        v[: n // 3] = v[0]  # a common vector
        ids = np.sort(r.integers(0, n, n))
        index = impact.build(ids, v)
        at, found, scores = impact.find(index, ids[::7], v[::7], 5)
        got = {}
        for a, f, s in zip(at, found, scores):
            got.setdefault(a, []).append((-s, f))
        for i, (q, own) in enumerate(zip(v[::7], ids[::7])):
            want = sorted((-int(s), j) for s, j in zip(v @ q, ids) if j != own)[:5]
            assert got.get(i, []) == want


def test_odd_rows(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [1.0]), (5, []), (6, [float("inf")]), (None, [9.0, 9.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, score int")
    rows = [tuple(r) for r in impact.top_k(df, F.col("vec_id") % 50 == 0, rows_per_shard=2, queries_per_block=1).collect()]
    assert sorted(rows) == [
        (0, 1, 7, 81920), (0, 2, 7, 81920), (0, 3, 4, 65536), (0, 4, 5, 0), (0, 5, 50, 0),
        (50, 1, 0, 0), (50, 2, 4, 0), (50, 3, 5, 0), (50, 4, 7, 0), (50, 5, 7, 0),
    ]
    assert impact.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).collect() == []
