"""SimHash components against brute force over all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from lumenlog.llm import queries, simhash
from lumenlog.llm.graph import connected_components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(fps):
    """Smallest index reachable, for each fingerprint."""
    own = list(range(len(fps)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= 4)[0]:
            x, y = sorted((root(i), root(int(j))))
            own[y] = x
    return [root(i) for i in range(len(a))]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A B c D", "x " * 40000, "É é ẞ a b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def check(got, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = brute(fps)
    low = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    want = sorted((str(i), f"{f:016x}", low.get(r)) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op9_simhash(spark, SF).collect(), rows)


def test_dense_fingerprints(spark):
    """A cloud of near fingerprints, chains and strangers: components as brute force has them."""
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre, *(r.getrandbits(64) for _ in range(300))}
    for _ in range(400):
        x = centre
        for b in r.sample(range(64), r.randrange(1, 9)):
            x ^= 1 << b
        fps.add(x)
    x = r.getrandbits(64)
    for _ in range(40):
        for b in r.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), 1) for f in fps], "fp long, n long")
    got = {np.int64(x.fp).view(np.uint64): x.component for x in simhash.components(df).collect()}
    groups, want = {}, {}
    for f, root in zip(fps, brute(fps)):
        groups.setdefault(got[np.uint64(f)], set()).add(f)
        want.setdefault(root, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_edge_cases(spark):
    rows = [(None, "null id text of some words"), (5, None), (3, ""), (3, ""), (9, "null id text of some words"), (8, "b " * 3000), (7, "B " * 3000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    check(simhash.near_duplicates(df).collect(), rows)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, ""), (7, "B " * 3000), (9, "null id text of some words")]
    assert simhash.deduplicate(df.filter("false")).collect() == []


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (4, 4), (3, 5), (5, 6), (6, 7), (7, 8), (None, 3), (2, 9)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (6, 3), (7, 3), (8, 3), (9, 1)]
    assert connected_components(edges.filter("false")).collect() == []
