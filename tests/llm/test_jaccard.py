"""Components of n-gram Jaccard links against brute force over all pairs that share an n-gram."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenlog.llm import jaccard, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_set(text, width=3):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent=90):
    """(id, set size, smallest id reachable) of every row."""
    sets = [gram_set(t) for _, t in rows]
    own = list(range(len(sets)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    holders = defaultdict(list)
    for j, s in enumerate(sets):
        for i, common in Counter(i for g in s for i in holders[g]).items():
            if 100 * common >= percent * (len(sets[i]) + len(s) - common):
                a, b = sorted((root(i), root(j)))
                own[b] = a
        for g in s:
            holders[g].append(j)
    low = {}
    for j, (i, _) in enumerate(rows):  # rows of empty sets are on their own
        if i is not None:
            low[root(j)] = min(i, low.get(root(j), i))
    return sorted((str(i), len(s), str(low.get(root(j)))) for j, ((i, _), s) in enumerate(zip(rows, sets)))


def check(df, percent=90):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df, percent=percent).collect())
    assert got == brute(rows, percent)
    return got


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op13_jaccard(spark, SF).collect())
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("percent", [90, 80])
def test_families(spark, percent):
    """Families of near copies around the threshold, chains, and copies of copies."""
    r = random.Random(percent)
    rows = []
    for family in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([9, 12, 25, 60, 150, 700]))]
        made = [base]
        for _ in range(60):
            w = list(r.choice(made[-8:] if family % 3 else made[:1]))
            for _ in range(r.randrange(1, 2 + len(w) // 40)):
                i = r.randrange(len(w))
                kind = r.randrange(4)
                if kind == 0:
                    w[i] = f"w{r.randrange(3000)}"
                elif kind == 1:
                    w[i : i + 1 + len(w) // 40] = []
                elif kind == 2:
                    w[i:i] = [f"x{r.randrange(30)}" for _ in range(1 + len(w) // 40)]
                else:
                    w[i] = w[i].upper()
            made.append(w or ["a"])
        rows += [" ".join(w) for w in made]
    r.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = check(df, percent)
    assert len({c for _, _, c in got}) < 0.8 * len(got)


def test_edge_cases(spark):
    long = " ".join(f"v{i * i % 7919}" for i in range(40_000))
    rows = [(None, "a b c d"), (None, "q r s t"), (5, None), (3, ""), (3, ""), (None, " \t"), (9, "A b C d"), (8, "a b"), (7, "A B"), (6, "b a"), (6, "a"), (11, long), (10, long + " end"), (12, long), (4, "É b c"), (2, "é b c")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    check(df)
    assert jaccard.jaccard_components(df.filter("false")).collect() == []


@pytest.mark.parametrize("percent", [90, 80, 51, 99, 100])
def test_every_linked_pair_shares_a_key(percent):
    r = np.random.default_rng(percent)
    how = jaccard.Threshold(percent)
    for _ in range(1500):
        n = int(r.integers(1, 300))
        both = int(r.integers(0, n + 1))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.unique(np.concatenate([a[:both], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 8)), dtype=np.uint64) * np.uint64(2)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) and len(a) + len(b) > 2 * common and 100 * common >= percent * (len(a) + len(b) - common):
            assert np.intersect1d(jaccard.keys(a, how), jaccard.keys(b, how)).size


def test_fragments_sum_to_the_overlap(spark):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 4000, 3000).astype(np.uint64) * np.uint64(1 << 51)) for _ in range(6)]
    grams = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "sid long, n long, grams binary")
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if i != j], "sid long, hub long")
    by_piece, totals = jaccard.counted(pairs, grams)
    assert by_piece.count() > 2 * pairs.count()
    assert sorted((x.sid, x.hub, x.common) for x in totals.collect()) == sorted((i, j, len(np.intersect1d(sets[i], sets[j]))) for i in range(6) for j in range(6) if i != j)
