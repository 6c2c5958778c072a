"""Periodic runs against a search over every period."""

import hashlib
import random
import zlib

import pytest

from lumenlog.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(w, shortest=6, times=4):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                if not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    s, length, q = best or (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), s, length, q, 1000 * length // q if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("setting", [(6, 4), (5, 4), (5, 6), (12, 5)])
def test_runs_of_random_words(setting):
    r = random.Random(2)
    for _ in range(1500):
        k, w = r.choice([1, 2, 3, 5]), []
        for _ in range(r.randrange(0, 5)):
            u = [r.randrange(k) for _ in range(r.randrange(1, 8))]
            w += u * r.randrange(1, 8)
            w = w[: len(w) - r.randrange(0, 3)] + [r.randrange(k + 3) for _ in range(r.randrange(0, 5))]
        w = [b"%d" % x for x in w]
        assert periodic.runs_of(w, *setting) == plain_runs(w, *setting)


def test_nested_periods():
    inner = [b"a", b"b"] * 5 + [b"c"]
    assert periodic.runs_of(inner * 4) == plain_runs(inner * 4)
    assert periodic.runs_of([b"x"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs_of([b"%d" % (i % 997) for i in range(40_000)]) == [(0, 40_000, 997)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op11_runs(spark, SF).collect()))
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] for r in got) > 10


def test_edge_cases(spark):
    long = "z " * 30_000
    rows = [(None, "a b " * 5, "x"), (1, None, None), (2, "", "y"), (2, "", "y"), (3, "é É é É é É é É", "q"), (4, long, "q"), (5, "\x0b\x1f\x0b a b", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periodic.periodic_runs(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_words", "runs", "collapsed"])
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    want = [("1", 0, [], ""), ("2", 0, [], ""), ("2", 0, [], ""), ("3", 8, [(0, 8, 2)], "é É"), ("4", 30_000, [(0, 30_000, 1)], "z"), ("5", 2, [], "\x1f a b"), ("None", 10, [(0, 10, 2)], "a b")]
    assert got == want
    assert periodic.periodic_runs(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, 6, 3)


def test_planted_period(spark):
    """Texts as the query reads them, for every document of a table with nulls."""
    rows = [(i, " ".join(f"w{i * k % 7}" for k in range(i % 40)) if i % 11 else None) for i in range(400)] + [(None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text or "").split() for r in queries.with_planted_period(df).collect()}
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        assert got[i] == words
