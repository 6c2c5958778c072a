"""Compact windows against their definition, planted passages, whole documents and odd rows."""

import random

import numpy as np

from lumenlog.llm import passages as P
from lumenlog.llm import queries

SF = "/root/testdata/sf0.01"


def brute_windows(h, least):
    out = []

    def walk(a, b):
        if b - a < least:
            return
        c = min(range(a, b), key=lambda i: (h[i] >> 32, i))
        out.append((a, c, b - 1))
        walk(a, c)
        walk(c + 1, b)

    walk(0, len(h))
    return sorted(out)


def test_compact_windows():
    r = np.random.default_rng(4)
    hs = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 3, 46, 300, 1000)]
    hs[3][50:90] = hs[3][10]
    ends = np.cumsum([len(h) for h in hs])
    starts = ends - [len(h) for h in hs]
    got = sorted(zip(*(x.tolist() for x in P.compact_windows(np.concatenate(hs), starts, ends, 20))))
    want = sorted((s + a, s + c, s + b) for s, h in zip(starts.tolist(), hs) for a, c, b in brute_windows([int(x) for x in h], 20))
    assert got == want


def prose(r, n):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(n)]


def run(spark, texts, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return df, P.repeats(df).collect()


def test_planted_passages(spark):
    r = random.Random(11)
    texts = [prose(r, r.randrange(60, 400)) for _ in range(60)]
    line = prose(r, 25)  # a common line, too short to count
    for t in texts:
        t[10:10] = line
    want = {}
    for p in range(6):
        passage = prose(r, r.choice((51, 55, 70, 120)))
        docs = r.sample(range(60), 5)
        for d in docs:
            texts[d] += passage
            want.setdefault(p, []).append((d, set(passage)))
    near = prose(r, 100)
    other = list(near)
    other[40] = "changed"
    texts += [prose(r, 30) + near, prose(r, 50) + other, ["w"] * 3000, ["w"] * 3001, prose(r, 49), None, []]
    joined = [None if t is None else " ".join(t) for t in texts]
    _, rows = run(spark, joined)
    linked = {}

    def root(x):
        while linked.get(x, x) != x:
            x = linked[x]
        return x

    for x in rows:
        a, b = joined[x.doc_id].split()[x.start : x.end], joined[x.owner_doc_id].split()[x.owner_start : x.owner_end]
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(one & two) / len(one | two) >= 0.8
        linked[root(x.doc_id)] = root(x.owner_doc_id)
    for members in want.values():
        assert len({root(d) for d, _ in members}) == 1
    assert root(60) == root(61) and root(62) == root(63)
    known = {d for m in want.values() for d, _ in m} | {60, 61, 62, 63}
    assert {x.doc_id for x in rows} | {x.owner_doc_id for x in rows} == known


def test_verified_parts_of_a_chain():
    """A near copy with an edit every 30 words, and a line right behind it that stands elsewhere in the other text."""
    r = random.Random(14)
    line, near = prose(r, 20), prose(r, 100)
    other = list(near)
    other[33] = other[66] = "changed"
    t, h = prose(r, 30) + near + line + prose(r, 30), line + prose(r, 40) + other + prose(r, 30)
    [(a, b, x, y, score)] = P.verified(P.tokens(" ".join(t), 5), P.tokens(" ".join(h), 5), P.Passages())
    assert (a, b + 5, x, y + 5) == (30, 130, 60, 160) and score >= 0.8
    # A part before a stretch that differs too much; an exact passage whose first half stands earlier in h as well.
    bad = [w if i % 6 else "x" + w for i, w in enumerate(prose(r, 60))]
    t, h = near + bad, other + [w if i % 8 else "y" + w for i, w in enumerate(bad)]
    assert [(x[0], x[1] + 5) for x in P.verified(P.tokens(" ".join(t), 5), P.tokens(" ".join(h), 5), P.Passages())][0][0] == 0
    t, h = near[:60], near[:25] + prose(r, 80) + near[:60]
    assert [x[:4] for x in P.verified(P.tokens(" ".join(t), 5), P.tokens(" ".join(h), 5), P.Passages())] == [(0, 55, 105, 160)]
    t, h = near[:20] * 12 + near[:60], prose(r, 9) + near[:20] * 2 + prose(r, 9) + near[:60]
    assert any(b - a >= 55 for a, b, *_ in P.verified(P.tokens(" ".join(t), 5), P.tokens(" ".join(h), 5), P.Passages()))


def test_passage_of_frequent_lines(spark):
    """Every line of the passages stands alone in many other texts, so the firsts of all anchors share only one line."""
    r = random.Random(15)
    lines = [prose(r, 20) for _ in range(3)]
    texts = [prose(r, 60) + lines[i % 3] + prose(r, 60) for i in range(90)]
    texts += [prose(r, 40) + lines[0] + lines[1] + lines[2] + prose(r, 40) for _ in range(6)]
    half = [prose(r, 30) for _ in range(2)]
    texts += [prose(r, 60) + half[i % 2] + prose(r, 60) for i in range(40)] + [prose(r, 40) + half[0] + half[1] + prose(r, 40) for _ in range(4)]
    for parts in (1, 4):
        _, rows = run(spark, [" ".join(t) for t in texts], parts)
        assert all(x.start <= 42 and x.end >= 98 for x in rows)
        for group in (range(90, 96), range(136, 140)):
            assert len({x.doc_id for x in rows} & set(group)) == len(group) - 1
            assert all(x.owner_doc_id in group for x in rows if x.doc_id in group)


def test_offsets():
    for size in (16, 38, 46):
        for x in range(46):  # a run of 46 tokens from 0 on, the place at x
            assert any(0 <= x - y and x - y + size <= 46 for y in P.offsets(size, 46))


def test_one_occurrence_stays(spark):
    r = random.Random(12)
    passage = prose(r, 80)
    texts = [" ".join(prose(r, 100) + passage + prose(r, 20)) for _ in range(12)] + [" ".join(passage)]
    df, _ = run(spark, texts)
    left = P.drop_repeats(df)
    assert left.columns == df.columns
    out = {x.doc_id: x.text for x in left.collect()}
    assert sum(" ".join(passage) in t for t in out.values()) == 1
    for d, t in out.items():
        assert set(texts[d].split()) - set(passage) <= set(t.split())


def test_odd_rows(spark):
    r = random.Random(13)
    long = " ".join(prose(r, 30000))
    rows = [(1, None, "a"), (2, "", "b"), (None, long, "c"), (3, long, "d"), (3, long, "d"), (4, "few words", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = [(x.doc_id, x.start, x.end, x.owner_doc_id) for x in P.repeats(df).collect()]
    assert got == [(None, 0, 30000, 3)]
    assert sorted(map(str, P.drop_repeats(df).collect())) == sorted(map(str, df.collect()))
    assert P.repeats(df.filter("false")).collect() == [] and P.drop_repeats(df.filter("false")).collect() == []


def test_cut():
    assert P.cut("a b\n c  d e", [(1, 3)]) == "a d e".replace("a ", "a ")
    assert P.cut(" a b", []) == " a b"
    assert P.cut("a b c", [(0, 2), (1, 9)]) == ""


def test_whole_table_is_sound(spark):
    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_passages(spark, SF).collect()
    assert rows
    for x in rows:
        a, b = texts[x.doc_id][x.start : x.end], texts[x.owner_doc_id][x.owner_start : x.owner_end]
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(one & two) / len(one | two) >= 0.8
