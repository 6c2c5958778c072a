"""Codes of vectors against plain assignment over every entry."""

import hashlib

import numpy as np
import pytest

from lumenlog.llm import codes, queries

SF = "/root/testdata/sf0.001"


def plain(vectors, parts=4, entries=256, rounds=4, scale=1024):
    """(codes, errors, codebooks) of rows in vec_id order."""
    x = np.floor(np.array(vectors, np.float64) * scale).astype(np.int64).reshape(len(vectors), parts, -1)
    book = x[:entries].copy()

    def assign():
        d = np.stack([((x - book[e]) ** 2).sum(2) for e in range(len(book))])
        return d.argmin(0), d.min(0)

    for _ in range(rounds):
        near, _ = assign()
        for p in range(parts):
            for e in set(near[:, p]):
                own = x[near[:, p] == e, p]
                book[e, p] = own.sum(0) // len(own)
    near, d = assign()
    return [bytes(r.astype(np.uint8)).hex() for r in near], d.sum(1).tolist(), book.transpose(1, 0, 2)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    code, error, books = plain([r.embedding for r in rows])
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r.label] = by_label.get(r.label, 0) + e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = [(r.vec_id, c, e, by_label[r.label], sha) for r, c, e in zip(rows, code, error)]
    assert sorted(map(tuple, queries.op12_codes(spark, SF).collect())) == want


@pytest.mark.parametrize("kind", ["cloud", "ties", "line"])
def test_nearest_entries(kind):
    r = np.random.default_rng(5)
    for n, entries, width, pivots in ((500, 256, 16, 8), (300, 40, 3, 1), (50, 1, 2, 4), (200, 256, 1, 3)):
        spread = {"cloud": 900, "ties": 2, "line": 1 << 28}[kind]
        x, book = r.integers(-spread, spread + 1, (n, width)), r.integers(-spread, spread + 1, (entries, width))
        if kind == "line":
            book[:] = book[:, :1]
        fixed = codes.spread_pivots(book, pivots)
        entry, best = codes.nearest_entries(x, codes.distances(x, fixed), book, codes.distances(book, fixed))
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (entry == d.argmin(1)).all()


def test_bounds_spare_evaluations(monkeypatch):
    """Entries are pruned, not all tried."""
    r = np.random.default_rng(6)
    centres = r.integers(-3000, 3000, (256, 16))
    x = centres[r.integers(0, 256, 4000)] + r.integers(-40, 40, (4000, 16))
    fixed, tried = codes.spread_pivots(centres, 8), []
    real = np.take_along_axis
    monkeypatch.setattr(codes.np, "take_along_axis", lambda a, i, axis: tried.append(1) or real(a, i, axis=axis))
    monkeypatch.setattr(codes, "STEP", 4)
    entry, best = codes.nearest_entries(x, codes.distances(x, fixed), centres, codes.distances(centres, fixed))
    bound = np.abs(codes.distances(x, fixed)[:, None] - codes.distances(centres, fixed)[None]).max(2)
    assert tried and (bound <= np.sqrt(best)[:, None]).mean() < 0.05
    assert (best == ((x[:, None] - centres[None]) ** 2).sum(2).min(1)).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.5, 1.0], 1, "x"), (1, [1.0, 0.0, 0.25, 0.75, 2.0], 1, "y"), (1, [1.0, 0.0, 0.25, 0.75, 2.0], None, "y"), (None, [0.1, 0.2], None, None), (7, None, 2, "q"), (8, [nan], 2, "q"), (9, [inf, 1.0], 2, "q"), (10, [None, 1.0], 2, "q"), (11, [], 5, "q"), (12, [1e300, -1e300, 3.0], 5, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    made = codes.compress(df)
    out = codes.with_label_error(made.coded)
    assert sorted(out.columns) == ["code", "embedding", "error", "label", "label_error", "vec_id"]
    got = out.collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "11", "12", "3", "None"]
    assert all(r.error == 0 and len(r.code) == 8 for r in got)  # an entry for each row
    assert len({r.code for r in got if r.vec_id == 1}) == 1
    assert [b.shape for b in made.codebooks] == [(6, 2)] * 4
    few = codes.compress(df.filter("vec_id = 1 or vec_id = 3"), entries=1, rounds=1)
    assert [x.tolist() for x in few.codebooks] == [[[(512 + 2048) // 3, (-512) // 3]], [[(1024 + 512) // 3, 1536 // 3]], [[4096 // 3, 0]], [[0, 0]]]
    for empty in (df.filter("false"), df.filter("vec_id in (7, 8)"), df.filter("vec_id = 11")):
        made = codes.compress(empty)
        assert [len(r.code) for r in codes.with_label_error(made.coded).collect()] == [8] * empty.filter("vec_id = 11").count()
