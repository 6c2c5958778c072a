"""Neighbourhood operators on small tiles, frames of odd sizes and missing pixels, against loops over windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import frames as fr
from lumenlog.operators import tiles

SIZES = [(1, 1), (3, 10), (9, 5), (13, 17)]


def frame(height, width, seed, missing=0.0, frames=3):
    r = np.random.default_rng(seed)
    a = r.normal(size=(frames, height, width))
    a[r.random(a.shape) < missing] = np.nan
    return a


def table(spark, a, keep_null=False):
    rows = [(f"f{k}", y, x, None if np.isnan(v) else float(v)) for (k, y, x), v in np.ndenumerate(a) if keep_null or not np.isnan(v)]
    return spark.createDataFrame(rows, "frame_id string, y int, x int, value double").repartition(4)


def fold(i, n):
    i %= 2 * n
    return min(i, 2 * n - 1 - i)


def windows(a, k, y, x, r, mirror):
    """(dy, dx, value) of the present pixels of a window."""
    h, w = a.shape[1:]
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            v = a[k, fold(y + dy, h), fold(x + dx, w)] if mirror else a[k, y + dy, x + dx] if 0 <= y + dy < h and 0 <= x + dx < w else np.nan
            if not np.isnan(v):
                yield dy, dx, v


def same(df, want):
    got = {(r.frame_id, r.y, r.x): r.value for r in df.collect()}
    assert set(got) == set(want)
    assert all(np.isclose(got[c], want[c], rtol=1e-9, atol=1e-12) for c in want)


def plain(a, f, r, mirror):
    return {(f"f{k}", y, x): f(list(windows(a, k, y, x, r, mirror)), a[k, y, x]) for (k, y, x), v in np.ndenumerate(a) if not np.isnan(v)}


@pytest.mark.parametrize("shape", SIZES)
@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_filters(spark, shape, missing):
    a = frame(*shape, 5, missing)
    df, run = table(spark, a, keep_null=True), lambda *x, **k: tiles.filtered(table(spark, a, True), *shape, *x, size=4, **k)
    sigma, r = 0.8, int(4 * 0.8 + 0.5)
    g = lambda d: math.exp(-0.5 * (d / sigma) ** 2)
    want = plain(a, lambda w, c: sum(g(dy) * g(dx) * v for dy, dx, v in w) / sum(g(dy) * g(dx) for dy, dx, _ in w), r, True)
    same(run(r, lambda s: tiles.weighted_mean(s, [g(d) for d in range(-r, r + 1)])), want)
    same(fr.gaussian_filter(df, *shape, sigma), want)
    want = plain(a, lambda w, c: np.median([v for *_, v in w]), 1, True)
    same(run(1, lambda s: tiles.median_of(s, 3)), want)
    same(fr.median_filter(df, *shape, 3), want)
    want = plain(a, lambda w, c: sum(v - c for dy, dx, v in w if abs(dy) + abs(dx) == 1), 1, True)
    same(run(1, tiles.laplacian_of), want)

    def wiener(w, c, noise=0.4, area=9.0):
        m = sum(v for *_, v in w) / area
        var = sum(v * v for *_, v in w) / area - m * m
        return m if var < noise else m + (c - m) * (1 - noise / var)

    same(fr.wiener_filter(df, *shape, 3, 0.4), plain(a, wiener, 1, False))
    weight = lambda dy, dx, v, c: math.exp(-(dy * dy + dx * dx) / 2) * math.exp(-((v - c) ** 2) / (2 * 0.5**2))
    want = plain(a, lambda w, c: sum(weight(*p, c) * p[2] for p in w) / sum(weight(*p, c) for p in w), 1, False)
    same(run(1, lambda s: tiles.bilateral_of(s, 1, 1.0, 0.5), mirror=False), want)


@pytest.mark.parametrize("missing", [0.0, 0.02])
def test_similarity(spark, missing):
    a, b = frame(13, 17, 1, missing), frame(13, 17, 2)
    b = b * 0.3 + np.nan_to_num(a)
    left, right = table(spark, a), table(spark, b)
    pairs = fr.pair_frames(left, right)
    sums = tiles.similarity(pairs, 13, 17, ["frame_id"], 5, size=4).groupBy("frame_id").agg(F.sum("total").alias("s"), F.sum("windows").alias("n"))
    got = {r.frame_id: (r.s, r.n) for r in sums.collect()}
    for k in range(3):
        there = ~np.isnan(a[k])
        span = a[k][there].max() - a[k][there].min()
        c1, c2, values = (0.01 * span) ** 2, (0.03 * span) ** 2, []
        for y in range(2, 11):
            for x in range(2, 15):
                p, q = a[k, y - 2 : y + 3, x - 2 : x + 3].ravel(), b[k, y - 2 : y + 3, x - 2 : x + 3].ravel()
                if not np.isnan(p).any():
                    cov = np.cov(p, q)
                    values.append((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
        assert got[f"f{k}"][1] == len(values) and np.isclose(got[f"f{k}"][0], sum(values))
    assert fr.ssim(pairs.filter("y < 3"), 13, 17).collect() == []


def test_pixels_outside_the_frame_and_empty_tables(spark):
    df = table(spark, frame(4, 4, 3))
    with pytest.raises(Exception, match="outside the frame"):
        fr.median_filter(df, 3, 4).collect()
    for f in (fr.gaussian_filter, fr.median_filter, fr.wiener_filter, fr.bilateral_filter, fr.peaks_2d, fr.laplacian):
        assert f(df.filter("y < 0"), 4, 4).collect() == []
