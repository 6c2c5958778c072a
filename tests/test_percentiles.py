"""Exact percentiles against numpy: any size, ties, open ends, narrowed brackets, groups, one plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.functions import stats

PS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99999, "f": 1.0}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 5000, 300_000])
def test_columns_of_any_size(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % n / 3).alias("x"), (F.col("id") % 5).cast("int").alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("h"))
    ids = np.arange(n)
    columns = {"x": (ids * 7919) % n / 3, "t": ids % 5, "h": ids[ids % 3 == 0]}
    got = stats.percentile_values(df, {f"{c}{k}": (c, p) for c in columns for k, p in PS.items()})
    for c, v in columns.items():
        for k, p in PS.items():
            assert np.isclose(got[f"{c}{k}"], np.percentile(v, 100 * p), rtol=1e-12), (c, p)
    assert stats.percentile_values(df.filter("x < 0"), {"m": ("x", 0.5)}) == {"m": None}


def test_narrowed_brackets(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET_ROWS", 3)
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 100)
    v = np.random.default_rng(1).normal(size=20_000).round(4)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = stats.percentile_values(df, {k: ("x", p) for k, p in PS.items()})
    assert all(np.isclose(got[k], np.percentile(v, 100 * p), rtol=1e-12) for k, p in PS.items())


@pytest.mark.parametrize("n", [1000, 1001, 20_000])
def test_two_values_end_the_narrowing(spark, monkeypatch, n):
    """A rank between two values with many repeats: the bracket cannot shrink."""
    monkeypatch.setattr(stats, "BRACKET_ROWS", 4)
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 100)
    df = spark.range(n).select((F.col("id") % 2).alias("x"))
    ps = PS | {"g": 0.4999, "h": 0.5001}
    got = stats.percentile_values(df, {k: ("x", p) for k, p in ps.items()})
    assert all(np.isclose(got[k], np.percentile(np.arange(n) % 2, 100 * p), rtol=1e-12) for k, p in ps.items())


def test_groups(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), ((F.col("id") * 31) % 1000 / 7).alias("x"))
    ids = np.arange(9000)
    got = {r.g: r for r in stats.exact_percentiles(df, ["g"], "x", PS).collect()}
    for g in (None, 1, 2):
        v = ((ids * 31) % 1000 / 7)[ids % 3 == (g or 0)]
        assert all(np.isclose(got[g][k], np.percentile(v, 100 * p), rtol=1e-12) for k, p in PS.items())
