"""Linear models from moments against least squares, optimality conditions and MLlib."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.operators import gram
from lumenlog.operators import models as mo


def moments(x, y):
    z = np.column_stack([x, y])
    off = z - z.mean(0)
    return gram.Moments(len(z), z.mean(0), off.T @ off)


def sample(n=400, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)) * [1, 50, 0.01, 1] + [1e4, 0, 5, 0]
    x[:, 3] = x[:, 0] * 0.5 + r.normal(size=n)
    return x, x @ [2.0, -0.3, 40.0, 1.0] + 7 + r.normal(size=n)


def test_linear_and_ridge():
    x, y = sample()
    i, w = gram.solve(moments(x, y), "linear")
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert np.allclose([i, *w], want, rtol=1e-6)
    c = x - x.mean(0)
    i, w = gram.solve(moments(x, y), "ridge", alpha=30.0)
    assert np.allclose(w, np.linalg.solve(c.T @ c + 30 * np.eye(4), c.T @ (y - y.mean())), rtol=1e-8)


@pytest.mark.parametrize("name,params", [("lasso", {"alpha": 0.2}), ("elastic_net", {"alpha": 0.5, "l1_ratio": 0.3}), ("lasso", {"alpha": 1e-4}), ("lasso", {"alpha": 1e6})])
def test_penalised_models_are_optimal(name, params):
    x, y = sample()
    m = moments(x, y)
    i, w = gram.solve(m, name, **params)
    l1, l2 = gram.penalties(name, len(x), **params)
    slope = (x - x.mean(0)).T @ (y - i - x @ w) / len(x) - l2 * w
    assert np.allclose(slope[w != 0], l1 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope[w == 0]) <= l1 + 1e-6).all()
    assert np.isclose(m.squared_error(i, w), np.mean((y - i - x @ w) ** 2))


def test_singular_and_empty():
    x, y = sample(50)
    x[:, 1], x[:, 2] = x[:, 0], 3.0
    for name in gram.LINEAR_MODELS:
        i, w = gram.solve(moments(x, y), name, alpha=1e-6)
        assert np.isfinite([i, *w]).all() and w[2] == 0
    with pytest.raises(ValueError):
        gram.solve(gram.Moments(0, np.zeros(3), np.zeros((3, 3))), "linear")


def test_cells_merge():
    x, y = sample()
    parts = [moments(x[a:b], y[a:b]) for a, b in ((0, 1), (1, 100), (100, 400))]
    both, whole = gram.Moments.together(parts), moments(x, y)
    assert both.n == whole.n and np.allclose(both.mean, whole.mean) and np.allclose(both.products, whole.products)


def frame(spark, n=300):
    x = np.random.default_rng(9).normal(size=(n, 4))  # of like scale, for MLlib's iterations
    y = x @ [2.0, -0.3, 4.0, 1.0] + 7 + np.random.default_rng(8).normal(size=n)
    rows = [(i, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    return mo.add_folds(mo.assemble(df, ["a", "b", "c", "d"], "y"), ["id"], 3)


def test_folds_equal_fits_of_each_fold(spark):
    data = frame(spark)
    got = {(r.model, r.fold): r for r in mo.train_all(data, ["linear", "ridge"], 4, 3)[1].collect()}
    for name in ("linear", "ridge"):
        for k in range(3):
            model = mo.train(name, data.filter(F.col("fold") != k))
            want = mo.metrics(model.transform(data.filter(F.col("fold") == k)), 4).first()
            r = got[name, k]
            assert r.error is None and r.n == want.n and r.p == 4
            assert all(np.isclose(r[c], want[c], rtol=1e-4) for c in ("mse", "rmse", "mae", "r2", "adjusted_r2", "mape", "max_error"))


def test_search_takes_one_scan_and_refits(spark):
    data = frame(spark)
    candidates = [{"alpha": a} for a in (1e4, 0.1, 1e-3)]
    table = mo.search(data, "lasso", candidates, 4, 3).collect()
    best, model = mo.search_and_fit(data, "lasso", candidates, 4, 3)
    assert best == candidates[table[0].candidate] and len(table) == 3
    i, w = gram.solve(gram.moments_by(data, 4, [])[()], "lasso", **best)
    assert np.allclose(model.coefficients.toArray(), w, rtol=1e-2, atol=1e-2)
    models, folds = mo.train_all(data, ["lasso"], 4, 3, tuned={"lasso": candidates})
    assert np.allclose(models["lasso"].coefficients.toArray(), model.coefficients.toArray())


def test_missing_folds_and_sizes(spark):
    data = frame(spark, 20).filter("fold = 1")
    rows = {r.fold: r for r in mo.cross_validate(data, "linear", 4, 3).collect()}
    assert rows[1].error == "no rows to fit" and rows[1].n == 0 and rows[0].n == 0 and rows[0].error is None
    assert mo.learning_curve(data, ["id"], "linear", 4, 3, [0.5, 1.0]).collect() == []
    curve = mo.learning_curve(frame(spark), ["id"], "ridge", 4, 3, [1.0, 0.2], alpha=0.1).orderBy("size").collect()
    assert [r["size"] for r in curve] == [0.2, 1.0] and all(r.validation_mean > 0 for r in curve)
