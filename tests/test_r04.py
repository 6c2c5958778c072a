"""Cases of the fourth round's findings."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenlog.operators import models as mo
from lumenlog.operators import trees
from lumenlog.plans import tabular_queries as tq
from lumenlog.plans.composite import extract_all_features, run_tabular


def test_stored_features_are_never_broadcast(spark, log):
    """A family of features has a row for each row of the log; its files may be far smaller than its rows."""
    rows, spec = log([("a", i, "xyz"[i % 3]) for i in range(12)] + [(None, i, "x") for i in range(5)])
    spec = replace(spec, chunk_rows=64)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = extract_all_features(rows, spec, F.lit("2024-02-01").cast("timestamp"), ["x", "y"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 17
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("SortMergeJoin") == 8 and "Broadcast" not in plan


def table(spark, n=400):
    columns = {"a": (F.col("id") * 37 % 101).cast("double"), "b": (F.col("id") * 53 % 89).cast("double")}
    return spark.range(n).withColumns(columns).withColumn("y", F.col("a") * 3 + F.sin("b") * 20)


def test_a_model_that_cannot_be_fitted_is_no_result(spark, monkeypatch):
    """A run must not give metrics of the other models, and predictions of their best, as if all had been fitted."""
    fit = mo.train

    def train(name, data, **params):
        if name == "lasso":
            raise RuntimeError("an executor was lost")
        return fit(name, data, **params)

    monkeypatch.setattr(mo, "train", train)
    with pytest.raises(RuntimeError, match="an executor was lost"):
        run_tabular(table(spark), "y", ["id"], ["linear", "lasso", "ridge"], folds=2)


def test_predictions_need_every_model(spark, monkeypatch):
    """The best of the models that are left is not the best model."""
    fit = mo.train

    def train(name, data, **params):
        if name != "linear":
            raise RuntimeError("an executor was lost")
        return fit(name, data, **params)

    monkeypatch.setattr(mo, "train", train)
    monkeypatch.setattr(tq, "_RUNS", {})
    with pytest.raises(RuntimeError, match="an executor was lost"):
        entry.queries()["x13_best_model_predictions"](spark, "/root/testdata/sf0.001")


def cell_fit(name, data, **params):
    return trees.fit(name, data, mo.spread, mo.FEATURES, mo.LABEL, mo.PREDICTION, **params)


@pytest.fixture(scope="module")
def binned(spark):
    """Few values of each feature, so that MLlib has the same bins; every cell of a and b holds rows but some of c."""
    a, b, c = F.col("id") * 37 % 23, F.col("id") * 53 % 17, F.floor(F.col("id") / 391) % 3
    y = a * 3 + F.sin(b) * 20 + F.when(c == 1, a * b / 5).otherwise(0) + F.col("id") * 7919 % 101 / 10
    rows = spark.range(3000).withColumns({"a": a.cast("double"), "b": b.cast("double"), "c": c.cast("double"), "y": y})
    return mo.add_folds(mo.assemble(rows.filter("c < 2 or a < 20"), ["a", "b", "c"], "y"), ["id"], 3).persist()


def predictions(model, data):
    return np.array([r[1] for r in sorted((r["id"], r["prediction"]) for r in model.transform(data).collect())])


def test_boosted_cells_are_mllibs_boosted_trees(binned):
    params = {"n_estimators": 12, "learning_rate": 0.2, "max_depth": 4}
    mine, theirs = (predictions(fit("gradient_boosting", binned, **params), binned) for fit in (cell_fit, mo.train))
    assert np.allclose(mine, theirs, rtol=1e-6, atol=1e-6)


def test_a_forest_of_cells_is_like_mllibs(binned):
    """Bootstrap draws differ; what the forests say differs by far less than a tree's leaves do."""
    params = {"n_estimators": 60, "max_depth": 7, "min_samples_leaf": 2}
    mine, theirs = (predictions(fit("random_forest", binned, **params), binned) for fit in (cell_fit, mo.train))
    assert np.corrcoef(mine, theirs)[0, 1] > 0.998
    assert np.abs(mine - theirs).mean() < 0.05 * theirs.std() and abs((mine - theirs).mean()) < 0.01 * theirs.std()


def test_cells_leave_other_cases_to_mllib(spark, binned, monkeypatch):
    monkeypatch.setattr(trees, "MOST_CELLS", 1000)
    assert cell_fit("gradient_boosting", binned) is None
    monkeypatch.undo()
    assert cell_fit("random_forest", binned, max_features="sqrt") is None and cell_fit("svr", binned) is None
    assert cell_fit("random_forest", binned.filter("false")) is None
    assert cell_fit("random_forest", binned.withColumn(mo.LABEL, F.lit(float("nan")))) is None
    constant = binned.withColumn(mo.LABEL, F.lit(4.0))
    assert np.allclose(predictions(cell_fit("random_forest", constant, n_estimators=2), constant), 4.0)


def test_folds_of_trees_take_sums_per_cell(binned, monkeypatch):
    """Neither a fit on all rows, which no fold needs, nor a pass over the rows for each level or round."""
    monkeypatch.setattr(mo, "train", lambda name, data, **params: pytest.fail(f"{name} reads the rows again and again"))
    got = mo.fold_table(binned, ["random_forest", "gradient_boosting"], 3, 3).collect()
    assert len(got) == 6 and all(r["error"] is None and r["r2"] > 0.8 for r in got)
    assert sum(r["n"] for r in got) == 2 * binned.count()
