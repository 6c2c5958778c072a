"""Cases of the third round's findings."""

import os

import pandas as pd
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenlog.operators import aggregates as ag
from lumenlog.operators import models as mo
from lumenlog.operators import patterns as pm
from lumenlog.operators import reconstruct as rc


def test_accuracy_of_crowded_events(spark, tmp_path):
    """Same-type events of one user within the tolerance of several shifted ones: a match is not always its own event."""
    seconds = [0, 1, 2, 4, 5, 9, 10, 11, 30, 30, 31, 36, 100, 103]
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), i % 2, "click", 1.0, "{}") for i, s in enumerate(2 * seconds)]
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    for table in os.listdir("/root/testdata/sf0.001"):
        if table != "events.parquet":
            os.symlink(f"/root/testdata/sf0.001/{table}", tmp_path / table)
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    ok, message, _, _ = compare("r20_accuracy_metrics", spark, str(tmp_path), duck(str(tmp_path)), entry.queries(), entry.oracle_sql())
    assert ok, message


@pytest.fixture(scope="module")
def one_file(spark):
    rows = spark.range(60_000, numPartitions=1).withColumns({"a": F.col("id") % 97, "b": F.col("id") % 31, "y": F.col("id") % 97 * 3.0 + 50})
    return mo.add_folds(mo.assemble(rows, ["a", "b"], "y"), ["id"], 3).persist()


def test_fits_are_dealt_evenly(spark, one_file, monkeypatch):
    """A single small file must not leave a fit to one task."""
    seen = []
    fit = mo.RandomForestRegressor.fit
    monkeypatch.setattr(mo.RandomForestRegressor, "fit", lambda self, df: seen.append(df.rdd.glom().map(len).collect()) or fit(self, df))
    mo.train("random_forest", one_file, n_estimators=2, max_depth=2)
    assert len(seen[0]) >= 4 and sum(seen[0]) == 60_000 and max(seen[0]) < 20_000


def test_fits_at_once_keep_rows_in_place(one_file):
    params = {"random_forest": [{"n_estimators": 2, "max_depth": 3}], "svr": [{"steps": 4}]}
    models, table = mo.train_all(one_file, ["ridge", "random_forest", "svr"], 2, 3, params)
    assert list(models) == ["ridge", "random_forest", "svr"]
    got = {(r["model"], r["fold"]): r for r in table.collect()}
    assert sorted(got) == [(m, k) for m in ("random_forest", "ridge", "svr") for k in range(3)]
    for (name, fold), r in got.items():
        assert r["error"] is None and r["n"] == one_file.filter(F.col("fold") == fold).count()
        if name == "random_forest":
            model = mo.train(name, one_file.filter(F.col("fold") != fold), **params[name][0])
            assert r["rmse"] == pytest.approx(mo.metrics(model.transform(one_file.filter(F.col("fold") == fold)), 2).first()["rmse"], rel=0.05)


def test_gapped_states_do_not_grow_with_the_log(log, monkeypatch):
    """Ends with the same events ahead are one row, so what is stored between lengths stays as it is on a longer log."""
    stored = []
    keep = pm.materialise
    monkeypatch.setattr(pm, "materialise", lambda df, name="table": stored.append((name, (out := keep(df, name)).count())) or out)
    sizes = []
    for n in (40, 120):
        stored.clear()
        rows, spec = log([("k", i, "abc"[i % 3]) for i in range(n)], keys=(), chunk_rows=8)
        assert pm.gapped_patterns(rows, spec, 2, 2, 0.0, 4).count() > 0
        sizes.append(sum(rows for name, rows in stored if name == "gapped"))
    assert sizes[0] == sizes[1] > 0


def _plain_matches(left, right, tol):
    found, used = {}, set()
    for t, i in sorted(left):
        j = next((j for j, r in enumerate(right) if j not in used and abs(r - t) <= tol), None)
        used.add(j)
        found[i] = j is not None
    return found


def test_short_groups_are_matched_without_an_index(spark, log, monkeypatch):
    """Long and short groups side by side, and short ones alone: those store no positions."""
    import random

    from lumenlog.operators import evaluate as ev

    r = random.Random(3)
    rows = [(k, r.randrange(n), "ab"[r.randrange(2)]) for k, n in (("long", 40), ("short", 9), (None, 9)) for _ in range(n if k == "long" else 4)]
    left, spec = log(rows, chunk_rows=8)
    right = left.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 3 * 1_000_000))
    all_rows = left.collect(), right.collect()
    want = {}
    for k, e in {(x.k, x.event) for x in all_rows[0]}:
        a, b = ([(x.ts.timestamp(), x.event_id) for x in side if (x.k, x.event) == (k, e)] for side in all_rows)
        want |= _plain_matches(a, sorted(t for t, _ in b), 1.0)
    got = ev.match_events(left, right, spec, 1.0).collect()
    assert {x.event_id: x.matched for x in got} == want and len(got) == len(rows)

    def no_index(*_):
        raise AssertionError("an index for short groups")

    monkeypatch.setattr(ev, "index_sequence", no_index)
    got = ev.match_events(left.filter("k = 'short' or k is null"), right, spec.__class__(keys=("k",), chunk_rows=1000), 1.0).collect()
    assert {x.event_id: x.matched for x in got} == {x.event_id: want[x.event_id] for x in all_rows[0] if x.k != "long"}


def test_common_subsequences_of_many_groups_in_a_call(log):
    """Groups on one side only and null keys included; no call per group."""
    from lumenlog.operators import evaluate as ev

    a, spec = log([("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c"), ("y", 0, "a"), (None, 0, "a"), (None, 1, "b")])
    b, _ = log([("x", 0, "b"), ("x", 1, "a"), ("x", 2, "c"), ("z", 0, "a"), (None, 1, "b")])
    out = ev.lcs_length(a, b, spec)
    assert {(r.k, r.lcs, r.n1, r.n2) for r in out.collect()} == {("x", 2, 3, 3), ("y", 0, 1, 0), ("z", 0, 0, 1), (None, 1, 2, 1)}
    assert "CoGroups" not in out._jdf.queryExecution().toString()


def test_feature_families_carry_no_columns_of_others(log, monkeypatch):
    """Every stored family is as wide as what it adds; all columns are there at the end, one row per event."""
    from lumenlog.plans import composite

    widths, keep = [], composite.materialise
    monkeypatch.setattr(composite, "materialise", lambda df, name="table": widths.append(set(df.columns)) or keep(df, name))
    rows, spec = log([(k, i, "abc"[i * i % 3]) for k in ("x", None) for i in range(15)], chunk_rows=64)
    out = composite.extract_all_features(rows, spec, F.current_timestamp(), ["a", "b"])
    assert out.count() == 30
    assert {"time_since_previous", "window_entropy_10", "cumulative_freq_a", "prev_transition_prob", "transition_diversity", "consecutive_count", "hour"} <= set(out.columns)
    assert all("hour" not in w and len({"prev_transition_prob", "window_entropy_10", "cumulative_freq_a"} & w) <= 1 for w in widths)


def test_large_batches_of_the_replay_have_several_files(spark, monkeypatch):
    """As many in every batch, none empty, and the ordered stream still gives the SQL's rows."""
    import glob

    from lumenlog.plans import streaming_queries as sq
    from lumenlog.plans.registry import Tables

    monkeypatch.setattr(sq, "PIECE_ROWS", 50)
    monkeypatch.setattr(sq, "FEWEST_ROWS", 10)
    monkeypatch.setattr(sq, "_FOLDERS", {})
    sf = "/root/testdata/sf0.001"
    sq.replay(Tables(spark, sf))
    (path, _, pieces), = sq._FOLDERS.values()
    written = glob.glob(f"{path}/*.parquet")
    assert pieces > 1 and len(written) == sq.FILES * pieces
    assert all(spark.read.parquet(f).count() for f in written)
    ok, message, _, _ = compare("t6_stream_metadata", spark, sf, duck(sf), entry.queries(), entry.oracle_sql())
    assert ok, message


def test_curves_of_many_channels_are_fitted_together(spark):
    """A pass serves many channels of unlike lengths, and gives each what a pass of its own gives."""
    import numpy as np

    from lumenlog.operators import fit

    rows = []
    for c in range(30):
        for x in range(3 + c):  # the first channel has too few points
            rows.append((c, float(x), float(5 + c / (1 + np.exp(-(x - c / 2) / 1.5)) + 0.01 * ((x * 7 + c) % 3))))
    points = spark.createDataFrame(rows, "channel_id int, x double, y double").coalesce(1)
    lot = fit._fit_lot
    cells = [tuple(np.array(a, dtype=float) for a in zip(*[(x, y, 1, 0) for k, x, y in rows if k == c])) for c in range(30)]
    together, apart = lot("sigmoid", cells), [lot("sigmoid", [c])[0] for c in cells]
    assert "fewer points" in together[0]["error"] and all(r["error"] is None for r in together[1:])
    for a, b in zip(together[1:], apart[1:]):
        assert a["rmse"] == pytest.approx(b["rmse"], rel=1e-6, abs=1e-9) and a["r_squared"] == pytest.approx(b["r_squared"], abs=1e-9)
    out = fit.curve_fit(points, "sigmoid")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got = {r.channel_id: r for r in out.collect()}
    assert sorted(got) == list(range(30)) and got[0].error
    for c in range(1, 30):
        assert got[c].rmse == pytest.approx(together[c]["rmse"], rel=1e-6, abs=1e-9)


def test_forest_draws_are_compiled_and_scores_are_those_of_single_walks(spark):
    """No draw in a lambda (those are interpreted), nothing but the score and the label added, and each score by hand."""
    import math

    import numpy as np

    from lumenlog.operators import anomaly as an

    rows = spark.range(3000).withColumns({"a": (F.col("id") * 37 % 101).cast("double"), "b": F.when(F.col("id") % 50 != 0, F.sqrt("id"))})
    grown, plans = [], []
    group = type(rows).groupBy

    def seen(self, *by):
        if by == ("tree",):
            plans.append(self._jdf.queryExecution().optimizedPlan().toString())
            grown.extend(self.collect())
        return group(self, *by)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "groupBy", seen)
        out = an.isolation_forest(rows, ["a", "b"], "id", trees=5)
    assert "lambda" not in plans[0]
    assert set(out.columns) == {"id", "a", "b", "isolation_score", "isolation_forest_anomaly"} and out.count() == 3000
    pdf = out.toPandas().sort_values("id")
    x = np.column_stack([pdf[c].fillna(0.0) for c in "ab"])
    x = (x - x.mean(axis=0)) / x.std(axis=0)

    def walk(tree, rows_in, at, level, rng, total):
        lo, hi = tree[rows_in].min(axis=0), tree[rows_in].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if level >= 8 or len(rows_in) <= 1 or not len(usable):
            total[at] += level + an._path_constant(len(rows_in))
            return
        f = int(rng.choice(usable))
        s = float(rng.uniform(lo[f], hi[f]))
        below = tree[rows_in, f] <= s
        walk(tree, rows_in[below], at[x[at, f] <= s], level + 1, rng, total)
        walk(tree, rows_in[~below], at[x[at, f] > s], level + 1, rng, total)

    total, norm = np.zeros(3000), 0.0
    for t in range(5):
        sample = np.array([r["_x"] for r in sorted((r for r in grown if r["tree"] == t), key=lambda r: r["_h"])])[: an.SAMPLE_ROWS]
        assert len(sample) == an.SAMPLE_ROWS and math.ceil(math.log2(len(sample))) == 8
        walk(sample, np.arange(len(sample)), np.arange(3000), 0, np.random.default_rng([42, t]), total)
        norm += an._path_constant(len(sample))
    # A value within rounding of a split may fall on either side.
    assert np.mean(np.abs(pdf["isolation_score"] - np.power(2.0, -total / norm)) < 1e-9) > 0.99


def test_large_fits_fill_whole_rounds_of_tasks(one_file, monkeypatch):
    """Beyond a task per core no partition is left for a round of its own, and none holds more than the most."""
    monkeypatch.setattr(mo, "FIT_ROWS_MOST", 6_600)
    sizes = mo.spread(one_file, 60_000).rdd.glom().map(len).collect()
    cores = one_file.sparkSession.sparkContext.defaultParallelism
    assert len(sizes) > cores and len(sizes) % cores == 0 and sum(sizes) == 60_000 and max(sizes) <= 6_600


def test_each_key_is_optimized_by_its_own_model(log):
    """models with keys overwrote each other in one matrix that the driver collected row by row."""
    rows = [("a", i, "xyz"[i % 3]) for i in range(30)] + [("b", i, "xzy"[i % 3]) for i in range(30)] + [("c", i, "wx"[i * i % 5 % 2]) for i in range(23)]
    df, spec = log(rows, chunk_rows=7)
    models = rc.train_models(df, spec)
    p = {(r["k"], r["state"][-1], r["next_event"]): r["prob"] for r in models["markov"].collect()}
    # The rows to optimize differ from those that were learned from.
    noisy = [(k, s, sorted({r[2] for r in rows if r[0] == k})[0] if s % 4 == 2 else e) for k, s, e in rows]
    out = rc.optimize_sequence(log(noisy, chunk_rows=7)[0], spec, models["markov"], models["probabilities"], factor=1.1).toPandas()
    changed = 0
    for k, g in out.sort_values(["k", "_pos"]).groupby("k"):
        events, types = g["event"].tolist(), sorted({e for q, _, e in rows if q == k})
        prob = lambda a, b: p.get((k, a, b), 0.1)
        for i in range(len(events) - 2):
            a, b, c = events[i : i + 3]
            best = max(types, key=lambda x: prob(a, x) * prob(x, c))
            if prob(a, best) * prob(best, c) > prob(a, b) * prob(b, c) * 1.1:
                events[i + 1] = best
                changed += 1
        assert g["optimized_event"].tolist() == events
    assert changed


@pytest.mark.parametrize("mode, order", [("argmax", 1), ("sample", 1), ("sample", 2)])
def test_models_joined_at_once_draw_as_step_by_step(log, monkeypatch, mode, order):
    rows = [(k, i * 10 + (i > 20) * 500 + (i > 31) * 900, "xyzw"[i * i % 7 % 4]) for k in "ab" for i in range(40)]
    df, spec = log(rows, chunk_rows=8)
    models = rc.train_models(df, spec, order)
    gaps = rc.significant_gaps(df, spec, ag.gap_model(df, spec, median=False), 0.5)
    draw = lambda: sorted(map(str, rc.markov_fill(df, spec, models["markov"], models["probabilities"], gaps, order, mode).collect()))
    once = draw()
    monkeypatch.setattr(rc, "MAX_TOGETHER", -1)
    assert once and once == draw()
