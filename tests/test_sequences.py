"""Chunked sequence operators against plain brute force, with chunks far smaller than the data."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenlog.functions import stats
from lumenlog.functions.seq import SeqSpec, index_sequence, run_bounds, running, with_gap
from lumenlog.operators import evaluate as ev
from lumenlog.operators import patterns as pm
from lumenlog.operators import reconstruct as rc
from lumenlog.operators import scans
from lumenlog.operators import segments as sg
from lumenlog.operators import sequence_features as sf
from lumenlog.operators import similarity as si


def random_rows(n=120, keys="ab", seed=1, types="xyz"):
    rng = random.Random(seed)
    t = 0.0
    out = []
    for _ in range(n):
        t += rng.choice([0.05, 1.0, 2.5, 40.0])
        # Key "a" is hot: most rows belong to it.
        out.append((keys[0] if rng.random() < 0.8 else rng.choice(keys), t, rng.choice(types), rng.random()))
    return out


def collect(df, spec):
    return df.toPandas().sort_values([*spec.keys, "_pos"]).reset_index(drop=True)


@pytest.mark.parametrize("keys", [("k",), ()])
@pytest.mark.parametrize("parts", [1, 8])
def test_index_and_halo(log, keys, parts):
    df, spec = log(random_rows(), keys, 5, parts)
    got = collect(with_gap(df, spec), spec)
    groups = got.groupby("k") if keys else got.groupby(lambda _: 0)
    assert (groups.cumcount() == got["_pos"]).all()
    assert (groups["k"].transform("size") == got["_n"]).all()
    want = groups["ts"].diff().dt.total_seconds()
    assert np.allclose(got["gap"].fillna(-1), want.fillna(-1))


def test_running_matches_cumulative(log):
    df, spec = log(random_rows(), chunk_rows=3)
    out = running(df, spec, {"total": ("sum", F.col("value")), "top": ("max", F.col("value"))}, by=["event"], exclusive=True)
    got = collect(out, spec)
    g = got.groupby(["k", "event"])["value"]
    assert np.allclose(got["total"], g.cumsum() - got["value"])
    back = collect(running(df, spec, {"n": ("sum", F.lit(1))}, backward=True), spec)
    assert (back["n"] == back["_n"] - back["_pos"]).all()


def test_run_bounds(log):
    df, spec = log([("a", i, e) for i, e in enumerate("xxyyyxzzzzzzzx")], chunk_rows=4)
    start = sf.over_rows(df, spec, lambda s: {"_s": F.coalesce(F.lag("event").over(s.window) != F.col("event"), F.lit(True))})
    got = collect(run_bounds(start, spec, F.col("_s") | (F.col("_pos") == 0)), spec)
    assert got["run_size"].tolist() == [2, 2, 3, 3, 3, 1] + [7] * 7 + [1]


def test_percentiles_with_and_without_bracket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(5, 6000), np.zeros(3000)])
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(9000) % 2, "v": values}))
    for accuracy in (1000, 100_000):
        monkeypatch.setattr(stats, "SKETCH_ACCURACY", accuracy)
        got = stats.exact_percentiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}).toPandas().sort_values("g")
        want = pd.DataFrame({"g": np.arange(9000) % 2, "v": values}).groupby("g")["v"].quantile([0.05, 0.5, 0.99]).unstack()
        assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy(), atol=1e-12)


def test_noise_boundary(log):
    from lumenlog.operators.clean import filter_noise

    # A gap equal to the limit is not rapid; the first rapid row of a run survives.
    df, spec = log([("a", t, "x") for t in (0, 0.1, 0.15, 0.2, 0.25, 5)])
    assert [r["event_id"] for r in filter_noise(df, spec, 0.1).orderBy("event_id").collect()] == [0, 1, 2, 5]


def test_session_gap_boundary(log):
    df, spec = log([("a", 0, "x"), ("a", 1800, "y"), ("a", 3600.000001, "z"), ("b", 5, "x")])
    got = collect(sg.segment_by_activity(df, spec, 30, 1), spec)
    assert got["segment_id"].tolist() == [0, 0, 1, 0]


def test_time_windows_skip_last_exact_start(log):
    df, spec = log([("a", 0, "x"), ("a", 30, "y"), ("a", 60, "z")])
    got = collect(sg.segment_by_time(df, spec, 1), spec)
    # The window starting at the last timestamp does not exist.
    assert got["event"].tolist() == ["x", "y"]


def brute_adaptive(events, times, target, lo, hi):
    out, at = [], 0
    while at < len(events):
        best, best_diff = None, float("inf")
        for size in range(lo, min(hi + 1, len(events) - at)):
            e, t = events[at : at + size], times[at : at + size]
            gaps = np.diff(t)
            if size <= 1:
                c = 0.0
            else:
                var = np.var(gaps, ddof=1) if len(gaps) > 1 else float("nan")
                c = (len(set(e)) / size + min(var / (gaps.mean() + 1e-6) / 100, 1.0)) / 2
            if abs(c - target) < best_diff - 1e-12:
                best, best_diff = size, abs(c - target)
        if best is None:
            break
        out.append((at, best))
        at += best
    return out


def test_adaptive_segments(log):
    rows = random_rows(150, "a", 7)
    df, spec = log(rows, chunk_rows=16)
    got = collect(sg.adaptive_segments(df, spec, 0.4, 3, 12), spec)
    want = brute_adaptive([r[2] for r in rows], [r[1] for r in rows], 0.4, 3, 12)
    found = got.groupby("segment_id")["_pos"].agg(["min", "size"])
    assert list(map(tuple, found.to_numpy())) == want


def test_greedy_spacing(log):
    df, spec = log(random_rows(90, "ab", 5), chunk_rows=8)
    picked = df.filter(F.col("value") > 0.4)
    got = collect(scans.greedy_spacing(picked, spec, 4), spec)
    for k, g in picked.toPandas().groupby("k"):
        want, last = [], None
        for p in sorted(g["_pos"]):
            if last is None or p - last >= 4:
                want.append(p)
                last = p
        assert got[got["k"] == k]["_pos"].tolist() == want


def test_match_events_greedy(spark, log):
    left_rows, right_rows = random_rows(80, "ab", 11, "xy"), random_rows(80, "ab", 12, "xy")
    left, spec = log(left_rows, chunk_rows=4)
    right, _ = log(right_rows, chunk_rows=4)
    got = ev.match_events(left, right, spec, 3.0).toPandas()
    used, want = set(), set()
    for i, (k, t, e, *_) in enumerate(left_rows):
        for j, (k2, t2, e2, *_) in enumerate(right_rows):
            if j not in used and k == k2 and e == e2 and abs(t - t2) <= 3.0 + 1e-9:
                used.add(j)
                want.add(i)
                break
    assert set(got[got["matched"]]["event_id"]) == want


def test_optimize_sequence_carry(log):
    rows = random_rows(100, "ab", 21, "xyz")
    df, spec = log(rows, chunk_rows=6)
    plain = SeqSpec((), spec.ts, spec.event, spec.tiebreak, 6)
    glob, _ = log(rows, (), 6)
    models = rc.train_models(glob, plain)
    got = collect(rc.optimize_sequence(df, spec, models["markov"], models["probabilities"], factor=1.1), spec)
    p = {(r["state"][-1], r["next_event"]): r["prob"] for r in models["markov"].collect()}
    prob = lambda a, b: p.get((a, b), 0.1)
    for k, g in got.groupby("k"):
        ev_ = g["event"].tolist()
        for i in range(len(ev_) - 2):
            a, b, c = ev_[i : i + 3]
            best = max("xyz", key=lambda x: prob(a, x) * prob(x, c))
            if prob(a, best) * prob(best, c) > prob(a, b) * prob(b, c) * 1.1:
                ev_[i + 1] = best
        assert g["optimized_event"].tolist() == ev_


def test_gapped_patterns(log):
    rows = random_rows(60, "a", 31)
    df, spec = log(rows, chunk_rows=7)
    events = [r[2] for r in rows]
    want = Counter()
    for i in range(len(events)):
        for j in range(i + 1, min(i + 6, len(events))):
            for m in range(j + 1, min(j + 6, len(events))):
                want[(events[i], events[j], events[m])] += 1
    got = {tuple(r["pattern"]): r["count"] for r in pm.gapped_patterns(df, spec, 3, 5, 0.0).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("support", [0.0, 0.3, 1.5])
def test_gapped_patterns_of_all_lengths(log, support):
    rows = random_rows(40, "ab", 33) + [("c", 1, "x"), ("c", 2, "y")]
    df, spec = log(rows, chunk_rows=5)
    want, sizes = Counter(), Counter(r[0] for r in rows)
    for k in sizes:
        events = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        paths = [(i,) for i in range(len(events))]
        for length in (2, 3, 4):
            paths = [(*p, j) for p in paths for j in range(p[-1] + 1, min(p[-1] + 4, len(events)))]
            if length < len(events):
                want.update((k, tuple(events[i] for i in p)) for p in paths)
    want = {k: n for k, n in want.items() if n >= int(support * sizes[k[0]])}
    got = pm.gapped_patterns(df, spec, 2, 3, support, 4).collect()
    assert {(r["k"], tuple(r["pattern"])): r["count"] for r in got} == want
    assert all(r["length"] == len(r["pattern"]) and r["support"] == r["count"] / sizes[r["k"]] for r in got)


def test_rule_based_reconstruction_corrects_the_filled_log(log):
    """Swap, one row per (time, event), spread by priority, impossible transitions: in this order, after filling."""
    rows = random_rows(60, "ab", 61)
    names = ["start", "process", "complete", "end", "logout", "login", " ", "heartbeat"]
    rows = [(k, s // 3 * 20, names[(i * 5 + ord(e)) % 8]) for i, (k, s, e, *_) in enumerate(rows)]
    df, spec = log(rows, chunk_rows=4)
    filled = rc.fill(df, rc.fill_sequence_events(df, spec), rc.fill_pair_events(df, spec), rc.fill_periodic_events(df, spec))
    filled = rc.with_insert_order(filled, spec).withColumn("us", F.unix_micros("ts")).collect()
    want = []
    for k in "ab":
        seq = sorted(((r.us, r.event_id, r.event, r[rc.METHOD]) for r in filled if r.k == k), key=lambda r: r[:2])
        moved = [list(r) for r in seq]
        for i in range(len(seq) - 1):
            if seq[i][2] in ("end", "complete", "finish") and seq[i + 1][2] in ("start", "begin", "init"):
                moved[i][2:], moved[i + 1][2:] = seq[i + 1][2:], seq[i][2:]
        once = {}
        for r in moved:
            once.setdefault((r[0], r[2]), r)
        at = {}
        for us, i, e, m in sorted(once.values(), key=lambda r: (r[0], rc.EVENT_PRIORITY.get(r[2], 5), r[1])):
            at[us] = at.get(us, -1) + 1
            want.append((k, us + at[us] * 1000, i, e, m))
    for k in "ab":
        seq = sorted((w for w in want if w[0] == k), key=lambda w: w[1:3])
        for a, b in zip(seq, seq[1:]):
            for x, y, new in rc.IMPOSSIBLE_TRANSITIONS:
                if (a[3], b[3]) == (x, y):
                    want.append((k, a[1] + (b[1] - a[1]) // 2, None, new, "impossible_transition"))
    want = sorted((k, us, e, m) for k, us, _, e, m in want if e.strip())
    out = rc.reconstruct_rule_based(df, spec).withColumn("us", F.unix_micros("ts")).collect()
    assert sorted((r.k, r.us, r.event, r[rc.METHOD]) for r in out) == want
    assert any(m == "impossible_transition" for *_, m in want) and any(m == "rule_based_sequence" for *_, m in want)


def test_hybrid_reconstruction_goes_on_from_the_rules(log):
    rows = [("a", i * 10 + (i > 20) * 500 + (i > 31) * 700, "xyz"[i % 3]) for i in range(40)] + [("a", 3000, "start"), ("a", 3010, "complete"), ("a", 3020, "x")]
    df, spec = log(rows, chunk_rows=8)
    out = rc.reconstruct_hybrid(df, spec, mode="argmax").collect()
    kinds = Counter(r[rc.METHOD] for r in out)
    assert kinds["original"] == len(rows) and kinds["rule_based"] >= 1 and kinds["probabilistic"] >= 1
    places = Counter((r.k, r.ts, r.event) for r in out)
    assert max(places.values()) == 1
    alone = rc.reconstruct_probabilistic(index_sequence(rc.reconstruct_rule_based(df, spec), spec), spec, mode="argmax")
    added = {(r.ts, r.event) for r in out if r[rc.METHOD] == "probabilistic"}
    assert added <= {(r.ts, r.event) for r in alone.collect()}
    plain = rc.reconstruct_probabilistic(df, spec, mode="argmax", optimize=False).filter(F.col(rc.METHOD) == "original").count()
    assert plain == len(rows)


def test_lempel_ziv(log):
    rows = random_rows(80, "a", 41)
    df, spec = log(rows, chunk_rows=10)
    events = [r[2] for r in rows]
    seen, count = set(), 0
    for i in range(len(events)):
        for j in range(i + 1, min(i + 10, len(events) + 1)):
            if tuple(events[i:j]) not in seen:
                seen.add(tuple(events[i:j]))
                count += 1
                break
    assert si.lempel_ziv(df, spec).first()["lempel_ziv_complexity"] == pytest.approx(count / len(events))


def test_lcs_and_edit_distance(log):
    a, spec = log([("a", i, e) for i, e in enumerate("xyzxyzzx")])
    b, _ = log([("a", i, e) for i, e in enumerate("xzzyzx")])
    assert ev.lcs_length(a, b, spec).first()["lcs"] == 5
    assert si.edit_distance(a, b, spec, ["x", "y", "z"]).first()["edit_distance"] == 3


def test_repair_timestamps_carries(log):
    df, spec = log([("a", 0, "x"), ("a", 0, "y"), ("a", 0.001, "z"), ("a", 0.5, "x")], chunk_rows=2)
    got = collect(sf.repair_timestamps(df, spec).withColumn("ms", F.unix_millis("repaired_ts")), spec)
    assert got["ms"].tolist() == [0, 1, 2, 500]


def test_empty_and_single_row(log):
    for rows in ([("a", 0, "x")],):
        df, spec = log(rows, chunk_rows=64)
        assert sf.temporal_features(df, spec).count() == 1
        assert sf.transition_features(df, spec).first()["avg_transition_prob"] == 0.0
        assert pm.frequent_patterns(df, spec).count() == 0
    df, spec = log([("a", 0, "x")], chunk_rows=64)
    empty = index_sequence(df.filter("false"), spec)
    assert sf.rolling_gap_statistics(empty, spec).count() == 0
    assert sg.segment_by_activity(empty, spec).count() == 0


def test_sampled_fill_repeats(log):
    df, spec = log(random_rows(200, "ab", 51), chunk_rows=16)
    models = rc.train_models(df, spec)
    small = models["gaps"].withColumns({"mean": F.col("mean") / 10, "std": F.col("std") / 10})
    gaps = rc.significant_gaps(df, spec, small, 0.5)
    fill = lambda d: sorted(map(str, rc.markov_fill(d, spec, models["markov"], models["probabilities"], gaps.repartition(3)).collect()))
    first = fill(df)
    assert first and first == fill(df)


def test_entropy_constant(log):
    df, spec = log([("a", i, "x") for i in range(9)])
    row = si.complexity_metrics(df, spec).first()
    assert row["normalized_entropy"] == 0.0 and math.isclose(row["entropy"], 0.0, abs_tol=1e-9)
