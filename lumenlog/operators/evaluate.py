"""Scores of a reconstructed log against the original or a ground truth, as one-row tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import POS, SeqSpec, attach_row, index_sequence, null_safe_join, over_rows, running, with_gap
from lumenlog.functions.stats import exact_percentiles, ratio
from lumenlog.functions.storage import materialise
from lumenlog.operators.reconstruct import CONFIDENCE, IMPOSSIBLE_TRANSITIONS
from lumenlog.operators.scans import map_cells, scan


def reconstruction_counts(original: DataFrame, reconstructed: DataFrame, method: str) -> DataFrame:
    """Run record: rows before and after, added rows and ratio."""
    row = attach_row(original.agg(F.count("*").alias("original_count")), reconstructed.agg(F.count("*").alias("reconstructed_count")))
    o, r = F.col("original_count"), F.col("reconstructed_count")
    return row.select(F.lit(method).alias("method"), o, r, (r - o).alias("added_count"), F.coalesce(ratio(r, o), F.lit(0.0)).alias("ratio"))


def reconstruction_summary(records: DataFrame) -> DataFrame:
    """Number of runs and mean counts over stored run records."""
    return records.agg(
        F.count("*").alias("runs"), F.avg("added_count").alias("mean_added"), F.avg("ratio").alias("mean_ratio"), F.sum("added_count").alias("total_added")
    )


def _impossible(spec: SeqSpec, rules: Sequence[tuple]) -> dict[str, Column]:
    pairs = F.array(*[F.lit(f"{r[0]}\x1f{r[1]}") for r in rules])
    nxt = F.lead(spec.event).over(spec.window)
    return {
        "_step": nxt.isNotNull(),
        "_bad": F.coalesce(F.array_contains(pairs, F.concat(F.col(spec.event), F.lit("\x1f"), nxt)), F.lit(False)),
    }


def transition_violations(log: DataFrame, spec: SeqSpec, rules=IMPOSSIBLE_TRANSITIONS) -> DataFrame:
    rows = over_rows(log, spec, lambda s: _impossible(s, rules), before=0, after=1)
    return rows.agg(F.count_if("_step").alias("transitions"), F.count_if("_bad").alias("violations"))


def validate_reconstruction(original: DataFrame, reconstructed: DataFrame, spec: SeqSpec, rules=IMPOSSIBLE_TRANSITIONS[:3]) -> DataFrame:
    """Preserved timestamps, time range and types, and absence of impossible pairs; both logs indexed."""
    # A timestamp counts as preserved when it occurs anywhere in the reconstruction.
    stamps = reconstructed.select(F.col(spec.ts).alias("_ts")).distinct()
    kept = original.join(stamps, original[spec.ts] == stamps["_ts"], "left_semi").agg(F.count("*").alias("events_preserved"))
    span = lambda df, p: df.agg(F.count("*").alias(f"{p}_events"), F.min(spec.ts).alias(f"_{p}0"), F.max(spec.ts).alias(f"_{p}1"))
    lost = original.select(spec.event).distinct().join(reconstructed.select(spec.event).distinct(), spec.event, "left_anti")
    row = attach_row(span(original, "original"), span(reconstructed, "reconstructed"))
    for part in (kept, lost.agg(F.count("*").alias("_lost")), transition_violations(reconstructed, spec, rules)):
        row = attach_row(row, part)
    return row.select(
        "original_events", "reconstructed_events", "events_preserved",
        (F.col("reconstructed_events") - F.col("original_events")).alias("new_events"),
        ((F.col("_original0") == F.col("_reconstructed0")) & (F.col("_original1") == F.col("_reconstructed1"))).alias("time_range_preserved"),
        (F.col("_lost") == 0).alias("event_types_preserved"),
        F.coalesce(ratio(F.col("events_preserved"), F.col("original_events")), F.lit(0.0)).alias("preservation_rate"),
        (F.col("violations") == 0).alias("is_logically_consistent"),
    )


def basic_metrics(original: DataFrame, reconstructed: DataFrame, spec: SeqSpec) -> DataFrame:
    a = original.groupBy(spec.event).agg(F.count("*").alias("_a"))
    b = reconstructed.groupBy(spec.event).agg(F.count("*").alias("_b"))
    row = a.join(b, spec.event, "full_outer")
    row = row.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("original_events"), F.coalesce(F.sum("_b"), F.lit(0)).alias("reconstructed_events"),
        F.count("_a").alias("original_event_types"), F.count("_b").alias("reconstructed_event_types"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common_event_types"),
    )
    o, r = F.col("original_events"), F.col("reconstructed_events")
    return row.withColumns(
        {
            "events_added": r - o,
            "reconstruction_ratio": F.coalesce(ratio(r, o), F.lit(0.0)),
            "new_event_types": F.col("reconstructed_event_types") - F.col("common_event_types"),
            "lost_event_types": F.col("original_event_types") - F.col("common_event_types"),
            "event_type_preservation_rate": F.coalesce(ratio(F.col("common_event_types"), F.col("original_event_types")), F.lit(0.0)),
        }
    )


def match_events(left: DataFrame, right: DataFrame, spec: SeqSpec, tolerance: float = 5.0) -> DataFrame:
    """One-to-one matches per (keys, event): each left row, in time order, takes the earliest unused
    right row within the tolerance.  Returns the left rows' keys, event, ts, tiebreak and ``matched``.

    Groups of at most ``chunk_rows`` rows are matched many at a time in one sorted pass; longer ones
    are cut into chunks.
    """
    typed = spec.by(spec.event)
    base = [*typed.keys]
    us = F.unix_micros(spec.ts)

    def side(df: DataFrame, right: int) -> DataFrame:
        return df.select(*base, us.alias("_us"), F.col(spec.tiebreak).alias("_id"), F.lit(right).alias("_right"))

    sizes = side(left, 0).unionByName(side(right, 1)).groupBy(*base).agg(F.count("*").alias("_rows"))
    # At most one group per ``chunk_rows`` rows of the input.
    long = materialise(sizes.filter(F.col("_rows") > spec.chunk_rows).select(*base), "long")
    if long.isEmpty():
        return _match_short(side(left, 0), side(right, 1), typed, spec, tolerance)
    same = lambda df: reduce(and_, [df[c].eqNullSafe(long[c]) for c in base])
    parts = {how: [df.join(long, same(df), how) for df in (left, right)] for how in ("left_semi", "left_anti")}
    short = _match_short(side(parts["left_anti"][0], 0), side(parts["left_anti"][1], 1), typed, spec, tolerance)
    return short.unionByName(_match_long(*parts["left_semi"], spec, tolerance))


def _match_short(left: DataFrame, right: DataFrame, typed: SeqSpec, spec: SeqSpec, tolerance: float) -> DataFrame:
    """Greedy matches of groups that fit into memory; a left row without a time is unmatched."""
    base = [*typed.keys]
    tol = int(round(tolerance * 1e6))
    out_schema = T.StructType([*[left.schema[c] for c in (*base, "_us", "_id")], T.StructField("matched", T.BooleanType())])

    def match(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        from_right = pdf["_right"].to_numpy() == 1
        times = pdf["_us"].fillna(0).astype("int64").tolist()
        first = np.zeros(len(pdf), dtype=bool)
        first[starts] = True
        # Rows of a group are sorted with its right rows in front.
        rights, p, keep, hits, none = [], 0, [], [], pdf["_us"].isna().tolist()
        ids, before = pdf["_id"].tolist(), None
        for i, (new, is_right) in enumerate(zip(first.tolist(), from_right.tolist())):
            if new:
                rights, p, before = [], 0, None
            if is_right:
                if not none[i]:
                    rights.append(times[i])
                continue
            at = (none[i], times[i], ids[i])
            if at == before:
                continue
            before = at
            keep.append(i)
            if none[i]:
                hits.append(False)
                continue
            while p < len(rights) and rights[p] < times[i] - tol:
                p += 1
            hit = p < len(rights) and rights[p] <= times[i] + tol
            p += hit
            hits.append(hit)
        out = pdf.iloc[keep][[*base, "_us", "_id"]].copy()
        out["matched"] = hits
        return out

    done = map_cells(left.unionByName(right), base, match, out_schema, order=[F.desc("_right"), "_us", "_id"])
    return done.select(*base, F.timestamp_micros("_us").alias(spec.ts), F.col("_id").alias(spec.tiebreak), "matched")


def _match_long(left: DataFrame, right: DataFrame, spec: SeqSpec, tolerance: float) -> DataFrame:
    """The same matches for groups of any length.

    Right rows before and inside each left row's tolerance are counted in one merged order.  The
    number of used right rows then follows P <- min(max(P, f) + 1, g), a clamp; clamps compose, so
    the greedy scan runs per chunk without ever holding a whole sequence.
    """
    typed = spec.by(spec.event)
    tol = int(round(tolerance * 1e6))
    us = F.unix_micros(spec.ts)
    base = [*typed.keys]
    # The order value interleaves three kinds at one instant: lower probe, right row, upper probe.
    def entries(df: DataFrame, kind: int, at: Column) -> DataFrame:
        return df.select(*base, (at * 4 + kind).alias("_at"), F.col(spec.tiebreak).alias("_id"), us.alias("_us"), F.lit(kind).alias("_kind"))

    merged = entries(left, 0, us - tol).unionByName(entries(right, 1, us)).unionByName(entries(left, 2, us + tol))
    order = SeqSpec(typed.keys, "_at", spec.event, "_id", spec.chunk_rows)
    counted = running(index_sequence(merged, order), order, {"_before": ("sum", (F.col("_kind") == 1).cast("long"))})
    probes = counted.filter(F.col("_kind") != 1)
    bounds = probes.groupBy(*base, "_us", "_id").agg(
        F.max(F.when(F.col("_kind") == 0, F.col("_before"))).alias("_f"), F.max(F.when(F.col("_kind") == 2, F.col("_before"))).alias("_g")
    )
    lefts = SeqSpec(typed.keys, "_us", spec.event, "_id", spec.chunk_rows)
    rows = index_sequence(bounds, lefts)

    def compose(m, n):
        return np.array([m[0] + n[0], max(m[1] + n[0], n[1]), min(max(m[2] + n[0], n[1]), n[2])], dtype=np.int64)

    def to_map(pdf: pd.DataFrame) -> np.ndarray:
        total = None
        for f, g in zip(pdf["_f"].to_numpy(), pdf["_g"].to_numpy()):
            step = np.array([1, f + 1, g], dtype=np.int64)
            total = step if total is None else compose(total, step)
        return total

    def replay(pdf: pd.DataFrame, starts: np.ndarray, entry: np.ndarray) -> pd.DataFrame:
        begin = dict(zip(starts.tolist(), entry.tolist()))
        p, hits = 0, []
        for i, (f, g) in enumerate(zip(pdf["_f"].to_numpy(), pdf["_g"].to_numpy())):
            p = begin.get(i, p)
            m = max(p, f)
            hits.append(bool(m < g))
            p = min(m + 1, g)
        out = pdf[[*base, "_us", "_id"]].copy()
        out["matched"] = hits
        return out

    out_schema = T.StructType(
        [*[rows.schema[c] for c in (*base, "_us", "_id")], T.StructField("matched", T.BooleanType())]
    )
    done = scan(
        rows, lefts, to_map, replay, out_schema, compose=compose, apply=lambda m, s: int(min(max(s + m[0], m[1]), m[2]))
    )
    return done.select(*base, F.timestamp_micros("_us").alias(spec.ts), F.col("_id").alias(spec.tiebreak), "matched")


def accuracy_metrics(reconstructed: DataFrame, truth: DataFrame, spec: SeqSpec, tolerance: float = 5.0) -> DataFrame:
    hits = match_events(reconstructed, truth, spec, tolerance)
    row = attach_row(
        hits.agg(F.count("*").alias("_rec"), F.count_if("matched").alias("true_positives")), truth.agg(F.count("*").alias("_truth"))
    )
    tp, rec, tru = F.col("true_positives"), F.col("_rec"), F.col("_truth")
    zero = F.lit(0.0)
    p, r = F.coalesce(ratio(tp, rec), zero), F.coalesce(ratio(tp, tru), zero)
    return row.select(
        tp, (rec - tp).alias("false_positives"), (tru - tp).alias("false_negatives"), p.alias("precision"), r.alias("recall"),
        F.coalesce(ratio(2 * p * r, p + r), zero).alias("f1_score"),
        F.when(tp > 0, 1.0).otherwise(0.0).alias("event_type_accuracy"), r.alias("exact_match_rate"),
    )


def time_order_completeness(original: DataFrame, reconstructed: DataFrame, spec: SeqSpec) -> DataFrame:
    """Overlap of the time ranges, range preservation, and agreement in the order of first positions.

    Both logs are indexed.  Order agreement compares, per sequence, every two event types; the pairs
    are counted inside one small array of types.
    """
    us = F.unix_micros(spec.ts)
    span = lambda df, p: df.agg(F.min(us).alias(f"{p}0"), F.max(us).alias(f"{p}1"))
    ends = attach_row(span(original, "_o"), span(reconstructed, "_r"))
    cover = F.least("_r1", "_o1") - F.greatest("_r0", "_o0")
    row = ends.select(
        F.coalesce(F.when(F.col("_o1") > F.col("_o0"), ratio(cover, F.col("_o1") - F.col("_o0"))), F.lit(0.0)).alias("time_completeness"),
        ((F.col("_r0") <= F.col("_o0")) & (F.col("_r1") >= F.col("_o1"))).alias("time_range_preserved"),
    )
    first = lambda df, name: df.groupBy(*spec.keys, spec.event).agg(F.min(POS).alias(name))
    both = null_safe_join(first(original, "_a"), first(reconstructed, "_b"), [*spec.keys, spec.event])
    arrays = both.groupBy(*spec.keys).agg(F.array_sort(F.collect_list(F.struct("_a", "_b"))).alias("_x"))
    x = F.col("_x")
    agree = F.aggregate(
        F.transform(x, lambda p: F.size(F.filter(x, lambda q: (q["_a"] < p["_a"]) & (q["_b"] < p["_b"])))), F.lit(0), lambda a, v: a + v
    )
    order = arrays.agg(F.sum(agree).alias("_agree"), F.sum(F.size(x) * (F.size(x) - 1) / 2).alias("_pairs"))
    return attach_row(row, order).withColumn(
        "event_order_preserved", F.coalesce(ratio(F.col("_agree"), F.col("_pairs")), F.lit(0.0))
    ).drop("_agree", "_pairs")


def lcs_of(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence with one big-integer row (bit-parallel)."""
    masks: dict = {}
    for i, e in enumerate(a):
        masks[e] = masks.get(e, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for e in b:
        u = row & masks.get(e, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def lcs_length(first: DataFrame, second: DataFrame, spec: SeqSpec) -> DataFrame:
    """LCS length of two logs per sequence.  Needs keys: one group is one session or user."""
    if not spec.keys:
        raise ValueError("LCS compares bounded sequences: give keys")
    keys = list(spec.keys)
    fields = [first.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("lcs", T.LongType()), T.StructField("n1", T.LongType()), T.StructField("n2", T.LongType())])

    def side(df: DataFrame, second: int) -> DataFrame:
        return df.select(*keys, F.lit(second).alias("_side"), F.col(spec.ts).alias("_ts"), F.col(spec.tiebreak).alias("_id"), F.col(spec.event).alias("_event"))

    def compare(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        codes, sides = pd.factorize(pdf["_event"])[0].tolist(), np.append(0, np.cumsum(pdf["_side"].to_numpy()))
        out, found = pdf.iloc[starts][keys].copy(), []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
            cut = z - int(sides[z] - sides[a])
            found.append((lcs_of(codes[a:cut], codes[cut:z]), cut - a, z - cut))
        out["lcs"], out["n1"], out["n2"] = map(list, zip(*found))
        return out

    both = side(first, 0).unionByName(side(second, 1))
    return map_cells(both, keys, compare, schema, order=["_side", "_ts", "_id"], drop=["_ts", "_id"])


def completeness_metrics(original: DataFrame, reconstructed: DataFrame, spec: SeqSpec) -> DataFrame:
    row = time_order_completeness(original, reconstructed, spec)
    lcs = lcs_length(original, reconstructed, spec).agg(
        F.coalesce(ratio(F.sum("lcs"), F.sum("n1")), F.lit(0.0)).alias("sequence_completeness")
    )
    return attach_row(row, lcs)


def temporal_metrics(original: DataFrame, reconstructed: DataFrame, spec: SeqSpec) -> DataFrame:
    """Gap mean, sample sd and median of both indexed logs and their consistency."""

    def stats(df: DataFrame, p: str) -> DataFrame:
        gaps = with_gap(df, spec)
        base = gaps.agg(F.avg("gap").alias(f"{p}_mean"), F.stddev_samp("gap").alias(f"{p}_std"))
        return attach_row(base, exact_percentiles(gaps, [], "gap", {f"{p}_median": 0.5}))

    row = attach_row(stats(original, "original"), stats(reconstructed, "reconstructed"))
    dm = F.abs(F.col("original_mean") - F.col("reconstructed_mean"))
    ds = F.abs(F.col("original_std") - F.col("reconstructed_std"))
    return row.withColumns(
        {"gap_mean_difference": dm, "gap_std_difference": ds, "temporal_consistency": 1 / (1 + dm + ds)}
    )


def quality_metrics(original: DataFrame, reconstructed: DataFrame, spec: SeqSpec, rules=IMPOSSIBLE_TRANSITIONS) -> DataFrame:
    """Logical consistency, normalised entropy, plausibility and their mean (reconstructed log indexed)."""
    a = original.groupBy(spec.event).agg(F.count("*").alias("_a"))
    b = reconstructed.groupBy(spec.event).agg(F.count("*").alias("_b"))
    counts = a.join(b, spec.event, "full_outer").na.fill(0, ["_a", "_b"])
    totals = counts.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    counts = attach_row(counts, totals)
    p, q = ratio(F.col("_a"), F.col("_na")), ratio(F.col("_b"), F.col("_nb"))
    types = F.count_if(F.col("_b") > 0)
    entropy = F.coalesce(F.sum(F.when(F.col("_b") > 0, -q * F.log2(q))), F.lit(0.0))
    row = counts.agg(
        F.when(types > 1, entropy / F.log2(F.greatest(types, F.lit(2)))).otherwise(0.0).alias("redundancy_score"),
        F.greatest(1 - F.sum(F.abs(p - q)) / 2, F.lit(0.0)).alias("plausibility_score"),
    )
    row = attach_row(row, transition_violations(reconstructed, spec, rules))
    logical = F.coalesce(1 - ratio(F.col("violations"), F.col("transitions")), F.lit(1.0))
    return row.select(
        logical.alias("logical_consistency"), "redundancy_score", "plausibility_score",
        ((logical + F.col("redundancy_score") + F.col("plausibility_score")) / 3).alias("overall_quality"),
    )


def confidence_metrics(reconstructed: DataFrame) -> DataFrame:
    """Statistics of confidences below 1; certain values when there are none."""
    low = reconstructed.filter(F.col(CONFIDENCE) < 1.0)
    c = F.col(CONFIDENCE)
    row = low.agg(
        F.count("*").alias("_n"), F.avg(c).alias("mean_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        F.stddev_samp(c).alias("std_confidence"), F.avg((c >= 0.8).cast("int")).alias("high_confidence_ratio"),
        F.avg((c < 0.5).cast("int")).alias("low_confidence_ratio"),
    )
    row = attach_row(row, exact_percentiles(low, [], CONFIDENCE, {"median_confidence": 0.5}))
    # What a log without inserted rows reports.
    default = {
        "mean_confidence": 1.0, "median_confidence": 1.0, "min_confidence": 1.0, "max_confidence": 1.0, "std_confidence": 0.0,
        "high_confidence_ratio": 1.0, "low_confidence_ratio": 0.0,
    }
    return row.select(*[F.when(F.col("_n") == 0, F.lit(v)).otherwise(F.col(k)).alias(k) for k, v in default.items()])


def evaluate_reconstruction(
    original: DataFrame, reconstructed: DataFrame, spec: SeqSpec, truth: DataFrame | None = None, tolerance: float = 5.0
) -> DataFrame:
    """Every metric and the overall score in one row; the original is the truth by default."""
    original, reconstructed = _indexed(original, spec), _indexed(reconstructed, spec)
    row = basic_metrics(original, reconstructed, spec)
    for part in (
        accuracy_metrics(reconstructed, truth if truth is not None else original, spec, tolerance),
        completeness_metrics(original, reconstructed, spec),
        temporal_metrics(original, reconstructed, spec),
        quality_metrics(original, reconstructed, spec),
        confidence_metrics(reconstructed),
    ):
        row = attach_row(row, part)
    return with_overall_score(row)


def _indexed(df: DataFrame, spec: SeqSpec) -> DataFrame:
    return df if POS in df.columns else index_sequence(df, spec)


def with_overall_score(row: DataFrame) -> DataFrame:
    # Weights of the overall score.
    weights = {
        "f1_score": 0.3, "sequence_completeness": 0.25, "temporal_consistency": 0.2, "overall_quality": 0.15, "mean_confidence": 0.1,
    }
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return row.withColumn("overall_score", total)


def compare_reconstruction_methods(evaluations: dict[str, DataFrame]) -> DataFrame:
    """One row per method, best overall score first."""
    out = None
    for name, row in evaluations.items():
        row = row.withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("overall_score"), "method")


def largest_gaps(log: DataFrame, spec: SeqSpec, k: int = 5, percentile: float = 0.95) -> DataFrame:
    """The k largest gaps above the percentile of all gaps."""
    gaps = with_gap(log, spec)
    out = attach_row(gaps, exact_percentiles(gaps, [], "gap", {"_limit": percentile}))
    out = out.filter(F.col("gap") > F.col("_limit")).drop("_limit")
    return out.orderBy(F.desc("gap"), spec.tiebreak).limit(k)
