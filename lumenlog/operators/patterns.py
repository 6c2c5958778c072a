"""Pattern mining over indexed event sequences, and pattern-set reports.

A pattern table has ``pattern ARRAY<STRING>``, ``length``, ``count``, ``support`` and ``type``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.seq import POS, SIZE, SeqSpec, attach_row, index_sequence, null_safe_join, over_rows, running, seconds
from lumenlog.functions.storage import materialise
from lumenlog.functions.stats import exact_percentiles, ratio, safe_corr
from lumenlog.operators.sequence_features import EPS_RATE, ngram_column


def ngram_rows(df: DataFrame, spec: SeqSpec, min_length: int, max_length: int) -> DataFrame:
    """One row per position and length: the event types starting there."""
    ahead = max_length - 1
    grams = over_rows(
        df,
        spec,
        lambda s: {f"_g{n}": ngram_column(s, n) for n in range(min_length, max_length + 1)},
        before=0,
        after=max(ahead, 1),
    )
    arrays = F.array_compact(F.array(*[F.col(f"_g{n}") for n in range(min_length, max_length + 1)]))
    return grams.select(*spec.keys, POS, SIZE, F.explode(arrays).alias("pattern"))


def frequent_patterns(
    df: DataFrame,
    spec: SeqSpec,
    min_support: float = 0.05,
    min_length: int = 2,
    max_length: int = 5,
    denominator: str = "windows",
) -> DataFrame:
    """Contiguous patterns with count >= int(min_support * windows), or of all rows with ``denominator="rows"``."""
    grams = ngram_rows(df, spec, min_length, max_length)
    counts = grams.groupBy(*spec.keys, "pattern").agg(F.count("*").alias("count"), F.max(SIZE).alias("_n"))
    counts = counts.withColumn("length", F.size("pattern"))
    base = F.col("_n") - F.col("length") + 1 if denominator == "windows" else F.col("_n")
    longest = F.col("length") <= F.col("_n") - 1
    out = counts.filter(longest & (F.col("count") >= F.floor(F.lit(min_support) * base)))
    return out.select(
        *spec.keys, "pattern", "length", "count", (F.col("count") / base).alias("support"), F.lit("frequent").alias("type")
    )


def gapped_patterns(
    df: DataFrame, spec: SeqSpec, length: int = 3, max_gap: int = 5, min_support: float = 0.05, max_length: int | None = None
) -> DataFrame:
    """Ordered subsequences of ``length`` to ``max_length`` events, successive ones 1..max_gap positions apart, counted by occurrence.

    A dynamic programme over (pattern, events ahead of its end): path counts move forward, and ends with the same events
    ahead are one row wherever they are, so rows become fewer as patterns grow. The second event is merged only where
    few events are left ahead; else hardly two rows are equal, and a shuffle would carry them all. The log is not joined
    with itself. An occurrence has at most ``max_gap`` longer ones by one event; a prefix too rare to reach the least
    count at any length left is not grown. Sequences no longer than a pattern do not count for it.
    """
    keys, top = list(spec.keys), max_length or length
    if not 1 <= length <= top:
        raise ValueError("lengths from 1 on, the longest at least the shortest")
    reach = (top - 1) * max_gap
    spec = replace(spec, chunk_rows=max(spec.chunk_rows, reach))
    state = df.select(*keys, POS, SIZE, spec.event).withColumn("_e", F.struct(spec.event))
    state = over_rows(state, spec, lambda s: {"_ahead": F.collect_list("_e").over(s.rows(1, max(reach, 1)))}, before=0, after=max(reach, 1))
    state = state.select(*keys, SIZE, F.array(spec.event).alias("pattern"), F.lit(1).cast("long").alias("_paths"), "_ahead")
    least, found = F.floor(F.lit(min_support) * F.col("_n")), None
    for level in range(1, top + 1):
        if level > 1:
            steps = F.posexplode(F.slice("_ahead", 1, max_gap)).alias("_d", "_next")
            state = state.select(*keys, SIZE, "pattern", "_paths", "_ahead", steps)
            left = F.slice("_ahead", F.col("_d") + 2, (top - level) * max_gap)
            state = state.select(*keys, SIZE, F.array_append("pattern", F.col("_next")[spec.event]).alias("pattern"), "_paths", left.alias("_ahead"))
            if level < top and (level > 2 or top - level == 1):
                state = materialise(state.groupBy(*keys, SIZE, "pattern", "_ahead").agg(F.sum("_paths").alias("_paths")), "gapped")
        counts = state.groupBy(*keys, "pattern").agg(F.sum("_paths").alias("count"), F.max(SIZE).alias("_n"))
        if 1 < level < top:
            counts = materialise(counts, "counts")
        if level >= length:
            here = counts.filter((F.col("count") >= least) & (F.col("_n") > level))
            found = here if found is None else found.unionByName(here)
        if 1 < level < top:
            hopeful = counts.filter(F.col("count") * max_gap ** (top - level) >= least).select(*keys, "pattern")
            state = null_safe_join(state, hopeful, [*keys, "pattern"])
    return found.select(
        *keys, "pattern", F.size("pattern").alias("length"), "count", (F.col("count") / F.col("_n")).alias("support"),
        F.lit("sequential_with_gaps").alias("type"),
    )


def motif_positions(df: DataFrame, spec: SeqSpec, length: int = 3) -> DataFrame:
    """Every position of every motif (one row each) with the distance to the motif's previous one."""
    grams = ngram_rows(df, spec, length, length)
    last = running(grams, spec, {"_last": ("max", F.col(POS))}, by=["pattern"], exclusive=True)
    return last.withColumn("spacing", F.col(POS) - F.col("_last")).drop("_last")


def motifs(df: DataFrame, spec: SeqSpec, length: int = 3, share: float = 0.02) -> DataFrame:
    """Short patterns seen at least max(2, int(share * N)) times, with spacing statistics."""
    rows = motif_positions(df, spec, length)
    out = rows.groupBy(*spec.keys, "pattern").agg(
        F.count("*").alias("count"),
        F.coalesce(F.avg("spacing"), F.lit(0.0)).alias("avg_spacing"),
        F.coalesce(F.stddev_pop("spacing"), F.lit(0.0)).alias("spacing_std"),
        F.max(SIZE).alias("_n"),
    )
    keep = F.col("count") >= F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("_n")))
    return out.filter(keep).select(
        *spec.keys, "pattern", F.size("pattern").alias("length"), "count", "avg_spacing", "spacing_std", F.lit("motif").alias("type")
    )


def periodic_patterns(df: DataFrame, spec: SeqSpec, threshold: float = 0.7, max_lag: int = 9) -> DataFrame:
    """Per event type: lags at which its interval series correlates with itself above ``threshold``."""
    typed = spec.by(spec.event)
    series = index_sequence(df.select(*spec.keys, spec.ts, spec.event, spec.tiebreak), typed)
    lags = range(2, max_lag + 1)
    rows = over_rows(
        series,
        typed,
        lambda s: {"_iv": seconds(F.col(s.ts), F.lag(s.ts).over(s.window))},
        lambda s: {f"_l{k}": F.lag("_iv", k).over(s.window) for k in lags},
        before=max_lag + 1,
    )
    iv = F.col("_iv")
    aggs = [F.max(SIZE).alias("count")]
    for k in lags:
        aggs.append(safe_corr(F.col(f"_l{k}"), iv).alias(f"_c{k}"))
        aggs.append(F.avg(F.when(F.col(POS) <= k, iv)).alias(f"_m{k}"))
    stats = rows.groupBy(*typed.keys).agg(*aggs)
    cells = F.array(
        *[F.struct(F.lit(k).alias("period_multiplier"), F.col(f"_c{k}").alias("correlation"), F.col(f"_m{k}").alias("period_seconds")) for k in lags]
    )
    out = stats.select(*spec.keys, F.col(spec.event).alias("event_type"), "count", F.inline(cells))
    # A lag needs fewer positions than there are intervals (count - 1).
    fits = (F.col("count") >= 3) & (F.col("period_multiplier") < F.col("count") - 1)
    return out.filter(fits & (F.col("correlation") > threshold)).withColumn("type", F.lit("periodic"))


def conditional_patterns(df: DataFrame, spec: SeqSpec, lookahead: int = 5, threshold: float = 0.3) -> DataFrame:
    """If-then pairs: distance of the first consequence within ``lookahead`` rows of each condition."""
    ahead = over_rows(
        df, spec, lambda s: {"_ahead": F.collect_list(s.event).over(s.rows(1, lookahead))}, before=0, after=lookahead
    )
    hits = ahead.select(*spec.keys, F.col(spec.event).alias("condition"), "_ahead", F.explode(F.array_distinct("_ahead")).alias("consequence"))
    hits = hits.filter(F.col("condition") != F.col("consequence"))
    counts = hits.groupBy(*spec.keys, "condition", "consequence", F.array_position("_ahead", F.col("consequence")).alias("_d"))
    counts = counts.agg(F.count("*").alias("_c"))
    best = counts.groupBy(*spec.keys, "condition", "consequence").agg(F.min(F.struct(-F.col("_c"), F.col("_d"))).alias("_b"))
    totals = df.groupBy(*spec.keys, F.col(spec.event).alias("condition")).agg(F.count("*").alias("total_conditions"))
    out = null_safe_join(best, totals.filter(F.col("total_conditions") >= 2), [*spec.keys, "condition"])
    count = -F.col("_b")[f"col1"]
    out = out.withColumns(
        {"count": count, "best_distance": F.col("_b")["_d"], "conditional_probability": count / F.col("total_conditions")}
    )
    return out.filter(F.col("conditional_probability") > threshold).drop("_b").withColumn("type", F.lit("conditional"))


def temporal_patterns(df: DataFrame, spec: SeqSpec, min_events: int = 5) -> DataFrame:
    """Dominant event type per hour of day and per weekday with at least ``min_events`` rows."""
    ts = F.col(spec.ts)
    slots = F.array(
        F.struct(F.lit("hourly").alias("pattern_type"), F.hour(ts).alias("time_value")),
        F.struct(F.lit("daily").alias("pattern_type"), F.weekday(ts).alias("time_value")),
    )
    rows = df.select(*spec.keys, F.col(spec.event).alias("dominant_event"), F.inline(slots))
    by = [*spec.keys, "pattern_type", "time_value"]
    counts = rows.groupBy(*by, "dominant_event").agg(F.count("*").alias("_c"))
    best = counts.groupBy(*by).agg(
        F.min(F.struct((-F.col("_c")).alias("neg"), F.col("dominant_event"))).alias("_b"), F.sum("_c").alias("total_events")
    )
    return best.filter(F.col("total_events") >= min_events).select(
        *by, F.col("_b")["dominant_event"].alias("dominant_event"), (-F.col("_b")["neg"]).alias("count"), "total_events",
        (-F.col("_b")["neg"] / F.col("total_events")).alias("dominance_ratio"), F.lit("temporal").alias("type"),
    )


def pattern_instances(df: DataFrame, spec: SeqSpec, pattern: Sequence[str]) -> DataFrame:
    """Start and end position, times and duration of each occurrence of a contiguous pattern."""
    k = len(pattern)
    rows = over_rows(
        df,
        spec,
        lambda s: {"_g": ngram_column(s, k), "end_time": F.lead(s.ts, k - 1).over(s.window) if k > 1 else F.col(s.ts)},
        before=0,
        after=k,
    )
    hit = rows.filter(F.col("_g") == F.array(*[F.lit(e) for e in pattern]))
    return hit.select(
        *spec.keys, F.col(POS).alias("start_index"), (F.col(POS) + k - 1).alias("end_index"), F.col(spec.ts).alias("start_time"),
        "end_time", seconds(F.col("end_time"), F.col(spec.ts)).alias("duration"),
    )


def filter_patterns(
    patterns: DataFrame, min_support: float | None = None, max_length: int | None = None, types: Sequence[str] | None = None
) -> DataFrame:
    keep = F.lit(True)
    if min_support is not None:
        keep = keep & (F.col("support") >= min_support)
    if max_length is not None:
        keep = keep & (F.col("length") <= max_length)
    if types is not None:
        keep = keep & F.col("type").isin(list(types))
    return patterns.filter(keep)


def union_patterns(*tables: DataFrame) -> DataFrame:
    """One table of pattern records; measures a family lacks are NULL."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """One row per type plus a total: counts, mean length, mean and max support, distinct patterns."""
    counts = lambda: [
        F.count("*").alias("total_patterns"), F.avg("length").alias("mean_length"), F.avg("support").alias("mean_support"),
        F.max("support").alias("max_support"), F.countDistinct("pattern").alias("unique_patterns"),
    ]
    return patterns.groupBy("type").agg(*counts()).unionByName(patterns.agg(*counts()).withColumn("type", F.lit("all")))


def compare_patterns(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sizes of both distinct sets, what only one has, what both have, Jaccard and overlap percentage."""
    a = first.select("pattern").distinct().withColumn("_a", F.lit(1))
    b = second.select("pattern").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, "pattern", "full_outer")
    row = both.agg(
        F.count("_a").alias("patterns1"), F.count("_b").alias("patterns2"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"),
        F.count("*").alias("_union"),
    )
    jaccard = F.coalesce(ratio(F.col("common"), F.col("_union")), F.lit(0.0))
    return row.select(
        "patterns1", "patterns2", "common", (F.col("patterns1") - F.col("common")).alias("only1"),
        (F.col("patterns2") - F.col("common")).alias("only2"), jaccard.alias("jaccard"), (jaccard * 100).alias("overlap_percent"),
    )


def top_patterns(patterns: DataFrame, k: int = 10) -> DataFrame:
    name = F.array_join("pattern", " -> ")
    measure = F.coalesce(F.col("support"), F.col("count").cast("double"))
    out = patterns.select(name.alias("name"), "type", "length", "count", measure.alias("measure"))
    return out.orderBy(F.desc("measure"), "name").limit(k)


def pattern_nodes(patterns: DataFrame) -> DataFrame:
    """Event types weighted by the support of the patterns they occur in, once per occurrence."""
    support = F.coalesce(F.col("support"), F.lit(1.0))
    return patterns.select(F.explode("pattern").alias("event"), support.alias("_s")).groupBy("event").agg(F.sum("_s").alias("weight"))


def pattern_edges(patterns: DataFrame) -> DataFrame:
    """Undirected edges between neighbours in a pattern, weighted by the last pattern in support order."""
    support = F.coalesce(F.col("support"), F.lit(1.0))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("pattern") - 1),
        lambda i: F.struct(F.element_at("pattern", i).alias("x"), F.element_at("pattern", i + 1).alias("y")),
    )
    rows = patterns.filter(F.size("pattern") > 1).select(support.alias("_s"), "pattern", F.inline(pairs))
    order = F.struct(-F.col("_s"), F.array_join("pattern", "|"))
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max_by("_s", order).alias("weight"))


def pattern_quality(patterns: DataFrame) -> DataFrame:
    """Quality score of each pattern from support, length, and distinct events, with its band."""
    n = F.coalesce(F.col("length"), F.lit(1)).cast("double")
    size = F.size("pattern")
    score = (
        0.4 * F.coalesce(F.col("support"), F.lit(0.0))
        + 0.2 * F.greatest(1 - F.abs(n - 5) / 5, F.lit(0.0))
        + 0.2 * F.least(n / 10, F.lit(1.0))
        + 0.2 * F.coalesce(ratio(F.size(F.array_distinct("pattern")), size), F.lit(0.0))
    )
    band = F.when(F.col("quality") < 0.3, "Low (0-0.3)").when(F.col("quality") < 0.7, "Medium (0.3-0.7)").otherwise("High (0.7-1.0)")
    return patterns.withColumn("quality", score).withColumn("quality_band", band)


def pattern_metrics(patterns: DataFrame) -> DataFrame:
    """Type counts, length, support, diversity, quality and coverage of a pattern set in one row."""
    scored = pattern_quality(patterns)
    base = scored.agg(
        F.count("*").alias("total_patterns"),
        F.countDistinct("pattern").alias("unique_patterns"),
        F.avg("length").alias("mean_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.stddev_pop("length").alias("std_length"),
        F.avg("support").alias("mean_support"), F.min("support").alias("min_support"), F.max("support").alias("max_support"),
        F.stddev_pop("support").alias("std_support"),
        F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean_quality"), F.min("quality").alias("min_quality"),
        F.max("quality").alias("max_quality"), F.stddev_pop("quality").alias("std_quality"),
        F.count_if(F.col("quality") < 0.3).alias("low_quality"),
        F.count_if((F.col("quality") >= 0.3) & (F.col("quality") < 0.7)).alias("medium_quality"),
        F.count_if(F.col("quality") >= 0.7).alias("high_quality"),
    )
    events = patterns.select(F.explode("pattern").alias("e")).agg(
        F.count("*").alias("_occurrences"), F.countDistinct("e").alias("unique_events_covered")
    )
    out = attach_row(base, events)
    for c in ("length", "support", "quality"):
        out = attach_row(out, exact_percentiles(scored, [], c, {f"median_{c}": 0.5}))
    per = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns(
        {
            "pattern_diversity": per("unique_patterns", "total_patterns"),
            "event_diversity": per("unique_events_covered", "_occurrences"),
            "avg_events_per_pattern": per("unique_events_covered", "total_patterns"),
        }
    ).drop("_occurrences")


def pattern_accuracy(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy on distinct patterns."""
    row = compare_patterns(detected, truth)
    tp, fp, fn = F.col("common"), F.col("only1"), F.col("only2")
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(tp, tp + fp), zero)
    recall = F.coalesce(ratio(tp, tp + fn), zero)
    return row.select(
        tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), precision.alias("precision"),
        recall.alias("recall"), F.coalesce(ratio(2 * precision * recall, precision + recall), zero).alias("f1_score"),
        F.coalesce(ratio(tp, tp + fp + fn), zero).alias("accuracy"),
    )


def pattern_evaluation(detected: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """All pattern metrics and the overall score of one method in one row."""
    out = pattern_metrics(detected)
    if truth is not None:
        out = attach_row(out, pattern_accuracy(detected, truth))
    else:
        out = out.withColumn("f1_score", F.lit(0.0))
    score = (
        0.3 * F.col("pattern_diversity")
        + 0.3 * F.col("mean_quality")
        + 0.2 * F.least(F.col("avg_events_per_pattern") / 5, F.lit(1.0))
        + 0.2 * F.col("f1_score")
    )
    return out.withColumn("overall_score", score)


def compare_pattern_methods(methods: dict[str, DataFrame], truth: DataFrame | None = None) -> DataFrame:
    """One evaluation row per method, best overall score first."""
    rows = [pattern_evaluation(df, truth).withColumn("method", F.lit(name)) for name, df in methods.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.desc("overall_score"), "method")


def detect_patterns(df: DataFrame, spec: SeqSpec, min_support: float = 0.05, min_length: int = 2, max_length: int = 5) -> dict[str, DataFrame]:
    """Every pattern family as its own table over one indexed log; lengths and support hold for the first two."""
    return {
        "frequent": frequent_patterns(df, spec, min_support, min_length, max_length),
        "sequential": gapped_patterns(df, spec, min_length, 5, min_support, max_length),
        "motifs": motifs(df, spec),
        "periodic": periodic_patterns(df, spec),
        "conditional": conditional_patterns(df, spec),
        "temporal": temporal_patterns(df, spec),
    }
