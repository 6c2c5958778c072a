"""Row features of ordered event sequences.

Every function takes an indexed log (``index_sequence``) and returns its rows with more columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.calendar import calendar_parts, weekend_business_flags
from lumenlog.functions.seq import (
    POS,
    SIZE,
    SeqSpec,
    attach,
    gap,
    index_sequence,
    null_safe_join,
    over_rows,
    run_bounds,
    running,
    seconds,
    sequence_stats,
    totals_by,
)
from lumenlog.functions.stats import attach_percentiles, ratio

# Small numbers that keep divisions and logarithms finite.
EPS_RATE = 1e-6
EPS_LOG = 1e-10


def gap0(spec: SeqSpec) -> dict[str, Column]:
    """Window step: seconds since the previous event, 0 for the first."""
    return {"time_since_previous": F.coalesce(gap(spec)["gap"], F.lit(0.0))}


def full(width: int, value: Column) -> Column:
    """``value`` where a frame of ``width`` rows is full, else NULL."""
    return F.when(F.col(POS) >= width - 1, value)


def stream_metadata(df: DataFrame, spec: SeqSpec) -> DataFrame:
    ts = F.col(spec.ts)
    parts = calendar_parts(ts)
    out = over_rows(df, spec, gap0)
    return out.withColumns(
        {
            "hour_of_day": parts["hour"],
            "day_of_week": parts["day_of_week"],
            "is_weekend": weekend_business_flags(ts)["is_weekend"] == 1,
            "event_sequence": F.col(POS),
        }
    )


def temporal_features(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Time to the neighbours and to both ends of the sequence, and relative time position."""
    ts = F.col(spec.ts)
    out = over_rows(
        df,
        spec,
        gap0,
        lambda s: {"time_until_next": F.coalesce(F.abs(seconds(F.lead(s.ts).over(s.window), ts)), F.lit(0.0))},
        before=1,
        after=1,
    )
    ends = sequence_stats(df, spec, F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    out = attach(out, ends, spec)
    since, until = seconds(ts, F.col("_t0")), seconds(F.col("_t1"), ts)
    total = seconds(F.col("_t1"), F.col("_t0"))
    return out.withColumns(
        {
            "time_since_first": since,
            "time_until_last": until,
            "relative_time_position": F.coalesce(ratio(since, total), F.lit(0.0)),
        }
    ).drop("_t0", "_t1")


def rolling_gap_statistics(df: DataFrame, spec: SeqSpec, widths: Sequence[int] = (3, 5, 10)) -> DataFrame:
    def frames(s: SeqSpec) -> dict[str, Column]:
        out = {}
        for w in widths:
            over = s.rows(-(w - 1))
            mean = full(w, F.avg("time_since_previous").over(over))
            std = full(w, F.stddev_samp("time_since_previous").over(over))
            out |= {
                f"time_gap_mean_{w}": mean,
                f"time_gap_std_{w}": std,
                f"time_gap_cv_{w}": std / (mean + EPS_RATE),
            }
        return out

    return over_rows(df, spec, gap0, frames, before=max(widths))


def gap_distribution(df: DataFrame, spec: SeqSpec, percents: Sequence[int] = (25, 50, 75, 90, 95)) -> DataFrame:
    """Percentiles, skewness and excess kurtosis (population forms) of the gaps of the sequence."""
    out = over_rows(df, spec, gap0)
    ps = {f"time_gap_percentile_{p}": p / 100 for p in percents}
    out = attach_percentiles(out, spec, "time_since_previous", ps)
    g = F.col("time_since_previous")
    shape = sequence_stats(
        out, spec, F.skewness(g).alias("time_gap_skewness"), F.kurtosis(g).alias("time_gap_kurtosis")
    )
    return attach(out, shape, spec)


def rolling_event_rate(df: DataFrame, spec: SeqSpec, width: int = 10) -> DataFrame:
    widths = [width, width * 2, width * 4]

    def frames(s: SeqSpec) -> dict[str, Column]:
        out = {}
        for w in widths:
            n = full(w, F.count(s.event).over(s.rows(-(w - 1))))
            span = F.sum("time_since_previous").over(s.rows(-(w - 1)))
            out |= {f"events_count_{w}": n, f"events_per_time_{w}": n / (span + EPS_RATE)}
        return out

    return over_rows(df, spec, gap0, frames, before=max(widths))


def rolling_type_frequency(df: DataFrame, spec: SeqSpec, types: Sequence[str], width: int = 10) -> DataFrame:
    def frames(s: SeqSpec) -> dict[str, Column]:
        out = {}
        for t in types:
            n = full(width, F.sum(F.when(F.col(s.event) == t, 1).otherwise(0)).over(s.rows(-(width - 1))))
            out |= {f"freq_{t}_{width}": n, f"prop_{t}_{width}": n / F.lit(float(width))}
        return out

    return over_rows(df, spec, frames, before=width)


def type_frequency(df: DataFrame, spec: SeqSpec, types: Sequence[str]) -> DataFrame:
    """Share of each event type in the whole sequence and up to the current row."""
    is_type = {t: F.when(F.col(spec.event) == t, 1).otherwise(0) for t in types}
    out = running(df, spec, {f"_c_{t}": ("sum", c) for t, c in is_type.items()})
    totals = sequence_stats(df, spec, *[F.avg(c).alias(f"global_freq_{t}") for t, c in is_type.items()])
    out = attach(out, totals, spec)
    shares = {f"cumulative_freq_{t}": F.col(f"_c_{t}") / (F.col(POS) + 1) for t in types}
    return out.withColumns(shares).drop(*[f"_c_{t}" for t in types])


def burst_features(df: DataFrame, spec: SeqSpec, threshold: float = 1.0) -> DataFrame:
    """Rapid-succession flag, rows in the current burst, seconds to the last burst in the data."""
    out = over_rows(
        df,
        spec,
        gap0,
        lambda s: {"is_burst_event": (F.col("time_since_previous") < threshold).cast("int")},
        lambda s: {"_change": F.coalesce(F.lag("is_burst_event").over(s.window) != F.col("is_burst_event"), F.col(POS) == 0)},
        before=2,
    )
    out = run_bounds(out, spec, F.col("_change") | (F.col(POS) == 0), "burst")
    last = sequence_stats(out, spec, F.max(F.when(F.col("is_burst_event") == 1, F.col(spec.ts))).alias("_last"))
    out = attach(out, last, spec)
    return out.withColumns(
        {
            "burst_length": F.col("burst_id") + 1,
            "current_burst_length": F.col("burst_size") * F.col("is_burst_event"),
            "time_since_last_burst": F.coalesce(
                seconds(F.col(spec.ts), F.col("_last")), F.col("time_since_previous")
            ),
        }
    ).drop("_change", "_last", "burst_id", "burst_size", "burst_start")


def transition_features(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Probability of the transition into and out of each row under the sequence's own matrix."""
    ev = F.col(spec.event)
    out = over_rows(df, spec, lambda s: {"_prev": F.lag(s.event).over(s.window)})
    step = F.when(F.col("_prev").isNotNull(), 1).otherwise(0)
    out = totals_by(out, spec, ["_prev", spec.event], _pair=step)
    out = totals_by(out, spec, ["_prev"], _from=step)
    out = out.withColumn("prev_transition_prob", F.coalesce(ratio(F.col("_pair"), F.col("_from")), F.lit(0.0)))
    out = over_rows(
        out,
        spec,
        lambda s: {"next_transition_prob": F.coalesce(F.lead("prev_transition_prob").over(s.window), F.lit(0.0))},
        before=0,
        after=1,
    )
    avg = (F.col("prev_transition_prob") + F.col("next_transition_prob")) / 2
    return out.withColumn("avg_transition_prob", avg).drop("_prev", "_pair", "_from")


def transition_history(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Number of distinct transitions seen so far and its share of the position."""
    out = over_rows(df, spec, lambda s: {"_prev": F.lag(s.event).over(s.window)})
    first = out.filter(F.col("_prev").isNotNull()).groupBy(*spec.keys, "_prev", spec.event)
    first = first.agg(F.min(POS).alias(POS)).select(*spec.keys, POS, F.lit(1).alias("_new"))
    out = null_safe_join(out, first, [*spec.keys, POS], "left")
    out = running(out, spec, {"unique_transitions_seen": ("sum", F.coalesce(F.col("_new"), F.lit(0)))})
    share = F.col("unique_transitions_seen") / (F.col(POS) + 1)
    return out.withColumn("transition_diversity", share).drop("_prev", "_new")


def state_persistence(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Length of the run so far, run-start flag, and probability of staying in the state."""
    ev = F.col(spec.event)
    out = over_rows(
        df,
        spec,
        lambda s: {
            "_start": F.coalesce(F.lag(s.event).over(s.window) != ev, F.lit(True)),
            "_next": F.lead(s.event).over(s.window),
        },
        after=1,
    )
    start = {"_run": ("max", F.when(F.col("_start"), F.col(POS)))}
    out = running(out, spec, start)
    out = totals_by(
        out,
        spec,
        [spec.event],
        _stay=F.when(F.col("_next") == ev, 1).otherwise(0),
        _out=F.when(F.col("_next").isNotNull(), 1).otherwise(0),
    )
    return out.withColumns(
        {
            "consecutive_count": F.col(POS) - F.col("_run") + 1,
            "is_state_start": F.col("_start").cast("int"),
            "state_persistence_prob": F.coalesce(ratio(F.col("_stay"), F.col("_out")), F.lit(0.0)),
        }
    ).drop("_start", "_next", "_run", "_stay", "_out")


def _distinct_in(spec: SeqSpec, width: int) -> Column:
    return F.size(F.collect_set(spec.event).over(spec.rows(-(width - 1))))


def _entropy_in(spec: SeqSpec, width: int) -> Column:
    events = F.collect_list(spec.event).over(spec.rows(-(width - 1)))
    counts = F.transform(F.array_distinct(events), lambda e: F.size(F.filter(events, lambda x: x == e)))
    n = F.size(events)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log(c / n + EPS_LOG))


def rolling_distinct(df: DataFrame, spec: SeqSpec, width: int = 10) -> DataFrame:
    widths = [width, width // 2, width * 2]
    step = lambda s: {f"unique_events_{w}": full(w, _distinct_in(s, w)) for w in widths}
    return over_rows(df, spec, step, before=max(widths))


def rolling_entropy(df: DataFrame, spec: SeqSpec, width: int = 10, prefix: str = "window_entropy") -> DataFrame:
    widths = [width, width // 2, width * 2]
    step = lambda s: {f"{prefix}_{w}": _entropy_in(s, w) for w in widths}
    return over_rows(df, spec, step, before=max(widths))


def most_common(values: Column) -> Column:
    """Most common array element; the earliest wins a tie."""
    distinct = F.array_distinct(values)
    counts = F.transform(distinct, lambda v: F.size(F.filter(values, lambda x: x == v)))
    return F.try_element_at(distinct, F.array_position(counts, F.array_max(counts)).cast("int"))


def rolling_common_bigram(df: DataFrame, spec: SeqSpec, width: int = 10) -> DataFrame:
    def bigram(s: SeqSpec) -> dict[str, Column]:
        prev = F.lag(s.event).over(s.window)
        return {"_bigram": F.when(prev.isNotNull(), F.concat(prev, F.lit("->"), F.col(s.event)))}

    def pick(s: SeqSpec) -> dict[str, Column]:
        grams = F.collect_list("_bigram").over(s.rows(-(width - 2)))
        return {"_grams": grams}

    out = over_rows(df, spec, bigram, pick, before=width)
    return out.withColumn("common_pattern", F.coalesce(most_common(F.col("_grams")), F.lit(""))).drop("_bigram", "_grams")


def ngram_column(spec: SeqSpec, n: int) -> Column:
    """Event types of rows i..i+n-1 as an array, NULL where fewer rows remain."""
    parts = [F.col(spec.event)] + [F.lead(spec.event, k).over(spec.window) for k in range(1, n)]
    return F.when(F.col(POS) + n <= F.col(SIZE), F.array(*parts))


def ngram_frequency(df: DataFrame, spec: SeqSpec, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    out = over_rows(df, spec, lambda s: {f"_g{n}": ngram_column(s, n) for n in sizes}, before=0, after=max(sizes))
    for n in sizes:
        out = totals_by(out, spec, [f"_g{n}"], _cnt=F.lit(1))
        freq = F.when(F.col(f"_g{n}").isNotNull(), ratio(F.col("_cnt"), F.col(SIZE) - (n - 1)))
        out = out.withColumn(f"{n}gram_freq", F.coalesce(freq, F.lit(0.0))).drop("_cnt", f"_g{n}")
    return out


def run_features(df: DataFrame, spec: SeqSpec, widths: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Size of the run containing the row, and distinct events in trailing windows."""
    out = over_rows(
        df,
        spec,
        lambda s: {"_start": F.coalesce(F.lag(s.event).over(s.window) != F.col(s.event), F.lit(True))}
        | {f"pattern_complexity_{w}": _distinct_in(s, w) for w in widths},
        before=max(widths),
    )
    out = run_bounds(out, spec, (F.col(POS) == 0) | F.col("_start"))
    return out.withColumn("pattern_length", F.col("run_size")).drop("_start", "run_id", "run_size", "run_start")


def repetition_features(df: DataFrame, spec: SeqSpec) -> DataFrame:
    last = {"_last": ("max", F.col(POS))}
    out = running(df, spec, last, by=[spec.event], exclusive=True)
    out = running(out, spec, {"_seen": ("sum", F.lit(1))}, by=[spec.event])
    return out.withColumns(
        {
            "time_since_same_event": F.coalesce(F.col(POS) - F.col("_last"), F.col(POS)),
            "repetition_rate": F.col("_seen") / (F.col(POS) + 1),
            "is_repeated": F.col("_last").isNotNull().cast("int"),
        }
    ).drop("_last", "_seen")


def frequency_rank(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Dense rank of the row's event type by count, most frequent first (one row per type is ranked)."""
    from pyspark.sql import Window

    counts = df.groupBy(*spec.keys, spec.event).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*spec.keys).orderBy(F.desc("_c"))
    ranks = counts.select(*spec.keys, spec.event, F.dense_rank().over(w).alias("event_frequency_rank"))
    return attach(df, ranks, spec, by=[spec.event])


def percentile_rank(df: DataFrame, spec: SeqSpec, value: str, name: str) -> DataFrame:
    """Average-tie percentile rank of ``value`` in its sequence, from a value-ordered index."""
    by_value = SeqSpec(spec.keys, value, spec.event, spec.tiebreak, spec.chunk_rows)
    kept = df.withColumnsRenamed({POS: "_keep_pos", SIZE: "_keep_n"})
    ranked = index_sequence(kept, by_value)
    ties = ranked.groupBy(*spec.keys, value).agg((F.avg(POS) + 1).alias("_rank"))
    ranked = attach(ranked, ties, by_value, by=[value])
    out = ranked.withColumn(name, F.col("_rank") / F.col(SIZE)).drop(POS, SIZE, "_rank")
    return out.withColumnsRenamed({"_keep_pos": POS, "_keep_n": SIZE})


def statistical_features(df: DataFrame, spec: SeqSpec, width: int = 5) -> DataFrame:
    out = over_rows(
        df,
        spec,
        gap0,
        lambda s: {
            "rolling_event_count": full(width, F.count(s.event).over(s.rows(-(width - 1)))),
            "rolling_unique_events": full(width, _distinct_in(s, width)),
            "rolling_mean_gap": full(width, F.avg("time_since_previous").over(s.rows(-(width - 1)))),
            "rolling_std_gap": full(width, F.stddev_samp("time_since_previous").over(s.rows(-(width - 1)))),
        },
        before=width,
    )
    return percentile_rank(frequency_rank(out, spec), spec, "time_since_previous", "time_gap_percentile")


def sequence_normalisation(df: DataFrame, spec: SeqSpec) -> DataFrame:
    first = sequence_stats(df, spec, F.min(spec.ts).alias("_t0"))
    out = attach(df, first, spec)
    out = running(out, spec, {"event_type_count": ("sum", F.lit(1))}, by=[spec.event])
    hours = seconds(F.col(spec.ts), F.col("_t0")) / 3600
    return out.withColumns(
        {
            "sequence_index": F.col(POS),
            "relative_position": F.coalesce(ratio(F.col(POS), F.col(SIZE) - 1), F.lit(0.0)),
            "events_per_hour": F.col(POS) / (hours + EPS_RATE),
        }
    ).drop("_t0")


# Event sequences that should stay continuous, and start and end events.
EXPECTED_SEQUENCES = [["start", "process", "complete"], ["begin", "work", "end"], ["init", "execute", "finish"]]
START_EVENTS = ["start", "begin", "init"]
END_EVENTS = ["end", "complete", "finish"]


def missing_event_flags(
    df: DataFrame, spec: SeqSpec, max_gap: float = 300.0, sequences: Sequence[Sequence[str]] = EXPECTED_SEQUENCES
) -> DataFrame:
    """Large-gap flag and size, and a flag for two events of one rule that are not adjacent in it."""

    def broken(prev: Column, cur: Column) -> Column:
        hit = F.lit(False)
        for rule in sequences:
            arr = F.array(*[F.lit(e) for e in rule])
            a, b = F.array_position(arr, prev), F.array_position(arr, cur)
            hit = hit | F.coalesce((a > 0) & (b > 0) & (b != a + 1), F.lit(False))
        return hit

    return over_rows(
        df,
        spec,
        gap0,
        lambda s: {
            "large_gap": F.col("time_since_previous") > max_gap,
            "gap_size": F.when(F.col("time_since_previous") > max_gap, F.col("time_since_previous")).otherwise(0.0),
            "sequence_break": broken(F.lag(s.event).over(s.window), F.col(s.event)),
        },
    )


def pattern_violations(
    df: DataFrame,
    spec: SeqSpec,
    starts: Sequence[str] = START_EVENTS,
    ends: Sequence[str] = END_EVENTS,
    lookahead: int = 10,
) -> DataFrame:
    """A start event followed by another start inside the lookahead (at its last row: only without an end)."""
    ahead = over_rows(
        df, spec, lambda s: {"_ahead": F.collect_list(s.event).over(s.rows(1, lookahead))}, before=0, after=lookahead
    )
    a, n = F.col("_ahead"), F.size("_ahead")
    is_start = lambda e: e.isin(list(starts))
    inner = F.exists(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), is_start)
    at_end = is_start(F.try_element_at(a, F.lit(-1))) & ~F.exists(a, lambda e: e.isin(list(ends)))
    hit = is_start(F.col(spec.event)) & (inner | F.coalesce(at_end, F.lit(False)))
    return ahead.withColumn("pattern_violation", hit).drop("_ahead")


def repair_timestamps(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Strictly increasing millisecond timestamps in row order: running max of (ms - i), plus i."""
    ms = F.unix_millis(spec.ts)
    out = running(df, spec, {"_m": ("max", ms - F.col(POS))})
    return out.withColumn("repaired_ts", F.timestamp_millis(F.col("_m") + F.col(POS))).drop("_m")


def spread_same_timestamp(
    df: DataFrame, spec: SeqSpec, priority: Mapping[str, int] | None = None, default: int = 5
) -> DataFrame:
    """Deduplicate (ts, event), then move the k-th other event of a timestamp by k milliseconds.

    After the deduplication a timestamp holds at most one row per event type.
    """
    from pyspark.sql import Window

    from lumenlog.sources.events import deduplicate

    out = deduplicate(df, spec)
    rank = F.lit(default)
    if priority:
        pairs = [F.lit(x) for kv in priority.items() for x in kv]
        rank = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(spec.event)), rank)
        order = [rank, F.col(spec.tiebreak)]
    else:
        order = [F.col(spec.tiebreak)]
    k = F.row_number().over(Window.partitionBy(*spec.keys, spec.ts).orderBy(*order)) - 1
    return out.withColumn("_k", k).withColumn(
        "spread_ts", F.timestamp_micros(F.unix_micros(spec.ts) + F.col("_k") * 1000)
    ).drop("_k")


def swap_end_before_start(
    df: DataFrame, spec: SeqSpec, starts: Sequence[str] = START_EVENTS, ends: Sequence[str] = END_EVENTS, shared: str | None = None
) -> DataFrame:
    """Adjacent (end, start) rows exchange their content other than key, time and order columns.

    ``shared`` names a column to add: whether the row before or behind has the same time.
    """
    fixed = {*spec.keys, spec.ts, spec.tiebreak, POS, SIZE}
    moved = [c for c in df.columns if c not in fixed]

    def step(s: SeqSpec) -> dict[str, Column]:
        ev = F.col(s.event)
        prev, nxt = F.lag(s.event).over(s.window), F.lead(s.event).over(s.window)
        first = F.coalesce(ev.isin(list(ends)) & nxt.isin(list(starts)), F.lit(False))
        second = F.coalesce(prev.isin(list(ends)) & ev.isin(list(starts)), F.lit(False))
        return {
            f"_new_{c}": F.when(first, F.lead(c).over(s.window)).when(second, F.lag(c).over(s.window)).otherwise(F.col(c))
            for c in moved
        } | ({shared: F.lag(s.ts).over(s.window).eqNullSafe(F.col(s.ts)) | F.lead(s.ts).over(s.window).eqNullSafe(F.col(s.ts))} if shared else {})

    out = over_rows(df, spec, step, before=1, after=1)
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in moved else F.col(c) for c in df.columns], *([shared] if shared else []))


def local_maxima(
    df: DataFrame, spec: SeqSpec, value: str, threshold: float | None = None, min_distance: int = 1
) -> DataFrame:
    """Strict local maxima above a threshold (default mean + 2 population sd), kept at least
    ``min_distance`` positions apart, first come first kept."""
    out = over_rows(
        df,
        spec,
        lambda s: {"_l": F.lag(value).over(s.window), "_r": F.lead(value).over(s.window)},
        before=1,
        after=1,
    )
    if threshold is None:
        limit = sequence_stats(df, spec, (F.avg(value) + 2 * F.stddev_pop(value)).alias("_limit"))
        out = attach(out, limit, spec)
    else:
        out = out.withColumn("_limit", F.lit(float(threshold)))
    v = F.col(value)
    peaks = out.filter((v > F.col("_l")) & (v > F.col("_r")) & (v > F.col("_limit"))).drop("_l", "_r", "_limit")
    if min_distance <= 1:
        return peaks
    from lumenlog.operators.scans import greedy_spacing

    return greedy_spacing(peaks, spec, min_distance)
