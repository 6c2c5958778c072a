"""Segmentation of ordered logs: every operator returns one table with a segment id per sequence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import (
    CHUNK,
    HALO,
    POS,
    SIZE,
    SeqSpec,
    attach,
    null_safe_join,
    over_rows,
    run_bounds,
    running,
    seconds,
    sequence_stats,
    with_gap,
    with_halo,
)
from lumenlog.functions.stats import mode_by
from lumenlog.operators.scans import follow_jumps, map_cells


def segment_by_time(df: DataFrame, spec: SeqSpec, size_minutes: float = 60, overlap_minutes: float = 0) -> DataFrame:
    """Half-open time windows anchored at the first timestamp; overlapping windows repeat rows.

    Ids number the non-empty windows of a sequence in time order.
    """
    size, step = int(size_minutes * 60e6), int((size_minutes - overlap_minutes) * 60e6)
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")
    us = F.unix_micros(spec.ts)
    ends = sequence_stats(df, spec, F.min(us).alias("_t0"), F.max(us).alias("_t1"))
    out = attach(df, ends, spec)
    d = us - F.col("_t0")
    last = F.least(F.expr(f"(unix_micros({spec.ts}) - _t0) div {step}"), F.expr(f"(_t1 - _t0 - 1) div {step}"))
    first = F.when(d < size, F.lit(0)).otherwise(F.floor((d - size) / step) + 1)
    out = out.withColumn("_k0", first.cast("long")).withColumn("_k1", last.cast("long"))
    out = out.filter((F.col("_k1") >= F.col("_k0")) & (F.col("_t1") > F.col("_t0")))
    out = out.withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    windows = out.select(*spec.keys, "_k").distinct()
    w = Window.partitionBy(*spec.keys).orderBy("_k")
    ids = windows.select(*spec.keys, "_k", (F.row_number().over(w) - 1).alias("segment_id"))
    out = attach(out, ids, spec, by=["_k"])
    start = F.col("_t0") + F.col("_k") * step
    return out.withColumns(
        {
            "segment_start": F.timestamp_micros(start),
            "segment_end": F.timestamp_micros(start + size),
            "segment_duration_minutes": F.lit(float(size_minutes)),
            "relative_time_in_segment": (F.unix_micros(spec.ts) - start) / F.lit(60e6),
        }
    ).drop("_k0", "_k1", "_k", "_t0", "_t1")


def create_time_windows(df: DataFrame, spec: SeqSpec, size_minutes: float = 60, overlap_minutes: float = 0) -> DataFrame:
    """The same windows as ``window_id`` with the row's position in seconds."""
    out = segment_by_time(df, spec, size_minutes, overlap_minutes)
    out = out.withColumn("window_position", F.col("relative_time_in_segment") * 60)
    return out.withColumnsRenamed(
        {"segment_id": "window_id", "segment_start": "window_start", "segment_end": "window_end"}
    ).drop("segment_duration_minutes", "relative_time_in_segment")


def segment_by_events(
    df: DataFrame, spec: SeqSpec, size: int = 100, overlap: int = 0, full_only: bool = False
) -> DataFrame:
    """Count segments starting at 0, step, 2 step, ...; ``full_only`` drops short tails."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the segment")
    first = F.greatest(F.ceil((F.col(POS) - size + 1) / step), F.lit(0)).cast("long")
    last = F.expr(f"{POS} div {step}")
    out = df.withColumn("_k0", first).withColumn("_k1", last).filter(F.col("_k1") >= F.col("_k0"))
    out = out.withColumn("segment_id", F.explode(F.sequence("_k0", "_k1"))).drop("_k0", "_k1")
    start = F.col("segment_id") * step
    if full_only:
        out = out.filter(start + size <= F.col(SIZE))
    end = F.least(start + size, F.col(SIZE))
    return out.withColumns(
        {
            "segment_start_index": start,
            "segment_end_index": end - 1,
            "segment_event_count": end - start,
            "relative_position_in_segment": F.col(POS) - start,
        }
    )


def create_sliding_windows(df: DataFrame, spec: SeqSpec, size: int = 50, step: int = 25) -> DataFrame:
    return segment_by_events(df, spec, size, size - step, full_only=True)


def segment_by_activity(
    df: DataFrame, spec: SeqSpec, max_gap_minutes: float = 30, min_events: int = 5
) -> DataFrame:
    """Sessions: a gap above the limit starts a new one; short sessions are dropped, ids count kept ones."""
    out = with_gap(df, spec)
    out = run_bounds(out, spec, (F.col(POS) == 0) | (F.col("gap") > max_gap_minutes * 60), "seg")
    kept_start = (F.col("seg_size") >= min_events) & (F.col(POS) == F.col("seg_start"))
    out = running(out, spec, {"_kept": ("sum", kept_start.cast("long"))})
    out = out.filter(F.col("seg_size") >= min_events)
    return out.withColumns(
        {
            "segment_id": F.col("_kept") - 1,
            "relative_position_in_segment": F.col(POS) - F.col("seg_start"),
            "segment_event_count": F.col("seg_size"),
        }
    ).drop("seg_id", "seg_start", "seg_size", "_kept")


def segment_by_event_types(df: DataFrame, spec: SeqSpec, delimiters: Sequence[str]) -> DataFrame:
    """A delimiter event (lower-cased compare) opens the next segment, except on the first row."""
    names = [d.lower() for d in delimiters]
    opens = (F.lower(spec.event).isin(names) & (F.col(POS) > 0)).cast("long")
    return running(df, spec, {"segment_id": ("sum", opens)})


def adaptive_segments(
    df: DataFrame, spec: SeqSpec, target: float = 0.5, min_size: int = 10, max_size: int = 200
) -> DataFrame:
    """Greedy segments whose complexity is closest to ``target``.

    The best size from every possible start is found in parallel over chunks; the greedy chain of
    starts is then followed by chunk maps.
    """
    keys = list(spec.keys)
    halo = with_halo(df, spec, before=0, after=max_size)
    us = F.unix_micros(spec.ts)
    slim = halo.select(*keys, CHUNK, POS, SIZE, HALO, F.col(spec.event).alias("_ev"), us.alias("_us"))
    schema = T.StructType(
        [*[slim.schema[k] for k in keys], T.StructField(POS, T.LongType()), T.StructField(SIZE, T.LongType()), T.StructField("_size", T.LongType()),
         T.StructField("segment_complexity", T.DoubleType())]
    )

    def best_sizes(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        m = len(pdf)
        ends = np.repeat([*starts[1:], m], np.diff([*starts, m]))
        cell = np.repeat(np.arange(len(starts)), np.diff([*starts, m]))
        codes = pd.factorize(pdf["_ev"])[0]
        t = pdf["_us"].to_numpy(dtype=np.int64)
        gaps = np.diff(t, prepend=t[0]) / 1e6
        prior = pd.Series(np.arange(m)).groupby([cell, codes]).shift().fillna(-1).to_numpy(dtype=np.int64)
        begin = np.flatnonzero(~pdf[HALO].to_numpy(dtype=bool))
        left = (pdf[SIZE] - pdf[POS]).to_numpy()[begin]
        own, limit = len(begin), ends[begin]
        distinct, mean, m2 = np.zeros(own), np.zeros(own), np.zeros(own)
        best = np.full(own, np.inf)
        size_of, comp_of = np.full(own, -1, dtype=np.int64), np.full(own, np.nan)
        for k in range(1, max_size + 1):
            at = begin + k - 1
            ok = at < limit
            at = np.minimum(at, m - 1)
            distinct += ok & (prior[at] < begin)
            if k > 1:
                delta = gaps[at] - mean
                mean = mean + delta / (k - 1)
                m2 = m2 + delta * (gaps[at] - mean)
            if k < min_size:
                continue
            # A single gap has no variance: that size never wins, as NaN compares false.
            var = m2 / (k - 2) if k > 2 else np.full(own, np.nan)
            complexity = np.zeros(own) if k == 1 else (distinct / k + np.minimum(var / (mean + 1e-6) / 100, 1.0)) / 2
            better = ok & (k < left) & (np.abs(complexity - target) < best)
            best = np.where(better, np.abs(complexity - target), best)
            size_of, comp_of = np.where(better, k, size_of), np.where(better, complexity, comp_of)
        out = pdf.iloc[begin][[*keys, POS, SIZE]].copy()
        out["_size"], out["segment_complexity"] = size_of, comp_of
        return out

    best = map_cells(slim, [*keys, CHUNK], best_sizes, schema)
    nodes = best.withColumn("_next", F.when(F.col("_size") > 0, F.col(POS) + F.col("_size")))
    starts = follow_jumps(nodes, spec, max_size).filter(F.col("_size") > 0)
    rows = null_safe_join(df, starts.select(*keys, POS, "_size", "segment_complexity"), [*keys, POS], "left")
    rows = running(
        rows,
        spec,
        {
            "_start": ("max", F.when(F.col("_size").isNotNull(), F.col(POS))),
            "_len": ("last", F.col("_size")),
            "_cx": ("last", F.col("segment_complexity")),
            "_id": ("sum", F.col("_size").isNotNull().cast("long")),
        },
    )
    inside = F.col(POS) < F.col("_start") + F.col("_len")
    return rows.filter(inside).drop("_size", "segment_complexity").select(
        *[c for c in df.columns],
        (F.col("_id") - 1).alias("segment_id"),
        F.col("_cx").alias("segment_complexity"),
        (F.col(POS) - F.col("_start")).alias("relative_position_in_segment"),
    )


def segment_statistics(
    df: DataFrame, spec: SeqSpec, segment: str = "segment_id", segment_type: str = "unknown"
) -> DataFrame:
    by = [*spec.keys, segment]
    minutes = seconds(F.max(spec.ts), F.min(spec.ts)) / 60
    stats = df.groupBy(*by).agg(
        F.count("*").alias("event_count"),
        F.countDistinct(spec.event).alias("unique_events"),
        minutes.alias("duration_minutes"),
        (F.count("*") / F.greatest(minutes, F.lit(1.0))).alias("events_per_minute"),
    )
    common = mode_by(df, by, spec.event, "most_common_event")
    return null_safe_join(stats, common, by, "left").withColumn("segment_type", F.lit(segment_type))


def micro_batches(df: DataFrame, spec: SeqSpec, size: int = 10) -> DataFrame:
    """Row-count batches of the ordered log."""
    return df.withColumn("batch_id", F.expr(f"{POS} div {size}"))
