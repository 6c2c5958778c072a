"""Cleaning, imputation and validation of event logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenlog.functions.seq import SeqSpec, attach_row, first_per, gap, index_sequence, over_rows
from lumenlog.functions.stats import mode_by, percentile_values, ratio
from lumenlog.sources.events import deduplicate

# Event-name synonyms.
EVENT_SYNONYMS = {
    "start": "begin",
    "begin": "begin",
    "stop": "end",
    "end": "end",
    "pause": "pause",
    "resume": "resume",
    "error": "error",
    "err": "error",
    "warning": "warning",
    "warn": "warning",
    "complete": "complete",
    "finished": "complete",
    "done": "complete",
}


def drop_future(df: DataFrame, ts: str, now: Column) -> DataFrame:
    return df.filter(F.col(ts) <= now)


def drop_too_old(df: DataFrame, ts: str, now: Column, days: int = 3650) -> DataFrame:
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def one_event_per_timestamp(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Rows sharing a timestamp collapse to the first by tiebreak, whatever their event."""
    return first_per(df, [*spec.keys, spec.ts], [spec.tiebreak])


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULL numerics with the exact column median; columns without NULLs keep their values and type.

    An integer column with NULLs stays one where its median is a whole number and becomes DOUBLE otherwise.
    """
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    columns = [c for c in columns if holes[c]]
    medians = percentile_values(df, {c: (c, 0.5) for c in columns}) if columns else {}
    filled = {}
    for c, m in medians.items():
        kind = df.schema[c].dataType
        whole = isinstance(kind, IntegralType) and m is not None and m == int(m)
        filled[c] = F.coalesce(F.col(c).cast(kind if whole else "double"), F.lit(m).cast(kind if whole else "double"))
    return df.withColumns(filled) if filled else df


def impute_mode(df: DataFrame, columns: Sequence[str], fallback: str = "unknown") -> DataFrame:
    """Fill NULL strings with the most common value (smallest on ties), else ``fallback``."""
    for c in columns:
        filled = attach_row(df, mode_by(df, [], c, f"__mode_{c}"))
        df = filled.withColumn(c, F.coalesce(F.col(c), F.col(f"__mode_{c}"), F.lit(fallback))).drop(f"__mode_{c}")
    return df


def filter_noise(df: DataFrame, spec: SeqSpec, min_interval: float = 0.1) -> DataFrame:
    """Drop a rapid row whose previous row is rapid too; the first rapid row of a run survives."""
    out = over_rows(
        df,
        spec,
        gap,
        lambda s: {"_rapid": F.coalesce(F.col("gap") < min_interval, F.lit(False))},
        lambda s: {"_drop": F.col("_rapid") & F.coalesce(F.lag("_rapid").over(s.window), F.lit(False))},
        before=2,
    )
    return out.filter(~F.col("_drop")).drop("gap", "_rapid", "_drop")


def standardize_events(df: DataFrame, spec: SeqSpec, synonyms: Mapping[str, str] = EVENT_SYNONYMS) -> DataFrame:
    name = F.lower(F.trim(spec.event))
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    return df.withColumn(spec.event, F.coalesce(F.try_element_at(F.create_map(*pairs), name), name))


def drop_empty_events(df: DataFrame, spec: SeqSpec) -> DataFrame:
    return df.filter(F.length(F.trim(spec.event)) > 0)


def clean_data(
    df: DataFrame,
    spec: SeqSpec,
    now: Column,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    min_interval: float = 0.1,
) -> DataFrame:
    """Dedupe, drop invalid timestamps, impute and filter noise; returns an indexed log."""
    df = deduplicate(df, spec)
    df = one_event_per_timestamp(drop_too_old(drop_future(df, spec.ts, now), spec.ts, now), spec)
    df = impute_mode(impute_median(df, numeric), categorical)
    df = filter_noise(index_sequence(df, spec), spec, min_interval)
    return index_sequence(df, spec)


def _log_summary(df: DataFrame, spec: SeqSpec, prefix: str) -> list[Column]:
    return [
        F.count("*").alias(f"{prefix}_count"),
        F.min(spec.ts).alias(f"{prefix}_start"),
        F.max(spec.ts).alias(f"{prefix}_end"),
        F.countDistinct(spec.event).alias(f"{prefix}_event_types"),
    ]


def validate_preprocessing(original: DataFrame, processed: DataFrame, spec: SeqSpec) -> DataFrame:
    """One row: counts, removed share, time range and distinct types before and after."""
    before = original.agg(*_log_summary(original, spec, "original"))
    after = processed.agg(*_log_summary(processed, spec, "processed"))
    out = attach_row(before, after)
    removed = F.col("original_count") - F.col("processed_count")
    return out.withColumns(
        {"removed_count": removed, "removed_percent": ratio(removed * 100, F.col("original_count"))}
    )


def quality_score(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """1 - 0.3 missing ratio - 0.2 duplicate ratio - 0.2 if unordered - 0.3 without events, at least 0.

    Order is the order of ``tiebreak`` (the arrival order), compared with ``ts``.
    """
    columns = [c for c in df.columns if not c.startswith("_")]
    arrival = index_sequence(df.select(*columns), SeqSpec(spec.keys, spec.tiebreak, spec.event, spec.tiebreak))
    arr = SeqSpec(spec.keys, spec.tiebreak, spec.event, spec.tiebreak)
    ordered = over_rows(arrival, arr, lambda s: {"_back": F.lag(spec.ts).over(s.window) > F.col(spec.ts)})
    base = ordered.agg(
        F.count("*").alias("rows"),
        sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)).alias("missing_cells"),
        F.countDistinct(spec.event).alias("event_types"),
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("unordered"),
    )
    distinct = df.select(*columns).distinct().agg(F.count("*").alias("distinct_rows"))
    out = attach_row(base, distinct)
    missing = F.coalesce(ratio(F.col("missing_cells"), F.col("rows") * len(columns)), F.lit(0.0))
    duplicate = F.coalesce(ratio(F.col("rows") - F.col("distinct_rows"), F.col("rows")), F.lit(0.0))
    score = (
        1.0
        - 0.3 * missing
        - 0.2 * duplicate
        - F.when(F.col("unordered"), 0.2).otherwise(0.0)
        - F.when(F.col("event_types") == 0, 0.3).otherwise(0.0)
    )
    return out.select(
        "rows",
        missing.alias("missing_ratio"),
        duplicate.alias("duplicate_ratio"),
        "unordered",
        "event_types",
        F.greatest(score, F.lit(0.0)).alias("quality_score"),
    )


def stage_quality(stages: Mapping[str, DataFrame], spec: SeqSpec) -> DataFrame:
    """Quality score per stage with the change from the first stage."""
    rows = [quality_score(df, spec).withColumn("stage", F.lit(name)) for name, df in stages.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    first = rows[0].select(F.col("quality_score").alias("_q0"))
    return attach_row(out, first).withColumn("quality_change", F.col("quality_score") - F.col("_q0")).drop("_q0")
