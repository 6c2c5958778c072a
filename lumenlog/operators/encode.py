"""Encodings, scaling and feature columns fitted from one aggregate and applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.seq import POS, SeqSpec, attach_row, index_sequence, null_safe_join, seconds
from lumenlog.functions.stats import percentile_values


def _range_stats(df: DataFrame, spec: SeqSpec, prefix: str) -> DataFrame:
    lo, hi = F.min(spec.ts), F.max(spec.ts)
    return df.agg(
        lo.alias(f"{prefix}_start"),
        hi.alias(f"{prefix}_end"),
        seconds(hi, lo).alias(f"{prefix}_duration"),
        F.countDistinct(spec.event).alias(f"{prefix}_events"),
    )


def normalization_stats(original: DataFrame, normalized: DataFrame, spec: SeqSpec) -> DataFrame:
    """Time range, duration and distinct events before and after normalisation."""
    return attach_row(_range_stats(original, spec, "original"), _range_stats(normalized, spec, "normalized"))


def sorted_codes(df: DataFrame, value: str, order: Sequence[str], name: str = "code") -> DataFrame:
    """0-based code of every row of a distinct table in the given total order, from a range-sorted index."""
    first, tie = order[0], order[-1]
    ranked = index_sequence(df, SeqSpec((), first, value, tie))
    return ranked.select(value, F.col(POS).alias(name))


def label_codes(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Code of every event type by first appearance."""
    first = df.groupBy(spec.event).agg(F.min(F.struct(spec.ts, spec.tiebreak)).alias("_f"))
    first = first.select(spec.event, F.col("_f")[spec.ts].alias("_ts"), F.col("_f")[spec.tiebreak].alias("_id"))
    return sorted_codes(first, spec.event, ["_ts", "_id"], "event_code")


def encode_label(df: DataFrame, spec: SeqSpec) -> DataFrame:
    return df.join(label_codes(df, spec), spec.event, "left")


def encode_onehot(df: DataFrame, column: str, values: Sequence[str], prefix: str = "event") -> DataFrame:
    return df.withColumns({f"{prefix}_{v}": (F.col(column) == v).cast("int") for v in values})


def frequency_map(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(f"{column}_freq"))


def encode_frequency(df: DataFrame, column: str, mapping: DataFrame | None = None) -> DataFrame:
    """Count of the value in the fitted table; unseen values count 0."""
    mapping = frequency_map(df, column) if mapping is None else mapping
    out = null_safe_join(df, mapping, [column], "left")
    return out.withColumn(f"{column}_freq", F.coalesce(f"{column}_freq", F.lit(0)))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes in sorted label order (NULL encodes as the text ``nan``)."""
    labels = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias(column)).distinct()
    return sorted_codes(labels, column, [column], f"{column}_code")


def encode_category(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """Sorted-label code; labels unseen at fit time become the first label."""
    codes = category_codes(df, column) if codes is None else codes
    label = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    out = df.withColumn("_label", label).join(codes.withColumnRenamed(column, "_label"), "_label", "left").drop("_label")
    return out.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(0)))


def encode_categories(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    """Frequency encoding above ``limit`` distinct values (the column is dropped), sorted codes below."""
    if not columns:
        return df
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
    for c in columns:
        if counts[c] > limit:
            df = encode_frequency(df, c).drop(c)
        else:
            df = encode_category(df, c).drop(c).withColumnRenamed(f"{c}_code", c)
    return df


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One row with ``center_*`` and ``scale_*`` per column; a constant column gets scale 1."""
    if method == "robust":
        wanted = {f"{n}{c}": (c, p) for c in columns for n, p in (("_l_", 0.25), ("center_", 0.5), ("_h_", 0.75))}
        values = percentile_values(df, wanted)
        row = df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in values.items()])
        spread = {c: F.col(f"_h_{c}") - F.col(f"_l_{c}") for c in columns}
    else:
        aggs = []
        for c in columns:
            v = F.col(c).cast("double")
            if method == "standard":
                aggs += [F.avg(v).alias(f"center_{c}"), F.stddev_pop(v).alias(f"_s_{c}")]
            elif method == "minmax":
                aggs += [F.min(v).alias(f"center_{c}"), (F.max(v) - F.min(v)).alias(f"_s_{c}")]
            else:
                raise ValueError(f"unknown scaling method: {method}")
        row = df.agg(*aggs)
        spread = {c: F.col(f"_s_{c}") for c in columns}
    scale = {c: F.when(s > 0, s).otherwise(F.lit(1.0)) for c, s in spread.items()}
    return row.select(*[f"center_{c}" for c in columns], *[s.alias(f"scale_{c}") for c, s in scale.items()])


def _with_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    out = attach_row(df, params)
    out = out.withColumns({c: fn(F.col(c), F.col(f"center_{c}"), F.col(f"scale_{c}")) for c in columns})
    return out.drop(*params.columns)


def scale(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _with_scaler(df, params, columns, lambda v, c, s: (v - c) / s)


def inverse_scale(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _with_scaler(df, params, columns, lambda v, c, s: v * s + c)
