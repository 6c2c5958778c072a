"""Profiling, cleaning, feature engineering and feature selection of numeric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import attach_row, null_safe_join
from lumenlog.functions.stats import exact_percentiles, percentile_values, ratio, safe_corr
from lumenlog.operators.encode import sorted_codes
from lumenlog.sources.tabular import numeric_columns, string_columns


def split_month(df: DataFrame, column: str = "month") -> DataFrame:
    date = F.to_date(F.col(column), "yyyy-MM")
    return df.withColumns({"year": F.year(date), "month_num": F.month(date)})


def detect_column_types(df: DataFrame, target: str | None = None) -> DataFrame:
    """numeric or categorical per column; strings that all parse as numbers are numeric."""
    numeric, strings = numeric_columns(df), string_columns(df)
    tries = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in strings]
    row = df.agg(F.lit(1).alias("_one"), *tries)
    cells = [F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("kind")) for c in numeric if c != target]
    cells += [
        F.struct(F.lit(c).alias("column"), F.when(F.col(c) > 0, "categorical").otherwise("numeric").alias("kind"))
        for c in strings
        if c != target
    ]
    return row.select(F.inline(F.array(*cells)))


def outlier_bounds(df: DataFrame, target: str, method: str = "iqr") -> DataFrame:
    """Inclusive bounds: quartiles -/+ 1.5 IQR, or mean -/+ 3 sample sd (exclusive in the filter)."""
    if method == "iqr":
        q = exact_percentiles(df, [], target, {"_q1": 0.25, "_q3": 0.75})
        width = F.col("_q3") - F.col("_q1")
        return q.select((F.col("_q1") - 1.5 * width).alias("lower"), (F.col("_q3") + 1.5 * width).alias("upper"))
    if method == "zscore":
        row = df.agg(F.avg(target).alias("_m"), F.stddev_samp(target).alias("_s"))
        return row.select((F.col("_m") - 3 * F.col("_s")).alias("lower"), (F.col("_m") + 3 * F.col("_s")).alias("upper"))
    raise ValueError(f"unknown outlier method: {method}")


def remove_outliers(df: DataFrame, target: str, method: str = "iqr") -> DataFrame:
    v, lo, hi = F.col(target), F.col("lower"), F.col("upper")
    keep = (v >= lo) & (v <= hi) if method == "iqr" else (v > lo) & (v < hi)
    return attach_row(df, outlier_bounds(df, target, method)).filter(keep).drop("lower", "upper")


def flag_outliers(df: DataFrame, value: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """``is_outlier`` by IQR fences, |z| (population sd), or the modified z of the median deviation."""
    v = F.col(value).cast("double")
    if method == "iqr":
        out = attach_row(df, exact_percentiles(df, [], value, {"_q1": 0.25, "_q3": 0.75}))
        width = F.col("_q3") - F.col("_q1")
        hit = (v < F.col("_q1") - threshold * width) | (v > F.col("_q3") + threshold * width)
        return out.withColumn("is_outlier", hit).drop("_q1", "_q3")
    if method == "zscore":
        out = attach_row(df, df.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s")))
        z = F.abs(F.try_divide(v - F.col("_m"), F.col("_s")))
        return out.withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False))).drop("_m", "_s")
    if method == "modified_zscore":
        out = attach_row(df, exact_percentiles(df, [], value, {"_med": 0.5}))
        out = out.withColumn("_dev", F.abs(v - F.col("_med")))
        out = attach_row(out, exact_percentiles(out, [], "_dev", {"_mad": 0.5}))
        z = F.try_divide(0.6745 * F.col("_dev"), F.col("_mad"))
        return out.withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False))).drop("_med", "_dev", "_mad")
    raise ValueError(f"unknown outlier method: {method}")


def outlier_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("is_outlier").alias("outlier_count"), (F.avg(F.col("is_outlier").cast("int")) * 100).alias("outlier_percentage")
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, and describe statistics of numeric columns, from one aggregate."""
    numeric = numeric_columns(df)
    aggs = [F.count("*").alias("_n")]
    for c in df.columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"z_{c}"))
        if c in numeric:
            v = F.col(c).cast("double")
            aggs += [F.avg(v).alias(f"m_{c}"), F.stddev_samp(v).alias(f"s_{c}"), F.min(v).alias(f"l_{c}"), F.max(v).alias(f"h_{c}")]
    row = df.agg(*aggs)
    none = F.lit(None).cast("double")
    cells = []
    for f in df.schema.fields:
        c, is_num = f.name, f.name in numeric
        stat = lambda p: F.col(f"{p}_{c}") if is_num else none
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.lit("numeric" if is_num else "other").alias("kind"), F.col("_n").alias("rows"),
                F.col(f"z_{c}").alias("nulls"), stat("m").alias("mean"), stat("s").alias("std"), stat("l").alias("min"), stat("h").alias("max"),
            )
        )
    return row.select(F.inline(F.array(*cells)))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def validate_table(df: DataFrame, high_cardinality: int = 50) -> DataFrame:
    """Per column nulls, distinct values, constant and high-cardinality flags, next to the duplicate count."""
    strings = string_columns(df)
    distinct = [df.agg(F.countDistinct(c).alias(f"d_{c}")) for c in df.columns]
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in df.columns])
    for part in (*distinct, df.distinct().agg(F.count("*").alias("_u"))):
        row = attach_row(row, part)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"z_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct_values"),
            (F.col(f"d_{c}") == 1).alias("is_constant"), (F.lit(c in strings) & (F.col(f"d_{c}") > high_cardinality)).alias("is_high_cardinality"),
        )
        for c in df.columns
    ]
    return row.select((F.col("_n") - F.col("_u")).alias("duplicate_count"), F.inline(F.array(*cells)))


def storey_range(df: DataFrame, column: str = "storey_range") -> DataFrame:
    parts = F.split(F.col(column), " TO ")
    part = lambda i: F.get(parts, i).try_cast("double")
    out = df.withColumns({"storey_lower": part(0), "storey_upper": part(1)})
    return out.withColumn("storey_mid", (F.col("storey_lower") + F.col("storey_upper")) / 2)


def add_ratio(df: DataFrame, numerator: str, denominator: str, name: str) -> DataFrame:
    return df.withColumn(name, ratio(F.col(numerator), F.col(denominator)))


def generic_price_per_area(df: DataFrame) -> DataFrame:
    """price / area of the first numeric columns whose names say so."""
    numeric = numeric_columns(df)
    price = [c for c in numeric if "price" in c.lower()]
    area = [c for c in numeric if any(k in c.lower() for k in ("sqft", "sqm", "area"))]
    return add_ratio(df, price[0], area[0], "price_per_area") if price and area else df


def total_of(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Sum of the available columns, NULL as nothing."""
    present = [F.coalesce(F.col(c), F.lit(0)) for c in columns if c in df.columns]
    return df.withColumn(name, sum(present[1:], present[0])) if present else df


def group_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups ranked by mean value, highest first, 0-based: (group, rank)."""
    means = df.groupBy(group).agg((-F.avg(value)).alias("_neg"))
    return sorted_codes(means, group, ["_neg", group], f"{group}_price_rank")


def add_group_rank(df: DataFrame, ranks: DataFrame, group: str) -> DataFrame:
    """Apply ranks fitted on the training rows."""
    return null_safe_join(df, ranks, [group], "left")


def housing_features(df: DataFrame, dataset_type: str, reference_year: int = 2024, use_target: bool = False) -> DataFrame:
    """Dataset features; those derived from the target only with ``use_target``."""
    has = lambda *c: all(x in df.columns for x in c)
    if dataset_type == "hdb":
        if use_target and has("floor_area_sqm", "resale_price"):
            df = add_ratio(df, "resale_price", "floor_area_sqm", "price_per_sqm")
        if has("lease_commence_date", "year"):
            df = df.withColumn("property_age_at_sale", F.col("year") - F.col("lease_commence_date"))
        if has("storey_range"):
            df = storey_range(df)
        if use_target and has("town", "resale_price"):
            df = add_group_rank(df, group_rank(df, "town", "resale_price"), "town")
        return df
    if dataset_type == "portland":
        if use_target and has("sqft_living", "price"):
            df = add_ratio(df, "price", "sqft_living", "price_per_sqft")
        if has("yr_built"):
            df = df.withColumn("house_age", F.lit(reference_year) - F.col("yr_built"))
        return total_of(df, ["sqft_living", "sqft_lot", "sqft_above", "sqft_basement"], "total_sqft")
    return generic_price_per_area(df) if use_target else df


def interaction_pairs(df: DataFrame, columns: Sequence[str], max_interactions: int = 5) -> list[tuple[str, str]]:
    """First pairs among the ten columns of largest sample variance (one aggregate row is read)."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    top = sorted(columns, key=lambda c: (-(row[c] if row[c] is not None else float("-inf")), c))[:10]
    pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    return pairs[:max_interactions]


def add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def complete_features(df: DataFrame, features: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Missing trained columns get their fitted default (else 0); columns come out in training order."""
    missing = {c: F.lit(float(defaults.get(c, 0.0))) for c in features if c not in df.columns}
    kept = [c for c in df.columns if c not in features]
    return df.withColumns(missing).select(*kept, *features)


def hash_split(df: DataFrame, row_id: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` column from a hash of the row id: stable under repartitioning and reruns."""
    h = F.pmod(F.xxhash64(*row_id, F.lit(seed)), F.lit(10_000))
    return df.withColumn("split", F.when(h < int(round(test_size * 10_000)), "test").otherwise("train"))


def feature_scores(df: DataFrame, features: Sequence[str], target: str, method: str = "f_test") -> DataFrame:
    """F statistic r^2 (n-2) / (1-r^2), or |r|, of every feature with the target, best first."""
    row = df.agg(F.count(target).alias("_n"), *[safe_corr(F.col(c), F.col(target)).alias(c) for c in features])
    out = row.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_r")) for c in features])))
    r2 = F.col("_r") * F.col("_r")
    score = {"f_test": F.try_divide(r2 * (F.col("_n") - 2), 1 - r2), "correlation": F.abs("_r")}[method]
    return out.select("feature", F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "feature")


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Bin number of each value: how many of the column's exact quantile edges lie below it."""
    wanted = {f"{c}/{i}": (c, i / bins) for c in columns for i in range(1, bins)}
    values = percentile_values(df, wanted)
    binned = {}
    for c in columns:
        edges = [values[f"{c}/{i}"] for i in range(1, bins)]
        binned[f"{c}_bin"] = sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges if e is not None), F.lit(0))
    return df.withColumns(binned)


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with the binned target, best first.

    All features share one pass: rows become (feature, bin, target bin) counts.
    """
    out = quantile_bins(df.select(*features, target), [*features, target], bins)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bin").alias("x")) for c in features])
    joint = out.select(F.col(f"{target}_bin").alias("y"), F.inline(cells)).groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    share = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    n = share("feature")
    joint = joint.withColumns({"_n": n, "_x": share("feature", "x"), "_y": share("feature", "y")})
    term = F.col("n") / F.col("_n") * F.log(F.col("n") * F.col("_n") / (F.col("_x") * F.col("_y")))
    return joint.groupBy("feature").agg(F.sum(term).alias("score")).orderBy(F.desc("score"), "feature")


def variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Columns whose population variance exceeds the threshold (one aggregate row is read)."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > threshold]
