"""Anomaly flags on ordered logs and numeric tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import POS, SeqSpec, attach_row, over_rows, totals_by, with_gap
from lumenlog.functions.stats import attach_percentiles, exact_percentiles, ratio
from lumenlog.functions.storage import materialise
from lumenlog.operators.aggregates import flag_summary


def stream_gap_anomalies(df: DataFrame, spec: SeqSpec, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Gap above the high percentile; gap (first row as 0) below the low percentile of those gaps."""
    out = with_gap(df, spec).withColumn("_g0", F.coalesce("gap", F.lit(0.0)))
    out = attach_percentiles(out, spec, "gap", {"_hi": high})
    out = attach_percentiles(out, spec, "_g0", {"_lo": low})
    return out.withColumns(
        {
            "unusual_gap": F.coalesce(F.col("gap") > F.col("_hi"), F.lit(False)),
            "rapid_succession": F.coalesce(F.col("_g0") < F.col("_lo"), F.lit(False)),
        }
    ).drop("_g0", "_hi", "_lo")


def temporal_anomalies(df: DataFrame, spec: SeqSpec, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Gap outside the percentile range of the sequence's gaps; the first row has none."""
    out = attach_percentiles(with_gap(df, spec), spec, "gap", {"_hi": high, "_lo": low})
    return out.withColumns(
        {
            "long_gap_anomaly": F.coalesce(F.col("gap") > F.col("_hi"), F.lit(False)),
            "short_gap_anomaly": F.coalesce(F.col("gap") < F.col("_lo"), F.lit(False)),
        }
    ).drop("_hi", "_lo")


def sequence_anomalies(df: DataFrame, spec: SeqSpec, share: float = 0.01) -> DataFrame:
    """Rows whose incoming transition makes up less than ``share`` of the sequence's transitions."""
    out = over_rows(df, spec, lambda s: {"_prev": F.lag(s.event).over(s.window)})
    out = totals_by(out, spec, ["_prev", spec.event], _pair=F.lit(1))
    rare = ratio(F.col("_pair"), F.col("_n") - 1) < share
    return out.withColumn("sequence_anomaly", F.coalesce(F.col("_prev").isNotNull() & rare, F.lit(False))).drop("_prev", "_pair")


def zscore_anomalies(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """|z| above the threshold per numeric column (population sd, NULL as 0), and any of them."""
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(*[F.avg(x).alias(f"_m_{c}") for c, x in v.items()], *[F.stddev_pop(x).alias(f"_s_{c}") for c, x in v.items()])
    out = attach_row(df, row)
    flags = {
        f"{c}_zscore_anomaly": F.coalesce(F.abs(F.try_divide(x - F.col(f"_m_{c}"), F.col(f"_s_{c}"))) > threshold, F.lit(False))
        for c, x in v.items()
    }
    return out.withColumns(flags).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


SAMPLE_ROWS = 256
# Fixed value: rows that walk down the trees together.
SCORE_ROWS = 4096


def _path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)


def isolation_forest(
    df: DataFrame, columns: Sequence[str], row_id: str, contamination: float = 0.1, trees: int = 100, seed: int = 42
) -> DataFrame:
    """Isolation-forest score and label.

    Each tree draws about 256 rows by hash, is grown in its own task, and the forest (at most
    ``trees`` x 511 nodes) is sent to the scoring tasks.  The threshold is the exact percentile.
    """
    n = len(columns)
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(
        F.count("*").alias("_rows"), *[F.avg(x).alias(f"_m_{c}") for c, x in v.items()], *[F.stddev_pop(x).alias(f"_s_{c}") for c, x in v.items()]
    )
    scaled = attach_row(df, row)
    unit = [F.coalesce(F.try_divide(x - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c, x in v.items()]
    # Twice the wanted share, so that nearly every tree can fill its sample; the smallest hashes are kept.
    share = F.least(F.lit(2.0 * SAMPLE_ROWS) / F.col("_rows"), F.lit(1.0))
    draw = lambda t: F.pmod(F.xxhash64(F.col(row_id), t, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # Trees are rows and not elements of a lambda, so that the many draws are compiled; few rows are left to scale.
    each = scaled.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).filter(draw(F.col("tree")) < share)
    sample = each.select("tree", F.array(*unit).alias("_x"), F.xxhash64(row_id, "tree", F.lit(seed)).alias("_h"))
    schema = "tree int, feature array<int>, split array<double>, lower array<int>, upper array<int>, depth array<double>, size int"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h").iloc[:SAMPLE_ROWS]
        x = np.vstack(pdf["_x"].to_numpy())
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        feature, split, lower, upper, depth = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            i = len(feature)
            for a, z in ((feature, -1), (split, 0.0), (lower, -1), (upper, -1), (depth, level + _path_constant(len(rows)))):
                a.append(z)
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if level >= limit or len(rows) <= 1 or not len(usable):
                return i
            f = int(rng.choice(usable))
            s = float(rng.uniform(lo[f], hi[f]))
            below = x[rows, f] <= s
            feature[i], split[i] = f, s
            lower[i] = node(rows[below], level + 1)
            upper[i] = node(rows[~below], level + 1)
            return i

        node(np.arange(len(x)), 0)
        return pd.DataFrame(
            {"tree": [tree], "feature": [feature], "split": [split], "lower": [lower], "upper": [upper], "depth": [depth], "size": [len(x)]}
        )

    # Bounded by trees x (2 x SAMPLE_ROWS - 1) nodes whatever the input size.
    grown = sample.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()
    starts = np.cumsum([0, *[len(r["feature"]) for r in grown]])
    whole = lambda c, kind=np.intp: np.concatenate([np.asarray(r[c], kind) for r in grown]) if grown else np.zeros(0, kind)
    # All trees in one set of arrays; a leaf leads to itself, so that rows walk down without a test for the end.
    feature, split, depth = whole("feature"), whole("split", float), whole("depth", float)
    own = np.arange(len(feature))
    shift = np.repeat(starts[:-1], np.diff(starts))
    child = np.where(feature < 0, own, np.stack([whole("upper"), whole("lower")]) + shift).T.ravel()
    forest = (starts[:-1], np.maximum(feature, 0), split, child, depth)
    norm = sum(_path_constant(r["size"]) for r in grown)
    levels = math.ceil(math.log2(SAMPLE_ROWS))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def depths(x: np.ndarray) -> np.ndarray:
        """Sum over trees of the depth of each row's leaf; few rows at a time, so that all arrays stay in the cache."""
        roots, feature, split, child, depth = shared.value
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * n
        total = np.zeros(len(x))
        for root in roots:
            at = np.full(len(x), root)
            for _ in range(levels):
                below = flat.take(base + feature.take(at)) <= split.take(at)
                at = child.take(2 * at + below)
            total += depth.take(at)
        return total

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack(xs)
        if norm <= 0 or not len(x):
            return pd.Series(np.full(len(x), 0.5))
        return pd.Series(np.power(2.0, -np.concatenate([depths(x[i : i + SCORE_ROWS]) for i in range(0, len(x), SCORE_ROWS)]) / norm))

    # The percentile needs the scores again: keep them instead of scoring three times.
    out = scaled.withColumn("isolation_score", score(*unit)).select(*df.columns, "isolation_score")
    out = materialise(out, "scores")
    limit = exact_percentiles(out, [], "isolation_score", {"_limit": 1 - contamination})
    out = attach_row(out, limit).withColumn("isolation_forest_anomaly", F.col("isolation_score") > F.col("_limit"))
    return out.drop("_limit")


def detect_anomalies(df: DataFrame, spec: SeqSpec, columns: Sequence[str], method: str = "isolation_forest") -> DataFrame:
    """Method flags, then temporal and rare-transition flags, and whether any is set."""
    if method == "isolation_forest":
        out, flags = isolation_forest(df, columns, spec.tiebreak), ["isolation_forest_anomaly"]
    elif method == "zscore":
        out, flags = zscore_anomalies(df, columns), [f"{c}_zscore_anomaly" for c in columns]
    else:
        raise ValueError(f"unknown anomaly method: {method}")
    out = sequence_anomalies(temporal_anomalies(out, spec), spec)
    flags += ["long_gap_anomaly", "short_gap_anomaly", "sequence_anomaly"]
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.col(f)
    return out.withColumn("is_anomaly", any_flag)


def anomaly_summary(df: DataFrame) -> DataFrame:
    return flag_summary(df, [c for c in df.columns if c.endswith("_anomaly")])
