"""Correlation analysis of event logs and numeric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.pvalue import correlation_p_value
from lumenlog.functions.seq import POS, SeqSpec, attach, attach_row, null_safe_join, over_rows
from lumenlog.functions.stats import safe_corr
from lumenlog.operators.aggregates import transition_matrix
from lumenlog.operators.encode import label_codes


def event_correlations(df: DataFrame, spec: SeqSpec, threshold: float = 0.5, k: int | None = 10) -> DataFrame:
    """Pearson correlation of the co-occurrence rows of two event types, strongest first.

    Rows are sparse counts over the following type; absent pairs count as zero in the moments.
    """
    pairs = transition_matrix(df, spec).groupBy("from_event", "to_event").agg(F.sum("n").cast("double").alias("n"))
    types = df.select(spec.event).distinct().agg(F.count("*").alias("_v"))
    moments = pairs.groupBy("from_event").agg(F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    left = pairs.select(F.col("from_event").alias("event1"), "to_event", F.col("n").alias("_x"))
    right = pairs.select(F.col("from_event").alias("event2"), "to_event", F.col("n").alias("_y"))
    cross = left.join(right, "to_event").filter(F.col("event1") != F.col("event2"))
    cross = cross.groupBy("event1", "event2").agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy"))
    # Types without a common successor correlate at -(s1 s2) / (spread1 spread2). That passes the threshold only if
    # the two cover a large share of all types, so few types come into question.
    share = lambda: attach_row(moments, types).select(
        "from_event", F.try_divide(F.col("_s"), F.sqrt(F.greatest(F.col("_v") * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0)))).alias("_u")
    )
    top = share().agg(F.max("_u").alias("_top"))
    broad = attach_row(share(), top).filter(F.col("_u") * F.col("_top") > threshold)
    one = broad.select(F.col("from_event").alias("event1"), F.col("_u").alias("_u1"))
    two = broad.select(F.col("from_event").alias("event2"), F.col("_u").alias("_u2"))
    apart = one.join(two, (F.col("event1") != F.col("event2")) & (F.col("_u1") * F.col("_u2") > threshold))
    apart = apart.select("event1", "event2").join(cross, ["event1", "event2"], "left_anti").withColumn("_xy", F.lit(0.0))
    cross = cross.unionByName(apart)
    name = lambda i: moments.select(F.col("from_event").alias(f"event{i}"), F.col("_s").alias(f"_s{i}"), F.col("_q").alias(f"_q{i}"))
    out = attach_row(cross.join(name(1), "event1").join(name(2), "event2"), types)
    v = F.col("_v")
    spread = lambda i: v * F.col(f"_q{i}") - F.col(f"_s{i}") * F.col(f"_s{i}")
    r = F.try_divide(v * F.col("_xy") - F.col("_s1") * F.col("_s2"), F.sqrt(F.greatest(spread(1), F.lit(0.0)) * F.greatest(spread(2), F.lit(0.0))))
    out = out.select("event1", "event2", r.alias("correlation")).filter(F.abs("correlation") > threshold)
    out = out.orderBy(F.desc(F.abs("correlation")), "event1", "event2")
    return out.limit(k) if k else out


def temporal_correlations(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Spearman correlation of hour, weekday and month with the event code; constants are skipped.

    Ranks with average ties come from the counts of the few distinct values, so the log is
    aggregated once and never ranked.
    """
    ts = F.col(spec.ts)
    slots = F.array(
        *[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in (("hour", F.hour(ts)), ("day_of_week", F.weekday(ts)), ("month", F.month(ts)))]
    )
    counts = df.select(spec.event, F.inline(slots)).groupBy("feature", "value", spec.event).agg(F.count("*").alias("_n"))
    counts = counts.join(label_codes(df, spec), spec.event)
    # One row per distinct value or code of a feature: mean rank = rows before + (rows + 1) / 2.
    def ranks(column: str, name: str) -> DataFrame:
        sizes = counts.groupBy("feature", column).agg(F.sum("_n").alias("_m"))
        before = F.sum("_m").over(Window.partitionBy("feature").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
        return sizes.select("feature", column, (before - F.col("_m") + (F.col("_m") + 1) / 2).alias(name))

    joint = counts.join(ranks("value", "_rx"), ["feature", "value"]).join(ranks("event_code", "_ry"), ["feature", "event_code"])
    n, x, y = F.col("_n"), F.col("_rx"), F.col("_ry")
    m = joint.groupBy("feature").agg(
        F.sum("_n").alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"),
        F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"), F.countDistinct("value").alias("_values"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    r = F.try_divide(
        F.col("sxy") - sx * sy / n, F.sqrt((F.col("sxx") - sx * sx / n) * (F.col("syy") - sy * sy / n))
    )
    out = m.filter(F.col("_values") > 1).select("feature", "n", r.alias("correlation"))
    return _with_p(out)


def _with_p(out: DataFrame) -> DataFrame:
    out = out.withColumn("p_value", correlation_p_value(F.col("correlation"), F.col("n")))
    return out.withColumn("significant", F.col("p_value") < 0.05).drop("n")


def feature_correlations(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Pearson correlation of every two numeric columns, from one aggregate; optionally only strong ones."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    out = row.select(F.inline(F.array(*cells)))
    return out.filter(F.abs("correlation") > threshold) if threshold is not None else out


def mean_correlation(correlations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Number of pairs, number above the threshold and mean absolute correlation."""
    r = F.abs("correlation")
    return correlations.agg(
        F.count("correlation").alias("pairs"), F.count_if(r > threshold).alias("high_pairs"), F.avg(r).alias("mean_abs_correlation")
    )


def cross_correlations(df: DataFrame, spec: SeqSpec, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each numeric column with the event code; constants are skipped."""
    coded = df.join(label_codes(df, spec), spec.event)
    row = coded.agg(
        F.count("*").alias("n"), *[safe_corr(F.col(c), F.col("event_code")).alias(f"r_{c}") for c in columns]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r_{c}").alias("correlation")) for c in columns])
    return _with_p(row.select("n", F.inline(cells)).filter(F.col("correlation").isNotNull()))


def lag_correlations(df: DataFrame, spec: SeqSpec, max_lag: int = 10) -> DataFrame:
    """Correlation of each event type's 0/1 series with itself at lags 1..max_lag, from pair counts."""
    lags = range(1, max_lag + 1)
    rows = over_rows(
        df,
        spec,
        lambda s: {"_lags": F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(s.event, k).over(s.window).alias("_old")) for k in lags])},
        before=max_lag,
    )
    rows = rows.select(*spec.keys, F.col(spec.event).alias("event"), F.inline("_lags")).filter(F.col("_old").isNotNull())
    keys = list(spec.keys)
    counts = rows.groupBy(*keys, "lag", "event", "_old").agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys, "lag").agg(F.sum("_n").alias("_m"))
    now = counts.groupBy(*keys, "lag", "event").agg(F.sum("_n").alias("_a"), F.sum(F.when(F.col("event") == F.col("_old"), F.col("_n")).otherwise(0)).alias("_c"))
    old = counts.groupBy(*keys, "lag", F.col("_old").alias("event")).agg(F.sum("_n").alias("_b"))
    out = null_safe_join(null_safe_join(now, old, [*keys, "lag", "event"]), total, [*keys, "lag"])
    a, b, c, m = (F.col(x).cast("double") for x in ("_a", "_b", "_c", "_m"))
    r = F.try_divide(c - a * b / m, F.sqrt((a - a * a / m) * (b - b * b / m)))
    return out.select(*keys, "event", "lag", r.alias("correlation"))


def analyze_correlations(df: DataFrame, spec: SeqSpec, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {
        "event": event_correlations(df, spec),
        "temporal": temporal_correlations(df, spec),
        "feature": feature_correlations(df, columns, 0.7),
        "cross": cross_correlations(df, spec, columns),
    }
