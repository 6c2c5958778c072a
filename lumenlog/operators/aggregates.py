"""Aggregates of event logs: transition and Markov tables, counts, histograms and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.seq import POS, SIZE, SeqSpec, attach_row, null_safe_join, over_rows, running, seconds
from lumenlog.functions.stats import exact_percentiles, ratio


def transition_matrix(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Counts of adjacent event pairs and row-normalised probability, as a sparse long table."""
    nxt = over_rows(df, spec, lambda s: {"to_event": F.lead(s.event).over(s.window)}, before=0, after=1)
    pairs = nxt.filter(F.col("to_event").isNotNull())
    counts = pairs.groupBy(*spec.keys, F.col(spec.event).alias("from_event"), "to_event").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*spec.keys, "from_event")
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(whole))


def markov_model(df: DataFrame, spec: SeqSpec, order: int = 1, smoothing: float = 0.1) -> DataFrame:
    """Order-k model with additive smoothing over the observed successors of each state."""
    state = lambda s: F.array(*[F.lag(s.event, k).over(s.window) for k in range(order, 0, -1)])
    rows = over_rows(df, spec, lambda s: {"state": F.when(F.col(POS) >= order, state(s))}, before=order)
    rows = rows.filter(F.col("state").isNotNull())
    counts = rows.groupBy(*spec.keys, "state", F.col(spec.event).alias("next_event")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*spec.keys, "state")
    total = F.sum("n").over(whole) + smoothing * F.count("*").over(whole)
    return counts.withColumn("prob", (F.col("n") + smoothing) / total)


def event_probabilities(df: DataFrame, spec: SeqSpec, smoothing: float = 0.1) -> DataFrame:
    counts = df.groupBy(*spec.keys, spec.event).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*spec.keys)
    total = F.sum("n").over(whole) + smoothing * F.count("*").over(whole)
    return counts.withColumn("prob", (F.col("n") + smoothing) / total)


# Gap model of an event type that occurs once (seconds).
DEFAULT_GAP = {"mean": 60.0, "std": 30.0, "median": 60.0}


def same_type_gaps(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Seconds since the previous event of the same type in the sequence."""
    last = running(df, spec, {"_prev_ts": ("max", F.col(spec.ts))}, by=[spec.event], exclusive=True)
    return last.withColumn("type_gap", seconds(F.col(spec.ts), F.col("_prev_ts"))).drop("_prev_ts")


def gap_model(df: DataFrame, spec: SeqSpec, median: bool = True) -> DataFrame:
    """Mean, sample sd and (``median``) median of same-type gaps per event type."""
    by = [*spec.keys, spec.event]
    gaps = same_type_gaps(df, spec)
    base = gaps.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("type_gap").alias("mean"), F.stddev_samp("type_gap").alias("std")
    )
    if median:
        base = null_safe_join(base, exact_percentiles(gaps, by, "type_gap", {"median": 0.5}), by, "left")
    once = F.col("n") == 1
    return base.withColumns({c: F.when(once, F.lit(d)).otherwise(F.col(c)) for c, d in DEFAULT_GAP.items() if c in base.columns})


def markov_statistics(model: DataFrame, probabilities: DataFrame) -> DataFrame:
    p = F.col("prob")
    stats = model.agg(
        F.countDistinct("state").alias("num_states"),
        F.avg(p).alias("avg_transition_probability"),
        F.sum(F.when(p > 0, -p * F.log(p))).alias("model_complexity"),
    )
    return attach_row(stats, probabilities.agg(F.count("*").alias("unique_events")))


def event_counts(df: DataFrame, spec: SeqSpec, k: int | None = None) -> DataFrame:
    """Count and share per event type, most common first."""
    counts = df.groupBy(spec.event).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    out = attach_row(counts, total).withColumn("percentage", F.col("count") * 100.0 / F.col("_total")).drop("_total")
    out = out.orderBy(F.desc("count"), spec.event)
    return out.limit(k) if k else out


def calendar_counts(df: DataFrame, spec: SeqSpec, unit: str, last_days: int = 30) -> DataFrame:
    """Row counts per ``hour``, ``weekday`` or the last ``last_days`` dates that have rows."""
    ts = F.col(spec.ts)
    key = {"hour": F.hour(ts), "weekday": F.weekday(ts), "date": F.to_date(ts)}[unit]
    out = df.groupBy(key.alias(unit)).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc(unit)).limit(last_days) if unit == "date" else out


def hour_event_crosstab(df: DataFrame, spec: SeqSpec, types: Sequence[str]) -> DataFrame:
    out = df.groupBy(F.hour(spec.ts).alias("hour")).pivot(spec.event, list(types)).count()
    return out.na.fill(0)


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over min..max per group, last bin closed: index, edges, count and density.

    The normal curve with the group's mean and population sd is given at the bin centre.
    """
    by = list(by)
    v = F.col(value)
    stats = df.filter(v.isNotNull()).groupBy(*by).agg(
        F.min(v).cast("double").alias("_lo"), F.max(v).cast("double").alias("_hi"), F.count("*").alias("_cnt"),
        F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"),
    )
    # A constant group gets a unit-wide range around its value.
    flat = F.col("_lo") == F.col("_hi")
    stats = stats.withColumns(
        {"_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))}
    )
    rows = df.filter(v.isNotNull())
    rows = null_safe_join(rows.select(*by, value), stats, by) if by else attach_row(rows.select(value), stats)
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))
    out = rows.groupBy(*by, "_lo", "_hi", "_cnt", "_mean", "_sd", index.alias("bin")).agg(F.count("*").alias("count"))
    low = F.col("_lo") + F.col("bin") * width
    z = F.try_divide(low + width / 2 - F.col("_mean"), F.col("_sd"))
    return out.select(
        *by, "bin", low.alias("bin_start"), (low + width).alias("bin_end"), "count",
        (F.col("count") / (F.col("_cnt") * width)).alias("density"),
        F.try_divide(F.exp(-z * z / 2), F.col("_sd") * F.sqrt(F.lit(2.0) * F.pi())).alias("normal_density"),
    )


def gap_summary(gaps: DataFrame, spec: SeqSpec, gap: str = "gap") -> DataFrame:
    """Mean, median and sample sd of the gaps, and events per (whole days + 1), over the whole log."""
    days = F.floor(seconds(F.max(spec.ts), F.min(spec.ts)) / 86400) + 1
    base = gaps.agg(
        F.count("*").alias("events"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("std_gap"),
        (F.count("*") / days).alias("events_per_day"),
    )
    return attach_row(base, exact_percentiles(gaps, [], gap, {"median_gap": 0.5}))


def anomaly_density(df: DataFrame, spec: SeqSpec, flags: Sequence[str], bins: int = 10) -> DataFrame:
    """Share of rows with any flag in equal-width, right-closed time bins (N // 5 bins for short logs)."""
    us = F.unix_micros(spec.ts)
    ends = df.agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"), F.least(F.lit(bins), F.expr("count(*) div 5")).alias("_bins"))
    out = attach_row(df, ends).filter(F.col("_bins") > 0)
    pos = (us - F.col("_lo")) * F.col("_bins") / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    index = F.greatest(F.ceil(pos) - 1, F.lit(0))
    hit = F.greatest(*[F.col(f).cast("int") for f in flags], F.lit(0)).cast("double")
    return out.groupBy(index.alias("bin")).agg(F.count("*").alias("rows"), F.avg(hit).alias("density"))


def anomaly_by_event(df: DataFrame, spec: SeqSpec, flags: Sequence[str]) -> DataFrame:
    hit = F.greatest(*[F.col(f).cast("int") for f in flags], F.lit(0))
    return df.groupBy(spec.event).agg(F.sum(1 - hit).alias("normal"), F.sum(hit).alias("anomaly"))


def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Count and percentage of rows per flag column."""
    row = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("count")) for f in flags])
    out = row.select("_n", F.inline(pairs))
    return out.select("flag", "count", (F.col("count") * 100.0 / F.col("_n")).alias("percentage"))


def confidence_by(df: DataFrame, by: str, confidence: str = "reconstruction_confidence") -> DataFrame:
    """Mean confidence and row count per event type or method."""
    return df.groupBy(by).agg(F.count("*").alias("count"), F.avg(confidence).alias("mean_confidence"))


def feature_importance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample variance times range per column, divided by the largest."""
    row = df.agg(
        *[(F.var_samp(c) * (F.max(c) - F.min(c))).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_score")) for c in columns])
    out = row.select(F.greatest(*[F.col(c) for c in columns], F.lit(float("-inf"))).alias("_top"), F.inline(pairs))
    return out.select("feature", ratio(F.col("_score"), F.col("_top")).alias("importance"))


def top_features(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    return feature_importance(df, columns).orderBy(F.desc("importance"), "feature").limit(k)


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column count, nulls, mean/max/min sample variance and mean range of the feature columns."""
    row = df.agg(
        *[F.var_samp(c).alias(f"v_{c}") for c in columns],
        *[(F.max(c) - F.min(c)).cast("double").alias(f"r_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
    )
    k = len(columns)
    var, rng = [F.col(f"v_{c}") for c in columns], [F.col(f"r_{c}") for c in columns]
    return row.select(
        F.lit(k).cast("long").alias("feature_count"),
        sum((F.col(f"n_{c}") for c in columns), F.lit(0)).alias("null_count"),
        (sum(var, F.lit(0.0)) / k).alias("mean_variance"),
        F.greatest(*var, F.lit(float("-inf"))).alias("max_variance"),
        F.least(*var, F.lit(float("inf"))).alias("min_variance"),
        (sum(rng, F.lit(0.0)) / k).alias("mean_range"),
    )


def feature_matrix(df: DataFrame, ids: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns other than ids, NULL as 0."""
    numeric = [
        f.name for f in df.schema.fields
        if f.dataType.typeName() in ("integer", "long", "float", "double", "short", "byte") and f.name not in (*ids, *exclude)
    ]
    return df.select(*ids, *[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in numeric])


def price_summary(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, sample sd, range, and bias-corrected skewness and excess kurtosis."""
    v = F.col(value).cast("double")
    row = df.agg(
        F.count(v).cast("double").alias("_n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.skewness(v).alias("_s"), F.kurtosis(v).alias("_k"),
    )
    n = F.col("_n")
    skew = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.col("_s")
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("_k") + 6)
    row = row.select("mean", "std", "min", "max", skew.alias("skewness"), kurt.alias("kurtosis"))
    return attach_row(row, exact_percentiles(df, [], value, {"median": 0.5}))


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile: rational approximation with relative error below 1.2e-9."""
    # Coefficients of the published rational approximation (central, then tail).
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def poly(coef: list[float], x: Column) -> Column:
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out

    q = p - 0.5
    central = q * poly(a, q * q) / poly(b, q * q)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = poly(c, t) / poly(d, t)
    return F.when(F.abs(q) <= 0.47575, central).when(p < 0.5, tail).otherwise(-tail)


def qq_table(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Ordered values against normal quantiles at Filliben's medians of order statistics."""
    from lumenlog.functions.seq import index_sequence

    ranked = index_sequence(
        df.filter(F.col(value).isNotNull()).select(row_id, value), SeqSpec((), value, value, row_id)
    )
    n, i = F.col(SIZE), F.col(POS) + 1
    edge = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.select(row_id, value, (F.col(POS)).alias("rank"), inverse_normal(p).alias("theoretical"))


def first_events(df: DataFrame, spec: SeqSpec, n: int = 100, label_every: int = 5) -> DataFrame:
    """The first ``n`` events in order; every fifth keeps its time label."""
    head = df.filter(F.col(POS) < n)
    return head.withColumn("label", F.when(F.col(POS) % label_every == 0, F.date_format(spec.ts, "HH:mm:ss")))


def systematic_sample(df: DataFrame, index: Column, every: int = 100) -> DataFrame:
    """Every ``every``-th element in row-major order: the sampling operator of scatter reports."""
    return df.filter(F.pmod(index, F.lit(every)) == 0)
