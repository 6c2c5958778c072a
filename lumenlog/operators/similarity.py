"""Measures of one sequence and comparisons of two logs, one row per sequence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import POS, SIZE, SeqSpec, attach, index_sequence, null_safe_join, over_rows, run_bounds, sequence_stats
from lumenlog.functions.stats import mode_by, ratio, safe_corr
from lumenlog.functions.storage import materialise
from lumenlog.operators.aggregates import transition_matrix
from lumenlog.operators.patterns import ngram_rows
from lumenlog.operators.sequence_features import EPS_LOG, gap0, ngram_column


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return null_safe_join(a, b, keys, "left")
    from lumenlog.functions.seq import attach_row

    return attach_row(a, b)


def _entropy(df: DataFrame, spec: SeqSpec, log, name: str) -> DataFrame:
    counts = df.groupBy(*spec.keys, spec.event).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*spec.keys)
    p = F.col("_c") / F.sum("_c").over(whole)
    rows = counts.withColumn("_p", p)
    return rows.groupBy(*spec.keys).agg(
        F.sum(-F.col("_p") * log(F.col("_p") + EPS_LOG)).alias(name), F.count("*").alias("_types"), F.sum("_c").alias("_len")
    )


def basic_statistics(df: DataFrame, spec: SeqSpec) -> DataFrame:
    row = df.groupBy(*spec.keys).agg(F.count("*").alias("length"), F.countDistinct(spec.event).alias("unique_events"))
    row = _join(row, mode_by(df, spec.keys, spec.event, "most_common_event"), spec.keys)
    return row.withColumn("event_diversity", F.col("unique_events") / F.col("length"))


def complexity_metrics(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """log2 entropy, its maximum and ratio, and rows per distinct trigram."""
    row = _entropy(df, spec, F.log2, "entropy")
    grams = ngram_rows(df, spec, 3, 3).groupBy(*spec.keys).agg(F.countDistinct("pattern").alias("_tri"))
    row = _join(row, grams, spec.keys)
    top = F.log2(F.col("_types").cast("double"))
    return row.select(
        *spec.keys,
        F.when(F.col("_len") < 2, 0.0).otherwise(F.col("entropy")).alias("entropy"),
        top.alias("max_entropy"),
        F.when(F.col("_types") > 1, F.col("entropy") / F.when(F.col("_types") > 1, top)).otherwise(0.0).alias("normalized_entropy"),
        F.coalesce(ratio(F.col("_len"), F.col("_tri")), F.lit(1.0)).alias("compression_ratio"),
    )


def transition_analysis(df: DataFrame, spec: SeqSpec) -> DataFrame:
    pairs = transition_matrix(df, spec)
    return pairs.groupBy(*spec.keys).agg(
        F.sum("n").alias("total_transitions"), F.count("*").alias("unique_transitions"),
        F.min(F.struct(-F.col("n"), F.concat_ws("->", "from_event", "to_event").alias("pair")))["pair"].alias("most_common_transition"),
        (F.count("*") / F.sum("n")).alias("transition_diversity"),
    )


def repetition_analysis(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Runs longer than one: how many, mean and longest."""
    start = lambda s: {"_start": F.coalesce(F.lag(s.event).over(s.window) != F.col(s.event), F.lit(True))}
    rows = run_bounds(over_rows(df, spec, start), spec, F.col("_start") | (F.col(POS) == 0))
    head = F.when((F.col(POS) == F.col("run_start")) & (F.col("run_size") > 1), F.col("run_size"))
    return rows.groupBy(*spec.keys).agg(
        F.count(head).alias("total_repetitions"), F.coalesce(F.avg(head), F.lit(0.0)).alias("avg_repetition_length"),
        F.coalesce(F.max(head), F.lit(0)).alias("max_repetition_length"),
    )


def sample_entropy(df: DataFrame, spec: SeqSpec, m: int = 2, r: float = 0.2) -> DataFrame:
    """-ln of matching (m+1)-grams over matching m-grams, event types coded alphabetically.

    Two templates match when every code differs by at most r times the sd of the codes.  Templates
    are counted once per distinct gram; each gram looks up its neighbours by equality.
    """
    keys = list(spec.keys)
    types = df.groupBy(*keys, spec.event).agg(F.count("*").alias("_c"))
    code = F.dense_rank().over(Window.partitionBy(*keys).orderBy(spec.event)) - 1
    coded = types.withColumn("_code", code)
    n, c, k = F.sum("_c"), F.col("_code").cast("double"), F.col("_c")
    spread = coded.groupBy(*keys).agg((F.sum(k * c * c) / n - F.pow(F.sum(k * c) / n, F.lit(2.0))).alias("_v"), n.alias("_rows"))
    spread = spread.withColumn("_tol", F.floor(r * F.sqrt(F.greatest(F.col("_v"), F.lit(0.0))) + 1e-12).cast("int"))
    log = attach(df, coded.select(*keys, spec.event, "_code"), spec, by=[spec.event])
    as_code = SeqSpec(spec.keys, spec.ts, "_code", spec.tiebreak, spec.chunk_rows)

    def matches(length: int, name: str) -> DataFrame:
        grams = ngram_rows(log, as_code, length, length).groupBy(*keys, "pattern").agg(F.count("*").alias("_n"))
        grams = _join(grams, spread.select(*keys, "_tol"), keys)
        near = F.array(F.array().cast("array<int>"))
        for i in range(1, length + 1):
            around = F.sequence(F.element_at("pattern", i) - F.col("_tol"), F.element_at("pattern", i) + F.col("_tol"))
            near = F.flatten(F.transform(near, lambda head: F.transform(around, lambda x: F.array_append(head, x))))
        other = grams.select(*keys, F.col("pattern").alias("_near"), F.col("_n").alias("_m"))
        pairs = null_safe_join(grams.select(*keys, "_n", F.explode(near).alias("_near")), other, [*keys, "_near"])
        whole = grams.groupBy(*keys).agg(F.sum("_n").alias("_total"))
        sums = pairs.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_m")).alias("_pairs"))
        return _join(whole, sums, keys).select(*keys, ((F.col("_pairs") - F.col("_total")) / 2).alias(name))

    row = _join(spread.select(*keys, "_rows"), matches(m, "_a"), keys)
    row = _join(row, matches(m + 1, "_b"), keys)
    a, b = F.coalesce(F.col("_a"), F.lit(0.0)), F.coalesce(F.col("_b"), F.lit(0.0))
    value = F.when((a > 0) & (b > 0), -F.log(F.when(b > 0, b) / F.when(a > 0, a))).otherwise(0.0)
    return row.select(*keys, value.alias("sample_entropy"))


def lempel_ziv(df: DataFrame, spec: SeqSpec, max_length: int = 9) -> DataFrame:
    """Share of positions that add a new substring (shortest unseen one, at most ``max_length`` long).

    Positions descend a trie of seen substrings one level per round: at each node the earliest
    position stops (it adds the node), the others move on with one more event.
    """
    keys = list(spec.keys)
    step = lambda s: {"_ahead": F.collect_list(s.event).over(s.rows(0, max_length - 1))}
    left = over_rows(df, spec, step, before=0, after=max_length).select(*keys, POS, SIZE, "_ahead")
    left = materialise(left, "trie")
    added = None
    for d in range(1, max_length + 1):
        path = left.filter(F.col(POS) + d <= F.col(SIZE)).withColumn("_path", F.slice("_ahead", 1, d))
        first = path.groupBy(*keys, "_path").agg(F.min(POS).alias(POS)).select(*keys, POS)
        first = materialise(first, "trie")
        added = first if added is None else added.unionByName(first)
        if d < max_length:
            marked = null_safe_join(left, first.withColumn("_hit", F.lit(1)), [*keys, POS], "left")
            left = materialise(marked.filter(F.col("_hit").isNull()).drop("_hit"), "trie")
    counts = added.groupBy(*keys).agg(F.count("*").alias("_new"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return _join(sizes, counts, keys).select(*keys, (F.coalesce("_new", F.lit(0)) / F.col("_rows")).alias("lempel_ziv_complexity"))


def sequence_complexity(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Natural-log entropy, its normalised form and the mean entropy of the transition rows."""
    row = _entropy(df, spec, F.log, "entropy")
    matrix = transition_matrix(df, spec)
    per_state = matrix.groupBy(*spec.keys, "from_event").agg(F.sum(-F.col("prob") * F.log(F.col("prob") + EPS_LOG)).alias("_h"))
    row = _join(row, per_state.groupBy(*spec.keys).agg(F.avg("_h").alias("_avg")), spec.keys)
    top = F.log(F.greatest(F.col("_types"), F.lit(2)).cast("double"))
    return row.select(
        *spec.keys, "entropy", F.when(F.col("_types") > 1, F.col("entropy") / top).otherwise(0.0).alias("normalized_entropy"),
        F.coalesce("_avg", F.lit(0.0)).alias("avg_transition_entropy"),
    )


def analyze_sequence(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Basic statistics, complexity, transitions, repetitions and sample entropy per sequence."""
    row = basic_statistics(df, spec)
    for part in (complexity_metrics(df, spec), transition_analysis(df, spec), repetition_analysis(df, spec), sample_entropy(df, spec)):
        row = _join(row, part, spec.keys)
    return row


def edit_distance(first: DataFrame, second: DataFrame, spec: SeqSpec, types: Sequence[str] | None = None) -> DataFrame:
    """Levenshtein distance per sequence: each event type becomes one character of a string.

    The characters come from the types of both logs (``types`` puts some first); a sequence that only one log has is
    compared with an empty one.  Needs keys, because a distance compares two bounded sequences (one session or user each).
    """
    if not spec.keys:
        raise ValueError("edit distance compares bounded sequences: give keys")
    seen = first.select(spec.event).union(second.select(spec.event)).distinct()
    given = F.array_position(F.array(*[F.lit(t) for t in types or [""]]), F.col(spec.event))
    rank = F.row_number().over(Window.orderBy(F.when(given > 0, given).otherwise(len(types or []) + 1), spec.event))
    # The codes 0xD800 to 0xDFFF are no characters.
    code = 0xFF + rank + F.when(rank >= 0xD800 - 0xFF, 0x800).otherwise(0)
    codes = seen.select(spec.event, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32").alias("_c"))

    def text(df: DataFrame, name: str) -> DataFrame:
        coded = null_safe_join(df.select(*spec.keys, spec.ts, spec.tiebreak, spec.event), codes, [spec.event])
        items = F.array_sort(F.collect_list(F.struct(F.col(spec.ts), F.col(spec.tiebreak), F.col("_c").alias("c"))))
        return coded.groupBy(*spec.keys).agg(F.array_join(F.transform(items, lambda x: x["c"]), "").alias(name))

    sides = text(first, "_s1").withColumn("_s2", F.lit(None).cast("string")).unionByName(text(second, "_s2").withColumn("_s1", F.lit(None).cast("string")))
    both = sides.groupBy(*spec.keys).agg(*[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("_s1", "_s2")])
    return both.select(*spec.keys, F.levenshtein("_s1", "_s2").alias("edit_distance"))


def compare_sequences(first: DataFrame, second: DataFrame, spec: SeqSpec) -> DataFrame:
    """Length ratio, Jaccard of event sets and cosine of count vectors for sequences with equal keys."""
    on = [*spec.keys, spec.event]
    zero = F.lit(0).cast("long")
    a = first.groupBy(*on).agg(F.count("*").alias("_a")).withColumn("_b", zero)
    b = second.groupBy(*on).agg(F.count("*").alias("_b")).withColumn("_a", zero)
    both = a.unionByName(b).groupBy(*on).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    x, y = F.col("_a").cast("double"), F.col("_b").cast("double")
    row = both.groupBy(*spec.keys).agg(
        F.coalesce(ratio(F.sum("_a"), F.sum("_b")), F.lit(0.0)).alias("length_ratio"),
        F.coalesce(ratio(F.count_if((x > 0) & (y > 0)), F.count("*")), F.lit(0.0)).alias("event_overlap"),
        F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0)).alias("cosine_similarity"),
    )
    return row


def similar_subsequences(df: DataFrame, spec: SeqSpec, length: int = 3, min_similarity: float = 0.7) -> DataFrame:
    """Pairs of event sets of windows at least ``length`` apart whose Jaccard reaches the threshold.

    Windows collapse to their distinct event sets first.  Sets meet on a shared prefix element
    (enough of them that no qualifying pair is missed), and the number of position pairs comes from
    the set counts minus the pairs that lie too close.
    """
    keys = list(spec.keys)

    def windows(s: SeqSpec) -> dict[str, Column]:
        return {"_set": F.array_sort(F.array_distinct(ngram_column(s, length)))}

    def ahead(s: SeqSpec) -> dict[str, Column]:
        near = [F.lead("_set", k).over(s.window) for k in range(1, length)]
        return {"_near": F.array_compact(F.array(*near))}

    usable = lambda s: {"_set": F.when(F.col(POS) + length < F.col(SIZE), F.col("_set"))}
    rows = over_rows(df, spec, windows, usable, ahead, before=0, after=2 * length).filter(F.col("_set").isNotNull())
    sets = rows.groupBy(*keys, "_set").agg(F.count("*").alias("_n"))
    close = rows.select(*keys, "_set", F.explode("_near").alias("_other"))
    close = close.select(
        *keys, F.least(F.array_join("_set", "|"), F.array_join("_other", "|")).alias("set1"),
        F.greatest(F.array_join("_set", "|"), F.array_join("_other", "|")).alias("set2"),
    ).groupBy(*keys, "set1", "set2").agg(F.count("*").alias("_close"))
    named = sets.withColumn("_name", F.array_join("_set", "|"))
    size = F.size("_set")
    prefix = F.slice("_set", 1, (size - F.ceil(min_similarity * size - 1e-9) + 1).cast("int"))
    items = named.select(*keys, "_set", "_name", "_n", F.explode(prefix).alias("_item"))
    other = items.select(*keys, "_item", F.col("_set").alias("_set2"), F.col("_name").alias("set2"), F.col("_n").alias("_n2"))
    met = null_safe_join(items.withColumnRenamed("_name", "set1"), other, [*keys, "_item"]).filter(F.col("set1") <= F.col("set2"))
    met = met.drop("_item").dropDuplicates([*keys, "set1", "set2"])
    common = F.size(F.array_intersect("_set", "_set2"))
    similarity = common / (F.size("_set") + F.size("_set2") - common)
    met = met.withColumn("similarity", similarity).filter(F.col("similarity") >= min_similarity)
    out = null_safe_join(met, close, [*keys, "set1", "set2"], "left")
    n, m = F.col("_n"), F.col("_n2")
    every = F.when(F.col("set1") == F.col("set2"), F.expr("_n * (_n - 1) div 2")).otherwise(n * m)
    out = out.withColumn("pairs", every - F.coalesce("_close", F.lit(0))).filter(F.col("pairs") > 0)
    return out.select(*keys, "set1", "set2", "similarity", "pairs")


def gap_autocorrelation(df: DataFrame, spec: SeqSpec, lags: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    rows = over_rows(
        df,
        spec,
        gap0,
        lambda s: {f"_l{k}": F.lag("time_since_previous", k).over(s.window) for k in lags},
        before=max(lags) + 1,
    )
    g = F.col("time_since_previous")
    return rows.groupBy(*spec.keys).agg(
        *[F.coalesce(safe_corr(F.col(f"_l{k}"), g), F.lit(0.0)).alias(f"autocorr_lag_{k}") for k in lags]
    )


MAX_SPECTRUM = 1 << 22


def dominant_frequency(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Index of the strongest frequency of the gaps and its share of the non-constant power.

    One spectrum per sequence with at least 10 rows.  A transform needs its whole series, so a
    sequence beyond ``MAX_SPECTRUM`` rows is an error: cut it into segments first.
    """
    if not spec.keys:
        raise ValueError("a spectrum is taken per bounded sequence: give keys")
    keys = list(spec.keys)
    guard = F.when(F.col(SIZE) > MAX_SPECTRUM, F.raise_error(F.lit("sequence too long for one spectrum"))).otherwise(F.col(POS))
    rows = over_rows(df, spec, gap0).filter(F.col(SIZE) >= 10).select(*keys, guard.alias(POS), "time_since_previous")
    schema = T.StructType(
        [*[rows.schema[k] for k in keys], T.StructField("dominant_frequency", T.LongType()), T.StructField("periodicity_strength", T.DoubleType())]
    )

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values(POS)["time_since_previous"].to_numpy()
        power = np.abs(np.fft.fft(g - g.mean())) ** 2
        at = int(np.argmax(power[1 : len(power) // 2])) + 1
        total = power[1:].sum()
        out = pdf.iloc[:1][keys].copy()
        out["dominant_frequency"], out["periodicity_strength"] = at, power[at] / total if total > 0 else 0.0
        return out

    return rows.groupBy(*keys).applyInPandas(spectrum, schema)
