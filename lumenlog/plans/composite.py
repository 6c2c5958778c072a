"""Composite entry points that chain operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.calendar import calendar_parts, cyclical, temporal_context, time_of_day, weekend_business_flags
from lumenlog.functions.seq import POS, SIZE, SeqSpec, index_sequence, null_safe_join
from lumenlog.functions.stats import mode_by, percentile_values
from lumenlog.functions.storage import materialise
from lumenlog.operators import encode as en
from lumenlog.operators import models as mo
from lumenlog.operators import sequence_features as sf
from lumenlog.operators.tabular import hash_split, mutual_information, outlier_bounds, remove_outliers
from lumenlog.sources.tabular import numeric_columns, string_columns


def features_per_segment(
    df: DataFrame, spec: SeqSpec, segment: str, *features: Callable[[DataFrame, SeqSpec], DataFrame]
) -> DataFrame:
    """Apply sequence features inside every segment: the segment id becomes a key."""
    inner = spec.by(segment)
    out = index_sequence(df.drop(POS, SIZE), inner)
    for f in features:
        out = f(out, inner)
    return out


def extract_all_features(
    df: DataFrame,
    spec: SeqSpec,
    now: Column,
    types: Sequence[str] = (),
    time: bool = True,
    frequency: bool = True,
    transitions: bool = True,
    windows: bool = True,
) -> DataFrame:
    """Time, frequency, transition and window features of an indexed log, each family behind a switch.

    A family sees the sequence columns alone and is stored, so no exchange carries what other families added; the
    stored columns are joined by position at the end. A family has a row for each row of the log, however small its
    files are (Spark sizes them by a share of the files): it is joined by merge and never broadcast.
    """
    families: list[Callable[[DataFrame], DataFrame]] = []
    if time:
        gaps = lambda d: materialise(sf.rolling_gap_statistics(sf.temporal_features(d, spec), spec), "features")
        families.append(lambda d: sf.gap_distribution(gaps(d), spec))
    if windows:
        families.append(lambda d: sf.rolling_common_bigram(sf.rolling_entropy(sf.rolling_distinct(d, spec), spec), spec))
    if frequency:
        families.append(lambda d: sf.rolling_event_rate(d, spec))
        if types:
            families += [lambda d: sf.rolling_type_frequency(d, spec, types), lambda d: sf.type_frequency(d, spec, types)]
    if transitions:
        families += [lambda d, f=f: f(d, spec) for f in (sf.transition_features, sf.transition_history, sf.state_persistence)]
    slim = df.select(*dict.fromkeys([*spec.keys, spec.ts, spec.event, spec.tiebreak, POS, SIZE]))
    out = df
    for family in families:
        made = family(slim)
        made = materialise(made.select(*spec.keys, POS, *[c for c in made.columns if c not in out.columns]), "features")
        out = null_safe_join(out, made.hint("merge"), [*spec.keys, POS])
    if time:
        ts = F.col(spec.ts)
        out = out.withColumns(
            calendar_parts(ts) | weekend_business_flags(ts) | {"time_of_day": time_of_day(ts)} | cyclical(ts) | temporal_context(ts, now)
        )
    return out


@dataclass
class Prepared:
    """Train and test rows with the fitted parameter tables that produced them."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    target: str
    ids: list[str]
    state: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return _apply(df, self.state, self.ids, self.features, None)

    def summary(self) -> DataFrame:
        """Outlier bounds, encoders and selected features as (kind, name, value) rows."""
        spark = self.train.sparkSession
        rows = [("feature", f, float(i)) for i, f in enumerate(self.features)]
        rows += [("median", c, float(v)) for c, v in self.state["medians"].items()]
        out = spark.createDataFrame(rows, "kind string, name string, value double")
        if self.state["bounds"] is not None:
            cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("lower", "upper")])
            out = out.unionByName(self.state["bounds"].select(F.lit("outlier_bound").alias("kind"), F.inline(cells)))
        for c, table in self.state["encoders"].items():
            kind, code = ("frequency", f"{c}_freq") if f"{c}_freq" in table.columns else ("category", f"{c}_code")
            out = out.unionByName(
                table.select(F.lit(kind).alias("kind"), F.concat_ws("=", F.lit(c), F.col(c)).alias("name"), F.col(code).cast("double").alias("value"))
            )
        return out


def _apply(df: DataFrame, state: dict, ids: list[str], features: list[str], target: str | None) -> DataFrame:
    for c, m in state["medians"].items():
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(m))) if c in df.columns else df.withColumn(c, F.lit(m))
    for c, m in state["modes"].items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(m)) if c in df.columns else F.lit(m))
    for c, table in state["encoders"].items():
        if f"{c}_freq" in table.columns:
            df = en.encode_frequency(df, c, table).drop(c)
        else:
            df = en.encode_category(df, c, table).drop(c).withColumnRenamed(f"{c}_code", c)
    if state["scaler"] is not None:
        df = en.scale(df, state["scaler"], state["scaled"])
    return df.select(*ids, *features, *([target] if target else []))


def prepare_data(
    df: DataFrame,
    target: str,
    ids: list[str],
    improved: bool = False,
    scaling: str | None = None,
    k_best: int = 15,
    outliers: bool = True,
    test_size: float = 0.2,
    seed: int = 42,
) -> Prepared:
    """Split by hash, then fit imputation, encoding, selection and scaling on the training rows only."""
    scaling = scaling or ("robust" if improved else "standard")
    rows = hash_split(df, ids, test_size, seed)
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    bounds = None
    if improved and outliers:
        bounds = outlier_bounds(train, target)
        train = remove_outliers(train, target)
    # Every fitted table below reads the training rows again.
    train = materialise(train, "train")
    numeric = [c for c in numeric_columns(df) if c not in (*ids, target)]
    strings = [c for c in string_columns(df) if c not in (*ids, target)]
    medians = percentile_values(train, {c: (c, 0.5) for c in numeric})
    modes = {c: (mode_by(train, [], c, "m").first() or {"m": None})["m"] or "Unknown" for c in strings}
    counts = train.agg(F.lit(1).alias("_one"), *[F.countDistinct(c).alias(c) for c in strings]).first()
    filled = train.fillna(medians).fillna(modes)
    encoders = {}
    for c in strings:
        frequent = improved and counts[c] > 10
        encoders[c] = materialise(en.frequency_map(filled, c) if frequent else en.category_codes(filled, c), "encoder")
    names = [*numeric, *[f"{c}_freq" if f"{c}_freq" in encoders[c].columns else c for c in strings]]
    state = {"medians": medians, "modes": modes, "encoders": encoders, "scaler": None, "scaled": [], "bounds": bounds}
    encoded = materialise(_apply(train, state, ids, names, target), "encoded")
    if improved and k_best < len(names):
        names = [r["feature"] for r in mutual_information(encoded, names, target).limit(k_best).collect()]
        encoded = encoded.select(*ids, *names, target)
    scaled = [n for n in names if n in numeric] or names
    state |= {"scaler": materialise(en.fit_scaler(encoded, scaled, scaling), "scaler"), "scaled": scaled}
    return Prepared(_apply(train, state, ids, names, target), _apply(test, state, ids, names, target), names, target, ids, state)


@dataclass
class TabularRun:
    prepared: Prepared
    models: dict
    folds: DataFrame
    metrics: DataFrame

    def best(self, by: str = "rmse") -> str:
        return mo.best_model(self.metrics, by).first()["model"]

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        rows = self.prepared.transform(df)
        vectors = mo.VectorAssembler(inputCols=self.prepared.features, outputCol=mo.FEATURES)
        return self.models[name or self.best()].transform(vectors.transform(rows))


def run_tabular(df: DataFrame, target: str, ids: list[str], names: Sequence[str], improved: bool = False, folds: int = 5) -> TabularRun:
    """Prepare, cross-validate, train and evaluate every named model on the test rows."""
    prepared = prepare_data(df, target, ids, improved)
    data = mo.add_folds(mo.assemble(prepared.train, prepared.features, target), ids, folds).persist()
    models, table = mo.train_all(data, names, len(prepared.features), folds)
    test = mo.assemble(prepared.test, prepared.features, target)
    scores = mo.metric_table({n: m.transform(test) for n, m in models.items()}, len(prepared.features))
    return TabularRun(prepared, models, table, mo.composite_score(scores))
