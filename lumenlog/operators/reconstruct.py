"""Detection and filling of missing events, and sequence correction.

Inserted rows carry ``reconstruction_method`` and ``reconstruction_confidence``; originals get
``original`` and 1.0.  Rules are small parameters, never data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import (
    POS,
    SIZE,
    SeqSpec,
    attach,
    index_sequence,
    null_safe_join,
    over_rows,
    seconds,
)
from lumenlog.functions.storage import materialise
from lumenlog.operators.aggregates import event_probabilities, gap_model, markov_model
from lumenlog.operators.scans import scan
from lumenlog.operators.sequence_features import repair_timestamps, spread_same_timestamp, swap_end_before_start

METHOD, CONFIDENCE = "reconstruction_method", "reconstruction_confidence"

# Default rules.
SEQUENCE_RULES = [
    ["start", "process", "complete"],
    ["begin", "work", "end"],
    ["init", "execute", "finish"],
    ["open", "process", "close"],
    ["create", "edit", "save"],
    ["login", "activity", "logout"],
]
PAIR_RULES = [("start", "end"), ("begin", "finish"), ("open", "close"), ("login", "logout"), ("create", "delete")]
PERIODIC_RULES = {"heartbeat": 30.0}
DIRECT_JUMPS = [("start", "complete", "process"), ("begin", "end", "work"), ("init", "finish", "execute")]
IMPOSSIBLE_TRANSITIONS = [
    ("end", "start", "reset"),
    ("complete", "begin", "prepare"),
    ("finish", "init", "cleanup"),
    ("close", "open", "setup"),
    ("logout", "login", "session_end"),
]
EVENT_PRIORITY = {
    "error": 1, "start": 2, "begin": 2, "init": 2, "process": 3, "work": 3, "execute": 3, "complete": 4, "end": 4, "finish": 4,
}
CONFIDENCE_OF = {"rule_based_sequence": 0.8, "rule_based_pair": 0.7, "rule_based_periodic": 0.6, "sequence_correction": 1.0, "impossible_transition": 0.7}


def as_original(df: DataFrame) -> DataFrame:
    """Tag rows as original unless they already carry a method; keep inserted confidences."""
    method = F.coalesce(F.col(METHOD), F.lit("original")) if METHOD in df.columns else F.lit("original")
    confidence = F.coalesce(F.col(CONFIDENCE), F.lit(1.0)) if CONFIDENCE in df.columns else F.lit(1.0)
    return df.withColumns({METHOD: method, CONFIDENCE: confidence})


def _inserted(df: DataFrame, spec: SeqSpec, ts_us: Column, event: Column, method: str, confidence: Column | None = None) -> DataFrame:
    conf = confidence if confidence is not None else F.lit(CONFIDENCE_OF[method])
    return df.select(
        *spec.keys, F.timestamp_micros(ts_us.cast("long")).alias(spec.ts), event.alias(spec.event), F.lit(method).alias(METHOD), conf.alias(CONFIDENCE)
    )


def fill(df: DataFrame, *insertions: DataFrame) -> DataFrame:
    """Originals plus inserted rows; columns the insertions lack are NULL."""
    out = as_original(df.drop(POS, SIZE))
    for rows in insertions:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def index_stored(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """``index_sequence`` of rows that take work to make: a range exchange reads its input twice, so they are stored first."""
    return index_sequence(materialise(df, "filled"), spec)


def missing_sequence_events(df: DataFrame, spec: SeqSpec, rules: Sequence[Sequence[str]] = SEQUENCE_RULES) -> DataFrame:
    """Rule events absent after a rule's first event, with estimated times, one row per missing event.

    Each rule is walked over the next rows: a rule event that does not match the current row is
    missing, at the midpoint of the last matched or estimated time and that row.
    """
    longest = max(len(r) for r in rules)
    row = F.struct(F.col(spec.event).alias("e"), F.unix_micros(spec.ts).alias("t"))
    ahead = over_rows(
        df, spec, lambda s: {"_ahead": F.collect_list(row).over(s.rows(0, longest - 1))}, before=0, after=longest
    )
    item = "array<struct<event:string,t:bigint>>"

    def walk(rule: Sequence[str]) -> Column:
        def step(acc: Column, want: Column) -> Column:
            cur = F.try_element_at(F.col("_ahead"), acc["i"])
            hit = cur["e"] == want
            est = acc["prev"] + F.floor((cur["t"] - acc["prev"]) / 2)
            found = F.struct(acc["i"] + 1, cur["t"], acc["out"])
            absent = F.struct(acc["i"], est.cast("long"), F.array_append(acc["out"], F.struct(want.alias("event"), est.cast("long").alias("t"))))
            names = "struct<i:int,prev:bigint,out:" + item + ">"
            return F.when(hit, found.cast(names)).otherwise(absent.cast(names))

        start = F.struct(
            F.lit(1).alias("i"), F.lit(None).cast("bigint").alias("prev"), F.array().cast(item).alias("out")
        )
        walked = F.aggregate(F.array(*[F.lit(e) for e in rule]), start, step)["out"]
        applies = (F.col(spec.event) == rule[0]) & (F.col(POS) + len(rule) <= F.col(SIZE))
        return F.when(applies, walked).otherwise(F.array().cast(item))

    missing = F.flatten(F.array(*[walk(r) for r in rules]))
    return ahead.select(*spec.keys, POS, F.inline(missing)).withColumnRenamed("t", "expected_us")


def fill_sequence_events(df: DataFrame, spec: SeqSpec, rules: Sequence[Sequence[str]] = SEQUENCE_RULES) -> DataFrame:
    rows = missing_sequence_events(df, spec, rules)
    return _inserted(rows, spec, F.col("expected_us"), F.col("event"), "rule_based_sequence")


def unmatched_pairs(df: DataFrame, spec: SeqSpec, pairs: Sequence[tuple[str, str]] = PAIR_RULES) -> DataFrame:
    """Surplus starts and ends per pair and sequence."""
    ev = F.col(spec.event)
    aggs = []
    for a, b in pairs:
        aggs += [
            F.count_if(ev == a).alias(f"s_{a}_{b}"),
            F.count_if(ev == b).alias(f"e_{a}_{b}"),
            F.max(F.when(ev == a, F.unix_micros(spec.ts))).alias(f"t_{a}_{b}"),
        ]
    row = df.groupBy(*spec.keys).agg(*aggs)
    cells = []
    for a, b in pairs:
        s, e = F.col(f"s_{a}_{b}"), F.col(f"e_{a}_{b}")
        cells.append(
            F.struct(
                F.lit(a).alias("start_event"), F.lit(b).alias("end_event"), (s - F.least(s, e)).alias("unmatched_starts"),
                (e - F.least(s, e)).alias("unmatched_ends"), F.col(f"t_{a}_{b}").alias("last_start_us"),
            )
        )
    return row.select(*spec.keys, F.inline(F.array(*cells)))


def fill_pair_events(df: DataFrame, spec: SeqSpec, pairs: Sequence[tuple[str, str]] = PAIR_RULES, minutes: int = 30) -> DataFrame:
    """One end event per pair with surplus starts, ``minutes`` after the last start."""
    rows = unmatched_pairs(df, spec, pairs).filter(F.col("unmatched_starts") > 0)
    return _inserted(rows, spec, F.col("last_start_us") + minutes * 60_000_000, F.col("end_event"), "rule_based_pair")


def missing_periodic_events(df: DataFrame, spec: SeqSpec, rules: Mapping[str, float] = PERIODIC_RULES) -> DataFrame:
    """Gaps between successive events of a periodic type with the number of missing ones.

    The periodic events are indexed as their own (smaller) sequence per type.
    """
    beats = df.filter(F.col(spec.event).isin(list(rules))).select(*spec.keys, spec.event, spec.ts, spec.tiebreak)
    typed = spec.by(spec.event)
    rows = over_rows(
        index_sequence(beats, typed), typed, lambda s: {"_next": F.lead(s.ts).over(s.window)}, before=0, after=1
    )
    pairs = [F.lit(x) for kv in rules.items() for x in kv]
    interval = F.element_at(F.create_map(*pairs), F.col(spec.event))
    expected = F.floor(seconds(F.col("_next"), F.col(spec.ts)) / interval)
    return rows.filter(expected > 1).select(
        *spec.keys, F.col(spec.event).alias("event"), F.unix_micros(spec.ts).alias("start_us"), F.unix_micros("_next").alias("end_us"),
        (expected - 1).alias("missing_count"),
    )


def fill_periodic_events(df: DataFrame, spec: SeqSpec, rules: Mapping[str, float] = PERIODIC_RULES) -> DataFrame:
    rows = missing_periodic_events(df, spec, rules)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("missing_count"))))
    step = F.expr("(end_us - start_us) * _i div (missing_count + 1)")
    return _inserted(rows, spec, F.col("start_us") + step, F.col("event"), "rule_based_periodic")


def insert_between(
    df: DataFrame, spec: SeqSpec, rules: Sequence[tuple[str, str, str]], method: str
) -> DataFrame:
    """For each adjacent (from, to) of a rule, one inserted event at the midpoint in time."""
    pairs = [F.lit(x) for a, b, c in rules for x in (f"{a}\x1f{b}", c)]
    rows = over_rows(
        df,
        spec,
        lambda s: {"_to": F.lead(s.event).over(s.window), "_t1": F.unix_micros(F.lead(s.ts).over(s.window))},
        before=0,
        after=1,
    )
    event = F.try_element_at(F.create_map(*pairs), F.concat_ws("\x1f", spec.event, "_to"))
    rows = rows.withColumn("_new", event).filter(F.col("_new").isNotNull())
    mid = F.expr(f"unix_micros({spec.ts}) + (_t1 - unix_micros({spec.ts})) div 2")
    return _inserted(rows, spec, mid, F.col("_new"), method)


def insert_direct_jumps(df: DataFrame, spec: SeqSpec, rules=DIRECT_JUMPS) -> DataFrame:
    return insert_between(df, spec, rules, "sequence_correction")


def insert_impossible_transitions(df: DataFrame, spec: SeqSpec, rules=IMPOSSIBLE_TRANSITIONS) -> DataFrame:
    return insert_between(df, spec, rules, "impossible_transition")


def significant_gaps(df: DataFrame, spec: SeqSpec, model: DataFrame, threshold: float = 2.0) -> DataFrame:
    """z-score of each gap under the same-type gap model of the previous event, and how many to insert.

    ``model`` comes from ``gap_model`` with the same keys (or without keys for one shared model).
    """
    rows = over_rows(
        df,
        spec,
        lambda s: {
            "gap_size": seconds(F.col(s.ts), F.lag(s.ts).over(s.window)),
            "prev_event": F.lag(s.event).over(s.window),
            "prev_us": F.unix_micros(F.lag(s.ts).over(s.window)),
        },
    )
    keyed = [k for k in spec.keys if k in model.columns]
    table = model.select(*keyed, F.col(spec.event).alias("prev_event"), F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    if len(keyed) == len(spec.keys):
        rows = attach(rows, table, spec, by=["prev_event"])
    else:
        rows = null_safe_join(rows, table, [*keyed, "prev_event"], "left")
    z = F.when(F.col("_std") > 0, (F.col("gap_size") - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
    n = F.least(F.greatest(F.floor(F.col("gap_size") / F.col("_mean")) - 1, F.lit(0)), F.lit(5))
    return rows.withColumns(
        {
            "z_score": F.when(F.col("gap_size").isNotNull(), z),
            "is_significant": F.coalesce(F.abs(z) > threshold, F.lit(False)) & F.col("gap_size").isNotNull(),
            "num_events": F.when(F.col("_mean") > 0, n).otherwise(F.lit(1)).cast("int"),
        }
    ).drop("_mean", "_std")


#: Transitions of a key up to which its model is joined to the rows as a whole.
MAX_TOGETHER = 256


def markov_fill(
    df: DataFrame,
    spec: SeqSpec,
    model: DataFrame,
    probabilities: DataFrame,
    gaps: DataFrame,
    order: int = 1,
    mode: str = "sample",
    seed: int = 42,
    max_events: int = 5,
) -> DataFrame:
    """Insert Markov-predicted events into the significant gaps (rows of ``significant_gaps``).

    Step i picks from the successors of the state, the true next event's weight doubled (at most 1);
    without successors it picks from the event distribution.  ``mode="sample"`` draws with a hash of
    (keys, position, step, seed), so results repeat; ``mode="argmax"`` takes the heaviest event.
    """
    keyed = [k for k in spec.keys if k in model.columns]
    item = F.struct(F.col("next_event").alias("e"), F.col("prob").alias("p"))
    successors = model.groupBy(*keyed, F.col("state").alias("_state")).agg(F.array_sort(F.collect_list(item)).alias("_succ"))
    # The model is read once per step: store it instead of training it again.
    successors = materialise(successors, "successors")
    prior_keys = [k for k in spec.keys if k in probabilities.columns]
    prior_item = F.struct(F.col(spec.event).alias("e"), F.col("prob").alias("p"))
    prior = probabilities.groupBy(*prior_keys).agg(F.array_sort(F.collect_list(prior_item)).alias("_prior"))
    # Small models travel with the rows in one join for all steps; larger ones are joined step by step.
    together = bool(keyed) and keyed == prior_keys
    if together:
        sizes = successors.groupBy(*keyed).agg(F.sum(F.size("_succ")).alias("n"))
        together = (sizes.agg(F.max("n")).first()[0] or 0) <= MAX_TOGETHER
    if together:
        table = successors.groupBy(*keyed).agg(F.map_from_entries(F.collect_list(F.struct("_state", "_succ"))).alias("_table"))
        prior = null_safe_join(prior, table, keyed, "left")
    rows = gaps.filter(F.col("is_significant") & (F.col("num_events") > 0))
    rows = rows.withColumn("_state", F.array_repeat(F.col("prev_event"), order))
    if prior_keys:
        rows = null_safe_join(rows, prior, prior_keys, "left")
    else:
        from lumenlog.functions.seq import attach_row

        rows = attach_row(rows, prior)
    true_next = F.col(spec.event)

    def picked(succ: Column, i: Column) -> Column:
        # Weight used for the pick next to the model probability that becomes the confidence.
        weigh = lambda x: F.struct(F.when(x["e"] == true_next, F.least(x["p"] * 2, F.lit(1.0))).otherwise(x["p"]).alias("w"), x["e"].alias("e"), x["p"].alias("p"))
        plain = lambda x: F.struct(x["p"].alias("w"), x["e"].alias("e"), x["p"].alias("p"))
        options = F.coalesce(F.transform(succ, weigh), F.transform("_prior", plain))
        if mode == "argmax":
            return F.array_min(F.transform(options, lambda x: F.struct((-x["w"]).alias("neg"), x["e"].alias("e"), x["p"].alias("p"))))
        h = F.xxhash64(*[F.col(k) for k in spec.keys], F.col(POS), i, F.lit(seed))
        u = F.pmod(h, F.lit(1 << 53)) / F.lit(float(1 << 53))
        total = F.aggregate(options, F.lit(0.0), lambda a, x: a + x["w"])
        names = "struct<left:double,e:string,p:double>"

        def draw(acc: Column, x: Column) -> Column:
            # The first event whose cumulative weight passes the draw is kept; the last one closes the range.
            step = F.struct(acc["left"] - x["w"], x["e"], x["p"]).cast(names)
            return F.when(acc["e"].isNotNull() & (acc["left"] < 0), acc).otherwise(step)

        start = F.struct(u * total, F.lit(None).cast("string"), F.lit(None).cast("double")).cast(names)
        return F.aggregate(options, start, draw)

    kind = "array<struct<i:int,event:string,conf:double>>"
    if together:
        one = lambda i, pick: F.transform(F.array(pick), lambda x: F.struct(i.alias("i"), x["e"].alias("event"), x["p"].alias("conf")))

        def step(picks: Column, i: Column) -> Column:
            state = F.slice(F.concat(F.col("_state"), F.transform(picks, lambda x: x["event"])), -order, order)
            return F.concat(picks, one(i, picked(F.try_element_at("_table", state), i)).cast(kind))

        steps = F.sequence(F.lit(1), F.least("num_events", F.lit(max_events)))
        picks = F.aggregate(steps, F.array().cast(kind), step)
        sure = lambda x: F.struct(x["i"].alias("i"), x["event"].alias("event"), F.coalesce(x["conf"], F.lit(0.1)).alias("conf"))
        rows = rows.withColumn("_picks", F.transform(picks, sure))
    else:
        rows = rows.withColumn("_picks", F.array().cast(kind))
        for i in range(1, max_events + 1):
            rows = null_safe_join(rows, successors, [*keyed, "_state"], "left")
            rows = rows.withColumn("_pick", picked(F.col("_succ"), F.lit(i)))
            chosen = F.struct(F.lit(i).alias("i"), F.col("_pick")["e"].alias("event"), F.coalesce(F.col("_pick")["p"], F.lit(0.1)).alias("conf"))
            kept = F.slice("_state", 2, order - 1) if order > 1 else F.array().cast("array<string>")
            rows = rows.withColumns(
                {
                    "_picks": F.when(F.col("num_events") >= i, F.array_append("_picks", chosen)).otherwise(F.col("_picks")),
                    "_state": F.array_append(kept, F.col("_pick")["e"]),
                }
            ).drop("_succ", "_pick")
    rows = rows.select(*spec.keys, POS, "prev_us", "gap_size", "num_events", F.unix_micros(spec.ts).alias("_t1"), F.inline("_picks"))
    ts = F.expr("prev_us + (_t1 - prev_us) * i div (num_events + 1)")
    out = rows.withColumnRenamed("event", "_event")
    return out.select(
        *spec.keys, F.timestamp_micros(ts).alias(spec.ts), F.col("_event").alias(spec.event), F.lit("probabilistic").alias(METHOD),
        F.col("conf").alias(CONFIDENCE), "gap_size",
    )


def train_models(df: DataFrame, spec: SeqSpec, order: int = 1, smoothing: float = 0.1) -> dict[str, DataFrame]:
    """The three model tables of the probabilistic method, all lazy."""
    return {
        "markov": markov_model(df, spec, order, smoothing),
        "probabilities": event_probabilities(df, spec, smoothing),
        "gaps": gap_model(df, spec),
    }


def best_middle_events(model: DataFrame, probabilities: DataFrame, spec: SeqSpec, smoothing: float = 0.1) -> DataFrame:
    """Best middle event x of every (a, c) by P(a->x) P(x->c); absent transitions have ``smoothing``.

    The table has one row per pair of event types; types come from the model, not from the rows.
    """
    p = model.select(F.element_at("state", -1).alias("a"), F.col("next_event").alias("b"), F.col("prob").alias("p"))
    types = probabilities.select(F.array_sort(F.collect_set(spec.event)).alias("_types"))
    from lumenlog.functions.seq import attach_row

    # Row a of the matrix: probability of each type after a, completed with the smoothing value.
    out_rows = p.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "p"))).alias("_out"))
    in_rows = p.groupBy(F.col("b").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("a", "p"))).alias("_in"))
    base = attach_row(out_rows, types)
    base = base.withColumn("c", F.explode("_types")).join(in_rows, "c", "left")
    value = lambda m, k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(smoothing))
    scored = F.transform(
        F.col("_types"), lambda x: F.struct((-value("_out", x) * value("_in", x)).alias("neg"), x.alias("x"))
    )
    return base.withColumn("_best", F.array_min(scored)).select(
        "a", "c", F.col("_best")["x"].alias("best_event"), (-F.col("_best")["neg"]).alias("best_prob"), F.col("_out"), F.col("_in")
    )


def optimize_sequence_once(
    df: DataFrame, spec: SeqSpec, model: DataFrame, probabilities: DataFrame, smoothing: float = 0.1, factor: float = 1.5
) -> DataFrame:
    """Replace the middle of each triple where the best middle is ``factor`` times likelier (original neighbours)."""
    rows = over_rows(
        df, spec, lambda s: {"a": F.lag(s.event).over(s.window), "c": F.lead(s.event).over(s.window)}, before=1, after=1
    )
    best = best_middle_events(model, probabilities, spec, smoothing)
    rows = rows.join(best, ["a", "c"], "left")
    ev = F.col(spec.event)
    value = lambda m: F.coalesce(F.try_element_at(F.col(m), ev), F.lit(smoothing))
    better = F.col("best_prob") > value("_out") * value("_in") * factor
    new = F.when(F.coalesce(better, F.lit(False)), F.col("best_event")).otherwise(ev)
    return rows.withColumn("optimized_event", new).drop("a", "c", "best_event", "best_prob", "_out", "_in")


MAX_TYPES = 300


def optimize_sequence(
    df: DataFrame, spec: SeqSpec, model: DataFrame, probabilities: DataFrame, smoothing: float = 0.1, factor: float = 1.5
) -> DataFrame:
    """Left-to-right version: a replaced event is the left neighbour of the next triple.

    The scan is a transducer over event types, so each chunk is a map from the event before it to its
    last event; maps are composed and each chunk replayed.  A model without keys serves all sequences:
    its transition matrix (types x types, checked against ``MAX_TYPES``) is sent to the tasks.  A model
    with keys serves each key by itself: it joins the first row of each of the key's chunks, and only
    the key's own types are alternatives.
    """
    names = [r[0] for r in probabilities.select(spec.event).distinct().orderBy(spec.event).limit(MAX_TYPES + 1).collect()]
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types: use optimize_sequence_once")
    code = {e: i for i, e in enumerate(names)}
    k = len(names)
    keys = list(spec.keys)
    keyed = bool(keys) and all(c in model.columns for c in keys)
    pairs = [F.lit(x) for e, i in code.items() for x in (e, i)]
    number = lambda c: F.element_at(F.create_map(*pairs), c)
    halo = over_rows(
        df.withColumn("_code", number(F.col(spec.event))),
        spec,
        lambda s: {"_right": F.lead("_code").over(s.window)},
        before=0,
        after=1,
    )
    slim = halo.select(*keys, POS, SIZE, "_code", F.coalesce("_right", F.lit(-1)).alias("_right"))

    def choices(matrix: np.ndarray) -> np.ndarray:
        """The middle event chosen for every (left, current, right)."""
        through = matrix[:, :, None] * matrix[None]
        best, top = through.argmax(axis=1), through.max(axis=1)
        return np.where(top[:, None] > through * factor, best[:, None], np.arange(len(matrix))[None, :, None])

    if keyed:
        step = F.struct(number(F.element_at("state", -1)).alias("a"), number(F.col("next_event")).alias("b"), F.col("prob").alias("p"))
        steps = model.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
        own = probabilities.groupBy(*keys).agg(F.array_sort(F.collect_set(number(F.col(spec.event)))).alias("_own"))
        starts = slim.filter(F.col(POS) % spec.chunk_rows == 0).select(*keys, POS)
        models = null_safe_join(null_safe_join(starts, own, keys), steps, keys, "left")
        models = models.select(
            *keys, POS, "_own", *[F.col("_steps")[f].alias(f"_{f}") for f in ("a", "b", "p")]
        )
        slim = null_safe_join(slim, models, [*keys, POS], "left")
    else:
        shared = np.full((k, k), smoothing)
        # At most MAX_TYPES squared rows, checked above.
        for r in model.select(F.element_at("state", -1).alias("a"), "next_event", "prob").toLocalIterator():
            shared[code[r["a"]], code[r["next_event"]]] = r["prob"]
        everything = np.arange(k), choices(shared)

    def of(pdf: pd.DataFrame, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(types, choices among them) of the chunk that starts at a row."""
        if not keyed:
            return everything
        types = np.asarray(pdf["_own"].iat[at], dtype=np.int64)
        matrix = np.full((len(types), len(types)), smoothing)
        if pdf["_a"].iat[at] is not None:
            a, b = (np.searchsorted(types, np.asarray(pdf[c].iat[at], dtype=np.int64)) for c in ("_a", "_b"))
            matrix[a, b] = np.asarray(pdf["_p"].iat[at], dtype=float)
        return types, choices(matrix)

    def to_map(pdf: pd.DataFrame) -> np.ndarray:
        types, choice = of(pdf, 0)
        codes, right, pos = (pdf[c].to_numpy(dtype=np.int64) for c in ("_code", "_right", POS))
        here, ahead = np.searchsorted(types, codes), np.searchsorted(types, right)
        left = np.arange(len(types))
        for b, c, p, r in zip(here, ahead, pos, right):
            left = np.full(len(types), b) if p == 0 or r < 0 else choice[left, b, c]
        if pos[0] == 0:  # nothing stands before
            return np.full(k, types[left[0]])
        out = np.arange(k)
        out[types] = types[left]
        return out

    def replay(pdf: pd.DataFrame, starts: np.ndarray, entry: np.ndarray) -> pd.DataFrame:
        all_codes, all_right, all_pos = (pdf[c].to_numpy(dtype=np.int64) for c in ("_code", "_right", POS))
        out = np.empty(len(pdf), dtype=np.int64)
        for first, end, begin in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], entry.tolist()):
            types, choice = of(pdf, first)
            here = np.searchsorted(types, all_codes[first:end]).tolist()
            ahead = np.searchsorted(types, all_right[first:end]).tolist()
            left, done = int(np.searchsorted(types, begin)), []
            for b, c, r, p in zip(here, ahead, all_right[first:end].tolist(), all_pos[first:end].tolist()):
                left = b if p == 0 or r < 0 else int(choice[left, b, c])
                done.append(left)
            out[first:end] = types[done]
        done = pdf[[*keys, POS]].copy()
        done["optimized_event"] = np.array(names, dtype=object)[out]
        return done

    out_schema = T.StructType(
        [*[slim.schema[x] for x in keys], T.StructField(POS, T.LongType()), T.StructField("optimized_event", T.StringType())]
    )
    done = scan(slim, spec, to_map, replay, out_schema, compose=lambda f, g: g[f], apply=lambda m, s: int(m[s]))
    return null_safe_join(df, done, [*keys, POS])


def reconstruct_rule_based(
    df: DataFrame,
    spec: SeqSpec,
    sequences=SEQUENCE_RULES,
    pairs=PAIR_RULES,
    periodic=PERIODIC_RULES,
    transitions=IMPOSSIBLE_TRANSITIONS,
    priority: Mapping[str, int] = EVENT_PRIORITY,
) -> DataFrame:
    """Rule insertions, then on the filled log the correction of its order, and removal of blank events.

    The correction exchanges end-before-start neighbours, spreads equal timestamps by priority and fills impossible
    transitions (``correct_rule_errors``).
    """
    filled = fill(
        df,
        fill_sequence_events(df, spec, sequences),
        fill_pair_events(df, spec, pairs),
        fill_periodic_events(df, spec, periodic),
    )
    ordered = index_stored(with_insert_order(filled, spec), spec)
    out = correct_rule_errors(ordered, spec, transitions, priority)
    return out.filter(F.length(F.trim(spec.event)) > 0)


def with_insert_order(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Give inserted rows a repeatable tiebreak from their content (originals keep theirs)."""
    new = -1 - F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in (*spec.keys, spec.ts, spec.event, METHOD)]), 2)
    return df.withColumn(spec.tiebreak, F.coalesce(F.col(spec.tiebreak), new))


def reconstruct_probabilistic(df: DataFrame, spec: SeqSpec, order: int = 1, mode: str = "sample", seed: int = 42, optimize: bool = True) -> DataFrame:
    """Markov insertions into improbable gaps, then (``optimize``) likelier middle events on the filled log."""
    models = train_models(df, spec, order)
    gaps = significant_gaps(df, spec, gap_model(df, spec, median=False))
    rows = markov_fill(df, spec, models["markov"], models["probabilities"], gaps, order, mode, seed)
    out = with_insert_order(fill(df, rows), spec)
    if not optimize:
        return out
    first = models if order == 1 else train_models(df, spec, 1)
    best = optimize_sequence(index_stored(out, spec), spec, first["markov"], first["probabilities"])
    return best.withColumn(spec.event, F.col("optimized_event")).drop("optimized_event", POS, SIZE)


def reconstruct_hybrid(df: DataFrame, spec: SeqSpec, mode: str = "sample", seed: int = 42, **rules) -> DataFrame:
    """Originals, the rule rows, and the Markov rows of the log that the rules filled.

    Neither kind repeats an earlier row at (keys, ts, event).  Inserted rows have no other columns, so
    the rules and the models read those of the sequence alone.
    """
    on = [*spec.keys, spec.ts, spec.event]
    slim = df.select(*[c for c in df.columns if c in (*on, spec.tiebreak, POS, SIZE, METHOD, CONFIDENCE)])
    ruled = index_stored(reconstruct_rule_based(slim, spec, **rules), spec)
    likely = reconstruct_probabilistic(ruled, spec, mode=mode, seed=seed)
    out = as_original(df.drop(POS, SIZE))
    added = ruled.filter(F.col(METHOD) != "original").drop(POS, SIZE)
    seen = df.select(*on)
    for method, rows in (("rule_based", added), ("probabilistic", likely.filter(F.col(METHOD) == "probabilistic"))):
        before = seen.select(*[F.col(c).alias(f"_s_{c}") for c in on])
        cond = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in on]
        out = out.unionByName(rows.join(before, cond, "left_anti").withColumn(METHOD, F.lit(method)), allowMissingColumns=True)
        seen = seen.unionByName(rows.select(*on))  # rule rows left out stand among the originals
    return out


def reconstruct_events(df: DataFrame, spec: SeqSpec, method: str = "hybrid", **kwargs) -> DataFrame:
    methods = {"rule_based": reconstruct_rule_based, "probabilistic": reconstruct_probabilistic, "hybrid": reconstruct_hybrid}
    if method not in methods:
        raise ValueError(f"unknown reconstruction method: {method}")
    return methods[method](df, spec, **kwargs)


def correct_sequence_errors(df: DataFrame, spec: SeqSpec, jumps=DIRECT_JUMPS, priority: Mapping[str, int] | None = None) -> DataFrame:
    """Repair timestamps, insert intermediates for direct jumps, then spread equal timestamps."""
    repaired = repair_timestamps(df, spec).withColumn(spec.ts, F.col("repaired_ts")).drop("repaired_ts")
    filled = with_insert_order(fill(repaired, insert_direct_jumps(repaired, spec, jumps)), spec)
    out = spread_same_timestamp(filled, spec, priority)
    return out.withColumn(spec.ts, F.col("spread_ts")).drop("spread_ts")


def correct_rule_errors(df: DataFrame, spec: SeqSpec, transitions=IMPOSSIBLE_TRANSITIONS, priority=EVENT_PRIORITY) -> DataFrame:
    """Swap end-before-start neighbours, spread equal timestamps by priority, fill impossible transitions.

    A row whose time no neighbour has is neither a copy nor moved, so only the others are grouped by time.
    """
    swapped = materialise(swap_end_before_start(df, spec, shared="_shared").drop(POS, SIZE), "swapped")
    spread = spread_same_timestamp(swapped.filter("_shared").drop("_shared"), spec, priority)
    spread = spread.withColumn(spec.ts, F.col("spread_ts")).drop("spread_ts")
    ordered = index_sequence(swapped.filter("not _shared").drop("_shared").unionByName(spread), spec)
    return with_insert_order(fill(ordered, insert_impossible_transitions(ordered, spec, transitions)), spec)
