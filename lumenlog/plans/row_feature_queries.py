"""Queries for the row features of event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.seq import index_sequence
from lumenlog.operators import sequence_features as sf
from lumenlog.plans.registry import EV, GL, GLOBAL, US, USER, query

TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "w1_stream_metadata",
    sql=f"""WITH {US} SELECT event_id, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, isodow(ts) >= 6 AS is_weekend,
    pos AS event_sequence, g0 AS time_since_previous FROM s""",
    rnd=["time_since_previous"],
)
def _(t):
    return sf.stream_metadata(t.log(), USER).select(
        "event_id", "hour_of_day", "day_of_week", "is_weekend", "event_sequence", "time_since_previous"
    )


_W2 = ["time_since_previous", "time_until_next", "time_since_first", "time_until_last", "relative_time_position"]
_W2SQL = """SELECT event_id, g0 AS time_since_previous, coalesce((lead(us) OVER w - us) / 1e6, 0) AS time_until_next,
    (us - min(us) OVER p) / 1e6 AS time_since_first, (max(us) OVER p - us) / 1e6 AS time_until_last,
    coalesce((us - min(us) OVER p) / nullif(max(us) OVER p - min(us) OVER p, 0)::DOUBLE, 0) AS relative_time_position FROM s"""


@query(
    "w2_time_intervals",
    sql=f"WITH {US} {_W2SQL} WINDOW w AS (PARTITION BY user_id ORDER BY pos), p AS (PARTITION BY user_id)",
    rnd=_W2,
)
def _(t):
    return sf.temporal_features(t.log(), USER).select("event_id", *_W2)


@query("w2_time_intervals_global", sql=f"WITH {GL} {_W2SQL} WINDOW w AS (ORDER BY pos), p AS ()", rnd=_W2)
def _(t):
    return sf.temporal_features(t.log(GLOBAL), GLOBAL).select("event_id", *_W2)


def _roll(widths):
    cols = []
    for w in widths:
        f = f"OVER (PARTITION BY user_id ORDER BY pos ROWS {w - 1} PRECEDING)"
        m, s = f"avg(g0) {f}", f"stddev_samp(g0) {f}"
        cols += [
            f"CASE WHEN pos >= {w - 1} THEN {m} END AS time_gap_mean_{w}",
            f"CASE WHEN pos >= {w - 1} THEN {s} END AS time_gap_std_{w}",
            f"CASE WHEN pos >= {w - 1} THEN {s} / ({m} + 1e-6) END AS time_gap_cv_{w}",
        ]
    return ", ".join(cols)


_W3 = [f"time_gap_{k}_{w}" for w in (3, 5, 10) for k in ("mean", "std", "cv")]


@query("w3_rolling_gap_statistics", sql=f"WITH {US} SELECT event_id, {_roll((3, 5, 10))} FROM s", rnd=_W3, digits=5)
def _(t):
    return sf.rolling_gap_statistics(t.log(), USER).select("event_id", *_W3)


_W4 = [f"time_gap_percentile_{p}" for p in (25, 50, 75, 90, 95)] + ["time_gap_skewness", "time_gap_kurtosis"]
_W4SQL = ", ".join(f"quantile_cont(g0, {p / 100}) AS time_gap_percentile_{p}" for p in (25, 50, 75, 90, 95))
_SKEW = "(avg(g0**3) - 3*avg(g0)*avg(g0**2) + 2*avg(g0)**3) / var_pop(g0)**1.5 AS time_gap_skewness, kurtosis_pop(g0) AS time_gap_kurtosis"


@query(
    "w4_gap_distribution",
    sql=f"WITH {US}, k AS (SELECT user_id, {_W4SQL}, {_SKEW} FROM s GROUP BY 1) SELECT event_id, k.* EXCLUDE user_id FROM s JOIN k USING (user_id)",
    rnd=_W4,
    digits=5,
)
def _(t):
    return sf.gap_distribution(t.log(), USER).select("event_id", *_W4)


@query(
    "w4_gap_distribution_global",
    sql=f"WITH {GL}, k AS (SELECT {_W4SQL}, {_SKEW} FROM s) SELECT event_id, k.* FROM s, k",
    rnd=_W4,
    digits=5,
)
def _(t):
    return sf.gap_distribution(t.log(GLOBAL), GLOBAL).select("event_id", *_W4)


def _rate(widths):
    return ", ".join(
        f"CASE WHEN pos >= {w - 1} THEN {w}::BIGINT END AS events_count_{w}, "
        f"CASE WHEN pos >= {w - 1} THEN {w} / (sum(g0) OVER (PARTITION BY user_id ORDER BY pos ROWS {w - 1} PRECEDING) + 1e-6) END AS events_per_time_{w}"
        for w in widths
    )


_W5 = [f"events_per_time_{w}" for w in (10, 20, 40)]


@query("w5_rolling_event_rate", sql=f"WITH {US} SELECT event_id, {_rate((10, 20, 40))} FROM s", rnd=_W5 + [f"events_count_{w}" for w in (10, 20, 40)], digits=9)
def _(t):
    return sf.rolling_event_rate(t.log(), USER).select("event_id", *_W5, *[f"events_count_{w}" for w in (10, 20, 40)])


_W6N = [f"freq_{x}_10" for x in TYPES]
_W6P = [f"prop_{x}_10" for x in TYPES]
_W6SQL = ", ".join(
    f"CASE WHEN pos >= 9 THEN sum((event = '{x}')::INT) OVER w END::BIGINT AS freq_{x}_10, "
    f"CASE WHEN pos >= 9 THEN sum((event = '{x}')::INT) OVER w / 10.0 END AS prop_{x}_10"
    for x in TYPES
)


@query(
    "w6_rolling_type_frequency",
    sql=f"WITH {US} SELECT event_id, {_W6SQL} FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS 9 PRECEDING)",
    rnd=_W6P + _W6N,
)
def _(t):
    return sf.rolling_type_frequency(t.log(), USER, TYPES).select("event_id", *_W6N, *_W6P)


_W7 = [f"{k}_freq_{x}" for k in ("global", "cumulative") for x in TYPES]
_W7SQL = ", ".join(
    f"avg((event = '{x}')::INT) OVER p AS global_freq_{x}, sum((event = '{x}')::INT) OVER w / (pos + 1)::DOUBLE AS cumulative_freq_{x}"
    for x in TYPES
)


@query(
    "w7_type_frequency",
    sql=f"""WITH {US} SELECT event_id, {_W7SQL} FROM s WINDOW p AS (PARTITION BY user_id),
    w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    rnd=_W7,
)
def _(t):
    return sf.type_frequency(t.log(), USER, TYPES).select("event_id", *_W7)


@query(
    "w7_type_frequency_global",
    sql=f"WITH {GL} SELECT event_id, {_W7SQL} FROM s WINDOW p AS (), w AS (ORDER BY pos ROWS UNBOUNDED PRECEDING)",
    rnd=_W7,
)
def _(t):
    return sf.type_frequency(t.log(GLOBAL), GLOBAL, TYPES).select("event_id", *_W7)


@query(
    "w8_burst_features",
    sql=f"""WITH {US}, f AS (SELECT *, (g0 < 14400)::INT AS b FROM s),
    c AS (SELECT *, (b IS DISTINCT FROM lag(b) OVER (PARTITION BY user_id ORDER BY pos))::INT AS ch FROM f),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run,
      max(CASE WHEN b = 1 THEN us END) OVER (PARTITION BY user_id) AS lastb FROM c)
    SELECT event_id, b AS is_burst_event, run::BIGINT AS burst_length, (sum(b) OVER (PARTITION BY user_id, run))::BIGINT AS current_burst_length,
      coalesce((us - lastb) / 1e6, g0) AS time_since_last_burst FROM r""",
    rnd=["time_since_last_burst"],
)
def _(t):
    return sf.burst_features(t.log(), USER, 14400).select(
        "event_id", "is_burst_event", "burst_length", "current_burst_length", "time_since_last_burst"
    )


_W9 = ["prev_transition_prob", "next_transition_prob", "avg_transition_prob"]


@query(
    "w9_transition_features",
    sql=f"""WITH {US}, p AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY user_id, prev, event)::DOUBLE /
      count(*) OVER (PARTITION BY user_id, prev) END AS pp FROM s), q AS (SELECT *, coalesce(lead(pp) OVER (PARTITION BY user_id ORDER BY pos), 0) AS np FROM p)
    SELECT event_id, pp AS prev_transition_prob, np AS next_transition_prob, (pp + np) / 2 AS avg_transition_prob FROM q""",
    rnd=_W9,
)
def _(t):
    return sf.transition_features(t.log(), USER).select("event_id", *_W9)


@query(
    "w10_transition_history",
    sql=f"""WITH {US}, f AS (SELECT *, (prev IS NOT NULL AND row_number() OVER (PARTITION BY user_id, prev, event ORDER BY pos) = 1)::INT AS nw FROM s),
    q AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen FROM f)
    SELECT event_id, seen::BIGINT AS unique_transitions_seen, seen / (pos + 1)::DOUBLE AS transition_diversity FROM q""",
    rnd=["transition_diversity"],
)
def _(t):
    return sf.transition_history(t.log(), USER).select("event_id", "unique_transitions_seen", "transition_diversity")


@query(
    "w11_state_persistence",
    sql=f"""WITH {US}, r AS (SELECT *, max(CASE WHEN prev IS DISTINCT FROM event THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS st,
      count(*) FILTER (nxt = event) OVER (PARTITION BY user_id, event) AS stay, count(nxt) OVER (PARTITION BY user_id, event) AS outs FROM s)
    SELECT event_id, pos - st + 1 AS consecutive_count, (pos = st)::INT AS is_state_start,
      coalesce(stay / nullif(outs, 0)::DOUBLE, 0) AS state_persistence_prob FROM r""",
    rnd=["state_persistence_prob"],
)
def _(t):
    return sf.state_persistence(t.log(), USER).select("event_id", "consecutive_count", "is_state_start", "state_persistence_prob")


def _entropy_sql(w):
    over = f"OVER (PARTITION BY user_id ORDER BY pos ROWS {w - 1} PRECEDING)"
    n = f"(count(*) {over})::DOUBLE"
    terms = [f"(sum((event = '{x}')::INT) {over} / {n})" for x in TYPES]
    return " + ".join(f"(-{p} * ln({p} + 1e-10))" for p in terms)


@query(
    "w12_rolling_distinct",
    sql=f"WITH {US} SELECT event_id, "
    + ", ".join(
        f"CASE WHEN pos >= {w - 1} THEN (count(DISTINCT event) OVER (PARTITION BY user_id ORDER BY pos ROWS {w - 1} PRECEDING))::INT END AS unique_events_{w}"
        for w in (6, 3, 12)
    )
    + " FROM s",
    rnd=["unique_events_6", "unique_events_3", "unique_events_12"],
)
def _(t):
    return sf.rolling_distinct(t.log(), USER, 6).select("event_id", "unique_events_6", "unique_events_3", "unique_events_12")


_W13 = [f"window_entropy_{w}" for w in (10, 5, 20)]


@query(
    "w13_rolling_entropy",
    sql=f"WITH {US} SELECT event_id, " + ", ".join(f"{_entropy_sql(w)} AS window_entropy_{w}" for w in (10, 5, 20)) + " FROM s",
    rnd=_W13,
)
def _(t):
    return sf.rolling_entropy(t.log(), USER).select("event_id", *_W13)


@query(
    "w14_rolling_common_bigram",
    sql=f"""WITH {US}, b AS (SELECT *, prev || '->' || event AS bg FROM s),
    x AS (SELECT a.event_id, c.bg, count(*) AS n, min(c.pos) AS p FROM b a JOIN b c ON a.user_id = c.user_id AND c.pos BETWEEN a.pos - 8 AND a.pos
      AND c.bg IS NOT NULL GROUP BY 1, 2),
    y AS (SELECT event_id, bg FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, p) = 1)
    SELECT b.event_id, coalesce(y.bg, '') AS common_pattern FROM b LEFT JOIN y USING (event_id)""",
)
def _(t):
    return sf.rolling_common_bigram(t.log(), USER).select("event_id", "common_pattern")


@query(
    "w15_ngram_frequency",
    sql=f"""WITH {US}, g AS (SELECT *, CASE WHEN pos + 2 <= n THEN event || '|' || nxt END AS b2,
      CASE WHEN pos + 3 <= n THEN event || '|' || nxt || '|' || lead(event, 2) OVER (PARTITION BY user_id ORDER BY pos) END AS b3 FROM s)
    SELECT event_id, CASE WHEN b2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY user_id, b2) / (n - 1)::DOUBLE END AS "2gram_freq",
      CASE WHEN b3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY user_id, b3) / (n - 2)::DOUBLE END AS "3gram_freq" FROM g""",
    rnd=["2gram_freq", "3gram_freq"],
)
def _(t):
    return sf.ngram_frequency(t.log(), USER).select("event_id", "2gram_freq", "3gram_freq")


@query(
    "w16_run_features",
    sql=f"""WITH {US}, r AS (SELECT *, sum((prev IS DISTINCT FROM event)::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT event_id, count(*) OVER (PARTITION BY user_id, run) AS pattern_length, """
    + ", ".join(
        f"(count(DISTINCT event) OVER (PARTITION BY user_id ORDER BY pos ROWS {w - 1} PRECEDING))::INT AS pattern_complexity_{w}" for w in (5, 10, 20)
    )
    + " FROM r",
)
def _(t):
    return sf.run_features(t.log(), USER).select("event_id", "pattern_length", *[f"pattern_complexity_{w}" for w in (5, 10, 20)])


@query(
    "w17_repetition_features",
    sql=f"""WITH {US}, l AS (SELECT *, lag(pos) OVER (PARTITION BY user_id, event ORDER BY pos) AS lp,
      row_number() OVER (PARTITION BY user_id, event ORDER BY pos) AS k FROM s)
    SELECT event_id, coalesce(pos - lp, pos) AS time_since_same_event, k / (pos + 1)::DOUBLE AS repetition_rate,
      (lp IS NOT NULL)::INT AS is_repeated FROM l""",
    rnd=["repetition_rate"],
)
def _(t):
    return sf.repetition_features(t.log(), USER).select("event_id", "time_since_same_event", "repetition_rate", "is_repeated")


@query(
    "w18_statistical_features",
    sql=f"""WITH {US}, c AS (SELECT user_id, event, dense_rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC)::INT AS rk FROM s GROUP BY 1, 2),
    q AS (SELECT *, (rank() OVER (PARTITION BY user_id ORDER BY g0) + (count(*) OVER (PARTITION BY user_id, g0) - 1) / 2.0) / n AS pr,
      CASE WHEN pos >= 4 THEN 5::BIGINT END AS rc, CASE WHEN pos >= 4 THEN (count(DISTINCT event) OVER w)::INT END AS ru,
      CASE WHEN pos >= 4 THEN avg(g0) OVER w END AS rm, CASE WHEN pos >= 4 THEN stddev_samp(g0) OVER w END AS rs
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS 4 PRECEDING))
    SELECT event_id, rk AS event_frequency_rank, pr AS time_gap_percentile, rc AS rolling_event_count, ru AS rolling_unique_events,
      rm AS rolling_mean_gap, rs AS rolling_std_gap FROM q JOIN c USING (user_id, event)""",
    rnd=["time_gap_percentile", "rolling_mean_gap", "rolling_std_gap", "rolling_event_count", "rolling_unique_events"],
    digits=5,
)
def _(t):
    return sf.statistical_features(t.log(), USER).select(
        "event_id", "event_frequency_rank", "time_gap_percentile", "rolling_event_count", "rolling_unique_events", "rolling_mean_gap", "rolling_std_gap"
    )


@query(
    "w19_sequence_normalisation",
    sql=f"""WITH {US} SELECT event_id, pos AS sequence_index, coalesce(pos / nullif(n - 1, 0)::DOUBLE, 0) AS relative_position,
    row_number() OVER (PARTITION BY user_id, event ORDER BY pos) AS event_type_count,
    pos / ((us - min(us) OVER (PARTITION BY user_id)) / 1e6 / 3600 + 1e-6) AS events_per_hour FROM s""",
    rnd=["relative_position", "events_per_hour"],
)
def _(t):
    return sf.sequence_normalisation(t.log(), USER).select(
        "event_id", "sequence_index", "relative_position", "event_type_count", "events_per_hour"
    )


@query(
    "w20_missing_event_flags",
    sql=f"""WITH {US}, x AS (SELECT *, CASE prev WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS a,
      CASE event WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS b FROM s)
    SELECT event_id, g0 > 36000 AS large_gap, CASE WHEN g0 > 36000 THEN g0 ELSE 0 END AS gap_size,
      coalesce(b <> a + 1, false) AS sequence_break FROM x""",
    rnd=["gap_size"],
)
def _(t):
    return sf.missing_event_flags(t.log(), USER, 36000, [["view", "click", "purchase"]]).select(
        "event_id", "large_gap", "gap_size", "sequence_break"
    )


@query(
    "w21_pattern_violations",
    sql=f"""WITH {US}, a AS (SELECT *, least(10, n - pos - 1) AS la FROM s),
    j AS (SELECT a.event_id, bool_or(b.event = 'view' AND b.pos < a.pos + a.la) AS inner_start,
      bool_or(b.event = 'view' AND b.pos = a.pos + a.la) AS last_start, bool_or(b.event = 'purchase') AS has_end
      FROM a JOIN s b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 10 WHERE a.event = 'view' GROUP BY 1)
    SELECT s.event_id, coalesce(inner_start OR (last_start AND NOT has_end), false) AS pattern_violation FROM s LEFT JOIN j USING (event_id)""",
)
def _(t):
    return sf.pattern_violations(t.log(), USER, ["view"], ["purchase"]).select("event_id", "pattern_violation")


@query(
    "w22_repair_timestamps",
    sql=f"""WITH {EV}, h AS (SELECT event_id, epoch_ms(date_trunc('hour', ts)) AS ms, row_number() OVER (ORDER BY date_trunc('hour', ts), event_id) - 1 AS pos FROM e)
    SELECT event_id, (max(ms - pos) OVER (ORDER BY pos) + pos) AS repaired_ts FROM h""",
)
def _(t):
    hourly = t.events().withColumn("ts", F.date_trunc("hour", "ts"))
    log = t.indexed("hourly", hourly, GLOBAL)
    return sf.repair_timestamps(log, GLOBAL).select("event_id", F.unix_millis("repaired_ts").alias("repaired_ts"))


@query(
    "w23_spread_same_timestamp",
    sql=f"""WITH {EV}, h AS (SELECT *, epoch_us(date_trunc('hour', ts)) AS hus FROM e
      QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts), event ORDER BY event_id) = 1)
    SELECT event_id, hus + 1000 * (row_number() OVER (PARTITION BY user_id, hus ORDER BY CASE event WHEN 'error' THEN 1 ELSE 5 END, event_id) - 1) AS spread_ts FROM h""",
)
def _(t):
    hourly = t.events().withColumn("ts", F.date_trunc("hour", "ts"))
    out = sf.spread_same_timestamp(hourly, USER, {"error": 1})
    return out.select("event_id", F.unix_micros("spread_ts").alias("spread_ts"))


@query(
    "w24_swap_end_before_start",
    sql=f"""WITH {US}, q AS (SELECT event_id, CASE WHEN event = 'purchase' AND nxt = 'view' THEN nxt WHEN prev = 'purchase' AND event = 'view' THEN prev ELSE event END AS event,
      CASE WHEN event = 'purchase' AND nxt = 'view' THEN lead(value) OVER w WHEN prev = 'purchase' AND event = 'view' THEN lag(value) OVER w ELSE value END AS value
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)) SELECT * FROM q""",
)
def _(t):
    return sf.swap_end_before_start(t.log(), USER, ["view"], ["purchase"]).select("event_id", "event", "value")


_PEAK = """p AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r, avg(value) OVER u + 2 * stddev_pop(value) OVER u AS lim FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY pos), u AS (PARTITION BY user_id))"""


@query(
    "w25_local_maxima",
    sql=f"WITH {US}, {_PEAK} SELECT event_id, value FROM p WHERE value > l AND value > r AND value > lim",
)
def _(t):
    return sf.local_maxima(t.log(), USER, "value").select("event_id", "value")


@query(
    "x1_extract_all_features",
    sql=f"""WITH {US} SELECT event_id, g0 AS time_since_previous, {_entropy_sql(10)} AS window_entropy_10, hour(ts)::INT AS hour,
    CASE WHEN prev IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY user_id, prev, event)::DOUBLE / count(*) OVER (PARTITION BY user_id, prev) END AS prev_transition_prob FROM s""",
    rnd=["time_since_previous", "window_entropy_10", "prev_transition_prob"],
)
def _(t):
    from lumenlog.plans.composite import extract_all_features

    out = extract_all_features(t.log(), USER, F.lit("2024-02-01").cast("timestamp"), TYPES)
    return out.select("event_id", "time_since_previous", "window_entropy_10", "hour", "prev_transition_prob")
