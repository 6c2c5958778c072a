"""Queries for segmentation and event aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.seq import with_gap
from lumenlog.operators import aggregates as ag
from lumenlog.operators import segments as sg
from lumenlog.operators import sequence_features as sf
from lumenlog.plans.registry import EV, GL, GLOBAL, US, USER, query

TYPES = ["click", "error", "purchase", "signup", "view"]


def _time_sql(base, keys, size, step):
    part = f"PARTITION BY {keys}" if keys else ""
    on = f"USING ({keys}, k)" if keys else "USING (k)"
    sel = f"{keys}, " if keys else ""
    return f"""WITH {base}, a AS (SELECT *, us - min(us) OVER ({part}) AS d, max(us) OVER ({part}) - min(us) OVER ({part}) AS span FROM s),
    x AS (SELECT *, unnest(generate_series(greatest(0, CASE WHEN d < {size} THEN 0 ELSE floor((d - {size}) / {step}.0)::BIGINT + 1 END),
      least(d // {step}, (span - 1) // {step}))) AS k FROM a WHERE span > 0),
    i AS (SELECT {sel}k, row_number() OVER ({part} ORDER BY k) - 1 AS id FROM (SELECT DISTINCT {sel}k FROM x))
    SELECT event_id, id AS segment_id, us - d + k * {step} AS segment_start, (d - k * {step}) / 60e6 AS relative_time_in_segment FROM x JOIN i {on}"""


@query("g1_segment_by_time", sql=_time_sql(US, "user_id", 43200000000, 43200000000), rnd=["relative_time_in_segment"])
def _(t):
    return sg.segment_by_time(t.log(), USER, 720).select(
        "event_id", "segment_id", F.unix_micros("segment_start").alias("segment_start"), "relative_time_in_segment"
    )


@query("g1_segment_by_time_overlap_global", sql=_time_sql(GL, "", 3600000000, 2400000000), rnd=["relative_time_in_segment"])
def _(t):
    return sg.segment_by_time(t.log(GLOBAL), GLOBAL, 60, 20).select(
        "event_id", "segment_id", F.unix_micros("segment_start").alias("segment_start"), "relative_time_in_segment"
    )


@query(
    "g2_create_time_windows",
    sql=f"""SELECT event_id, segment_id AS window_id, segment_start AS window_start, segment_start + 43200000000 AS window_end,
    relative_time_in_segment * 60 AS window_position FROM ({_time_sql(US, "user_id", 43200000000, 21600000000)})""",
    rnd=["window_position"],
)
def _(t):
    return sg.create_time_windows(t.log(), USER, 720, 360).select(
        "event_id", "window_id", F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "window_position"
    )


@query(
    "g3_segment_by_events",
    sql=f"""WITH {US}, x AS (SELECT *, unnest(generate_series(greatest(0, ceil((pos - 20 + 1) / 15.0)::BIGINT), pos // 15)) AS k FROM s)
    SELECT event_id, k AS segment_id, k * 15 AS segment_start_index, least(k * 15 + 20, n) - 1 AS segment_end_index,
      least(k * 15 + 20, n) - k * 15 AS segment_event_count, pos - k * 15 AS relative_position_in_segment FROM x""",
)
def _(t):
    return sg.segment_by_events(t.log(), USER, 20, 5).select(
        "event_id", "segment_id", "segment_start_index", "segment_end_index", "segment_event_count", "relative_position_in_segment"
    )


@query(
    "g4_create_sliding_windows",
    sql=f"""WITH {US}, x AS (SELECT *, unnest(generate_series(greatest(0, ceil((pos - 20 + 1) / 10.0)::BIGINT), pos // 10)) AS k FROM s)
    SELECT event_id, k AS segment_id, pos - k * 10 AS relative_position_in_segment FROM x WHERE k * 10 + 20 <= n""",
)
def _(t):
    return sg.create_sliding_windows(t.log(), USER, 20, 10).select("event_id", "segment_id", "relative_position_in_segment")


def session_sql(base, part):
    p = f"PARTITION BY {part}" if part else ""
    return f"""{base}, r AS (SELECT *, sum((gap IS NULL OR gap > 21600)::INT) OVER ({p} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS raw FROM s),
    c AS (SELECT *, count(*) OVER (PARTITION BY {part + ', ' if part else ''}raw) AS sz FROM r),
    k AS (SELECT *, dense_rank() OVER ({p} ORDER BY raw) - 1 AS segment_id, row_number() OVER (PARTITION BY {part + ', ' if part else ''}raw ORDER BY pos) - 1 AS rp FROM c WHERE sz >= 3)"""


@query(
    "g5_segment_by_activity",
    sql=f"WITH {session_sql(US, 'user_id')} SELECT event_id, segment_id, rp AS relative_position_in_segment, sz AS segment_event_count FROM k",
)
def _(t):
    return sg.segment_by_activity(t.log(), USER, 360, 3).select(
        "event_id", "segment_id", "relative_position_in_segment", "segment_event_count"
    )


@query(
    "g5_segment_by_activity_global",
    sql=f"WITH {session_sql(GL, '').replace('21600', '1200')} SELECT event_id, segment_id, rp AS relative_position_in_segment, sz AS segment_event_count FROM k",
)
def _(t):
    return sg.segment_by_activity(t.log(GLOBAL), GLOBAL, 20, 3).select(
        "event_id", "segment_id", "relative_position_in_segment", "segment_event_count"
    )


@query(
    "g6_segment_by_event_types",
    sql=f"""WITH {US} SELECT event_id, (sum((event IN ('purchase', 'error') AND pos > 0)::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_id FROM s""",
)
def _(t):
    return sg.segment_by_event_types(t.log(), USER, ["Purchase", "ERROR"]).select("event_id", "segment_id")


@query("g7_adaptive_segments")
def _(t):
    out = sg.adaptive_segments(t.log(), USER, 0.5, 5, 20)
    return out.select("event_id", "user_id", "segment_id", "segment_complexity", "relative_position_in_segment")


@query(
    "g8_segment_statistics",
    sql=f"""WITH {session_sql(US, 'user_id')}, m AS (SELECT user_id, segment_id, event FROM k GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY user_id, segment_id ORDER BY count(*) DESC, event) = 1)
    SELECT user_id, segment_id, count(*) AS event_count, count(DISTINCT k.event) AS unique_events, (max(us) - min(us)) / 60e6 AS duration_minutes,
      count(*) / greatest((max(us) - min(us)) / 60e6, 1) AS events_per_minute, any_value(m.event) AS most_common_event, 'gap_based' AS segment_type
    FROM k JOIN m USING (user_id, segment_id) GROUP BY 1, 2""",
    rnd=["duration_minutes", "events_per_minute"],
)
def _(t):
    return sg.segment_statistics(sg.segment_by_activity(t.log(), USER, 360, 3), USER, segment_type="gap_based")


@query(
    "g9_features_per_segment",
    sql=f"""WITH {US}, r AS (SELECT *, sum((gap IS NULL OR gap > 21600)::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM s)
    SELECT event_id, coalesce((us - lag(us) OVER w) / 1e6, 0) AS time_since_previous, coalesce((lead(us) OVER w - us) / 1e6, 0) AS time_until_next,
      (us - min(us) OVER (PARTITION BY user_id, seg)) / 1e6 AS time_since_first FROM r WINDOW w AS (PARTITION BY user_id, seg ORDER BY pos)""",
    rnd=["time_since_previous", "time_until_next", "time_since_first"],
)
def _(t):
    from lumenlog.plans.composite import features_per_segment

    seg = sg.segment_by_activity(t.log(), USER, 360, 1)
    out = features_per_segment(seg, USER, "segment_id", sf.temporal_features)
    return out.select("event_id", "time_since_previous", "time_until_next", "time_since_first")


@query("g10_micro_batches", sql=f"WITH {GL} SELECT event_id, pos // 10 AS batch_id FROM s")
def _(t):
    return sg.micro_batches(t.log(GLOBAL), GLOBAL, 10).select("event_id", "batch_id")


@query(
    "a1_transition_matrix_by_user",
    sql=f"""WITH {US} SELECT user_id, event AS from_event, nxt AS to_event, count(*) AS n,
    count(*) / sum(count(*)) OVER (PARTITION BY user_id, event)::DOUBLE AS prob FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2, 3""",
    rnd=["prob"],
)
def _(t):
    return ag.transition_matrix(t.log(), USER)


@query(
    "a1_transition_matrix_global",
    sql=f"""WITH {GL} SELECT event AS from_event, nxt AS to_event, count(*) AS n,
    count(*) / sum(count(*)) OVER (PARTITION BY event)::DOUBLE AS prob FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2""",
    rnd=["prob"],
)
def _(t):
    return ag.transition_matrix(t.log(GLOBAL), GLOBAL)


_A2 = """m AS (SELECT lag(event, 2) OVER w || '|' || prev AS state, event AS next_event FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
  mm AS (SELECT state, next_event, count(*) AS n FROM (SELECT state, next_event FROM m WHERE state IS NOT NULL) GROUP BY ALL)"""


@query(
    "a2_markov_model_order2",
    sql=f"""WITH {US}, m AS (SELECT user_id, lag(event, 2) OVER w || '|' || prev AS state, event AS next_event FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    c AS (SELECT user_id, state, next_event, count(*) AS n FROM m WHERE state IS NOT NULL GROUP BY ALL)
    SELECT user_id, state, next_event, n, (n + 0.1) / (sum(n) OVER p + 0.1 * count(*) OVER p)::DOUBLE AS prob FROM c WINDOW p AS (PARTITION BY user_id, state)""",
    rnd=["prob"],
)
def _(t):
    return ag.markov_model(t.log(), USER, 2).withColumn("state", F.array_join("state", "|"))


@query(
    "a3_event_probabilities",
    sql=f"""WITH {EV} SELECT event, count(*) AS n, (count(*) + 0.1) / (sum(count(*)) OVER () + 0.1 * count(*) OVER ())::DOUBLE AS prob FROM e GROUP BY 1""",
    rnd=["prob"],
)
def _(t):
    return ag.event_probabilities(t.events(), GLOBAL)


_A4 = """g AS (SELECT *, (us - lag(us) OVER (PARTITION BY user_id, event ORDER BY pos)) / 1e6 AS tg FROM s)"""


@query(
    "a4_gap_model",
    sql=f"""WITH {US}, {_A4} SELECT user_id, event, count(*) AS n, CASE WHEN count(*) = 1 THEN 60 ELSE avg(tg) END AS mean,
    CASE WHEN count(*) = 1 THEN 30 ELSE stddev_samp(tg) END AS std, CASE WHEN count(*) = 1 THEN 60 ELSE quantile_cont(tg, 0.5) END AS median FROM g GROUP BY 1, 2""",
    rnd=["mean", "std", "median"],
    digits=4,
)
def _(t):
    return ag.gap_model(t.log(), USER)


@query(
    "a4_gap_model_global",
    sql=f"""WITH {GL}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY event ORDER BY pos)) / 1e6 AS tg FROM s)
    SELECT event, count(*) AS n, avg(tg) AS mean, stddev_samp(tg) AS std, quantile_cont(tg, 0.5) AS median FROM g GROUP BY 1""",
    rnd=["mean", "std", "median"],
    digits=4,
)
def _(t):
    return ag.gap_model(t.log(GLOBAL), GLOBAL)


@query(
    "a5_markov_statistics",
    sql=f"""WITH {GL}, c AS (SELECT prev AS state, event, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY ALL),
    p AS (SELECT state, (n + 0.1) / (sum(n) OVER w + 0.1 * count(*) OVER w)::DOUBLE AS prob FROM c WINDOW w AS (PARTITION BY state))
    SELECT count(DISTINCT state) AS num_states, avg(prob) AS avg_transition_probability, sum(-prob * ln(prob)) AS model_complexity,
      (SELECT count(DISTINCT event) FROM e) AS unique_events FROM p""",
    rnd=["avg_transition_probability", "model_complexity"],
)
def _(t):
    log = t.log(GLOBAL)
    return ag.markov_statistics(ag.markov_model(log, GLOBAL), ag.event_probabilities(log, GLOBAL))


@query(
    "a6_event_counts",
    sql=f"WITH {EV} SELECT event, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    rnd=["percentage"],
)
def _(t):
    return ag.event_counts(t.events(), GLOBAL, 10)


@query("a7_hourly_counts", sql="SELECT hour(ts)::INT AS hour, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return ag.calendar_counts(t.events(), GLOBAL, "hour")


@query("a7_weekday_counts", sql="SELECT (isodow(ts) - 1)::INT AS weekday, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return ag.calendar_counts(t.events(), GLOBAL, "weekday")


@query("a7_daily_counts", sql="SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS count FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def _(t):
    return ag.calendar_counts(t.events(), GLOBAL, "date").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "a8_hour_event_crosstab",
    sql="SELECT hour(ts)::INT AS hour, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS {x}" for x in TYPES) + " FROM events GROUP BY 1",
)
def _(t):
    return ag.hour_event_crosstab(t.events(), GLOBAL, TYPES)


@query(
    "a9_histogram",
    sql="""WITH st AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM events),
    b AS (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS c FROM events, st GROUP BY 1)
    SELECT bin, lo + bin * (hi - lo) / 30 AS bin_start, lo + (bin + 1) * (hi - lo) / 30 AS bin_end, c AS count, c / (n * (hi - lo) / 30) AS density,
      exp(-power((lo + (bin + 0.5) * (hi - lo) / 30 - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())) AS normal_density FROM b, st""",
    rnd=["bin_start", "bin_end", "density", "normal_density"],
)
def _(t):
    return ag.histogram(t.events(), "value", 30)


@query(
    "a10_gap_summary",
    sql=f"""WITH {GL} SELECT count(*) AS events, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap,
    count(*) / (floor((max(us) - min(us)) / 1e6 / 86400) + 1) AS events_per_day, quantile_cont(gap, 0.5) AS median_gap FROM s""",
    rnd=["mean_gap", "std_gap", "events_per_day", "median_gap"],
)
def _(t):
    return ag.gap_summary(with_gap(t.log(GLOBAL), GLOBAL), GLOBAL)


_FLAGS = "f AS (SELECT event_id, event, us, value > 100 AS high, value < 1 AS low FROM e)"


def _flagged(t):
    return t.events().withColumns({"high": F.col("value") > 100, "low": F.col("value") < 1})


@query(
    "a11_anomaly_density",
    sql=f"""WITH {EV}, {_FLAGS}, r AS (SELECT min(us) AS lo, max(us) AS hi FROM f)
    SELECT greatest(ceil((us - lo) * 10 / (hi - lo)::DOUBLE) - 1, 0)::BIGINT AS bin, count(*) AS rows, avg((high OR low)::INT) AS density FROM f, r GROUP BY 1""",
    rnd=["density"],
)
def _(t):
    return ag.anomaly_density(_flagged(t), GLOBAL, ["high", "low"])


@query(
    "a12_anomaly_by_event",
    sql=f"WITH {EV}, {_FLAGS} SELECT event, count(*) FILTER (NOT (high OR low)) AS normal, count(*) FILTER (high OR low) AS anomaly FROM f GROUP BY 1",
)
def _(t):
    return ag.anomaly_by_event(_flagged(t), GLOBAL, ["high", "low"])


@query(
    "a12_flag_summary",
    sql=f"""WITH {EV}, {_FLAGS} SELECT 'high' AS flag, count(*) FILTER (high) AS count, avg(high::INT) * 100 AS percentage FROM f
    UNION ALL SELECT 'low', count(*) FILTER (low), avg(low::INT) * 100 FROM f""",
    rnd=["percentage"],
)
def _(t):
    return ag.flag_summary(_flagged(t), ["high", "low"])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a21_feature_importance",
    sql="WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) * (max({c}) - min({c})) AS sc FROM lineitem" for c in _NUM)
    + ") SELECT feature, sc / max(sc) OVER () AS importance FROM v ORDER BY importance DESC LIMIT 3",
    rnd=["importance"],
    digits=12,
)
def _(t):
    return ag.top_features(t.table("lineitem"), _NUM, 3)


@query(
    "a22_feature_summary",
    sql="SELECT 4::BIGINT AS feature_count, 0::BIGINT AS null_count, ("
    + " + ".join(f"var_samp({c})" for c in _NUM) + ") / 4 AS mean_variance, greatest("
    + ", ".join(f"var_samp({c})" for c in _NUM) + ") AS max_variance, least("
    + ", ".join(f"var_samp({c})" for c in _NUM) + ") AS min_variance, ("
    + " + ".join(f"(max({c}) - min({c}))" for c in _NUM) + ") / 4 AS mean_range FROM lineitem",
    rnd=["mean_variance", "max_variance", "min_variance", "mean_range"],
    digits=2,
)
def _(t):
    return ag.feature_summary(t.table("lineitem"), _NUM)


@query(
    "a23_feature_matrix",
    sql="SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value ELSE 0 END AS value FROM events",
)
def _(t):
    df = t.events().withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return ag.feature_matrix(df, ["event_id"])


@query(
    "a24_price_summary",
    sql="""SELECT avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
    skewness(o_totalprice) AS skewness, kurtosis(o_totalprice) AS kurtosis, quantile_cont(o_totalprice, 0.5) AS median FROM orders""",
    rnd=["mean", "std", "min", "max", "skewness", "kurtosis", "median"],
    digits=4,
)
def _(t):
    return ag.price_summary(t.table("orders"), "o_totalprice")


@query("a25_qq_table")
def _(t):
    return ag.qq_table(t.table("orders"), "o_totalprice", "o_orderkey")


@query(
    "a27_first_events",
    sql=f"""WITH {GL} SELECT event_id, event, CASE WHEN pos % 5 = 0 THEN strftime(ts, '%H:%M:%S') ELSE '' END AS label FROM s WHERE pos < 100""",
)
def _(t):
    return ag.first_events(t.log(GLOBAL), GLOBAL).select("event_id", "event", F.coalesce("label", F.lit("")).alias("label"))
