"""Queries for event sources, cleaning and calendar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions import calendar as cal
from lumenlog.functions.seq import SeqSpec, index_sequence
from lumenlog.operators import clean
from lumenlog.plans.registry import EV, GL, US, USER, GLOBAL, Tables, query
from lumenlog.sources import events as src

EVENT_ID = SeqSpec(keys=("user_id",), tiebreak="event_id")


def us(name: str):
    return F.unix_micros(name).alias(name)


def dirty(t: Tables):
    """Events with NULL values, NULL types and repeated rows derived from the given table."""
    e = t.events()
    e = e.withColumns(
        {
            "value": F.when(F.col("event_id") % 7 != 0, F.col("value")),
            "event": F.when(F.col("event_id") % 11 != 0, F.col("event")),
        }
    )
    again = e.filter(F.col("value") > 50).withColumn("event_id", F.col("event_id") + 100000000)
    return e.unionByName(again)


DIRTY = """d0 AS (SELECT event_id, user_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event, ts,
    CASE WHEN event_id % 7 <> 0 THEN value END AS value, props, epoch_us(ts) AS us FROM events),
  d AS (SELECT * FROM d0 UNION ALL SELECT * REPLACE (event_id + 100000000 AS event_id) FROM d0 WHERE value > 50)"""


@query("s3_required_columns", sql=f"WITH {EV} SELECT event_id, us AS ts FROM e")
def _(t):
    return src.require_columns(t.events(), ["ts", "event"]).select("event_id", us("ts"))


@query("s4_drop_null_required", sql=f"WITH {DIRTY} SELECT event_id, event, value FROM d WHERE event IS NOT NULL AND value IS NOT NULL")
def _(t):
    return src.drop_null_required(dirty(t), ["event", "value"]).select("event_id", "event", "value")


@query(
    "s5_parse_timestamp",
    sql="""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE epoch_us(date_trunc('second', ts)) END AS ts FROM events""",
)
def _(t):
    text = F.when(F.col("event_id") % 13 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = t.events().withColumn("ts", text)
    out = src.parse_timestamp(df, "ts", strict=False)
    return out.select("event_id", F.coalesce(F.unix_micros("ts"), F.lit(-1)).alias("ts"))


@query(
    "s5_timestamp_rejects",
    sql="SELECT event_id FROM events WHERE event_id % 13 = 0",
)
def _(t):
    text = F.when(F.col("event_id") % 13 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return src.timestamp_rejects(t.events().withColumn("ts", text), "ts").select("event_id")


@query(
    "s6_deduplicate",
    sql=f"""WITH {DIRTY} SELECT event_id, user_id, us AS ts, event, value FROM d
    QUALIFY row_number() OVER (PARTITION BY user_id, ts, event ORDER BY event_id) = 1""",
)
def _(t):
    return src.deduplicate(dirty(t), USER).select("event_id", "user_id", us("ts"), "event", "value")


@query(
    "s1_load_events",
    sql=f"""WITH {DIRTY} SELECT event_id, us AS ts, event FROM d WHERE event IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id, ts, event ORDER BY event_id) = 1""",
)
def _(t):
    return src.load_events(dirty(t), USER).select("event_id", us("ts"), "event")


@query(
    "s2_json_payload",
    sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    parsed = F.from_json("props", "k BIGINT")
    return t.events().select("event_id", parsed["k"].alias("k"))


@query(
    "c1_clean_data",
    sql=f"""WITH {DIRTY}, dd AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, ts, event ORDER BY event_id) = 1),
    v AS (SELECT * FROM dd WHERE ts <= TIMESTAMP '2024-01-25' AND ts >= TIMESTAMP '2024-01-25' - INTERVAL 3650 DAYS
      QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
    m AS (SELECT quantile_cont(value, 0.5) AS med FROM v),
    c AS (SELECT event, count(*) AS c FROM v WHERE event IS NOT NULL GROUP BY 1 ORDER BY c DESC, event LIMIT 1),
    i AS (SELECT event_id, user_id, ts, us, coalesce(v.value, m.med) AS value, coalesce(v.event, c.event) AS event FROM v, m, c),
    g AS (SELECT *, coalesce((us - lag(us) OVER w) / 1e6 < 60, false) AS rapid FROM i WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, coalesce(lag(rapid) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS prapid FROM g)
    SELECT event_id, event, value FROM r WHERE NOT (rapid AND prapid)""",
    rnd=["value"],
)
def _(t):
    now = F.lit("2024-01-25").cast("timestamp")
    out = clean.clean_data(dirty(t), USER, now, ["value"], ["event"], min_interval=60)
    return out.select("event_id", "event", "value")


@query("c2_drop_future", sql="SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'")
def _(t):
    return clean.drop_future(t.events(), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id")


@query("c3_drop_too_old", sql="SELECT event_id FROM events WHERE ts >= TIMESTAMP '2034-01-10' - INTERVAL 3650 DAYS")
def _(t):
    return clean.drop_too_old(t.events(), "ts", F.lit("2034-01-10").cast("timestamp")).select("event_id")


@query(
    "c4_one_event_per_timestamp",
    sql="""SELECT user_id, epoch_us(date_trunc('hour', ts)) AS ts, min(event_id) AS event_id FROM events GROUP BY 1, 2""",
)
def _(t):
    df = t.events().withColumn("ts", F.date_trunc("hour", "ts"))
    return clean.one_event_per_timestamp(df, USER).select("user_id", us("ts"), "event_id")


@query(
    "c5_impute_median",
    sql=f"WITH {DIRTY}, m AS (SELECT quantile_cont(value, 0.5) AS med FROM d) SELECT event_id, coalesce(value, med) AS value FROM d, m",
    rnd=["value"],
)
def _(t):
    return clean.impute_median(dirty(t), ["value"]).select("event_id", "value")


@query(
    "c6_impute_mode",
    sql=f"""WITH {DIRTY}, m AS (SELECT event AS mode FROM d WHERE event IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT event_id, coalesce(event, mode, 'unknown') AS event FROM d, m""",
)
def _(t):
    return clean.impute_mode(dirty(t), ["event"]).select("event_id", "event")


@query(
    "c7_filter_noise",
    sql=f"""WITH {US}, r AS (SELECT *, coalesce(gap < 1800, false) AS rapid FROM s),
    q AS (SELECT *, coalesce(lag(rapid) OVER (PARTITION BY user_id ORDER BY pos), false) AS prapid FROM r)
    SELECT event_id FROM q WHERE NOT (rapid AND prapid)""",
)
def _(t):
    return clean.filter_noise(t.log(), USER, 1800).select("event_id")


@query(
    "c8_standardize_events",
    sql="""SELECT event_id, CASE event_type WHEN 'view' THEN 'begin' WHEN 'error' THEN 'error' WHEN 'click' THEN 'end'
    WHEN 'purchase' THEN 'complete' ELSE event_type END AS event FROM events""",
)
def _(t):
    raw = {"view": " Start ", "error": "ERR", "click": "stop", "purchase": "Done"}
    pairs = [F.lit(x) for kv in raw.items() for x in kv]
    df = t.events().withColumn("event", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event")), F.col("event")))
    return clean.standardize_events(df, USER).select("event_id", "event")


@query(
    "c9_validate_preprocessing",
    sql=f"""WITH {DIRTY}, p AS (SELECT * FROM d WHERE value IS NOT NULL)
    SELECT o.*, q.*, original_count - processed_count AS removed_count,
      (original_count - processed_count) * 100.0 / original_count AS removed_percent FROM
    (SELECT count(*) AS original_count, epoch_us(min(ts)) AS original_start, epoch_us(max(ts)) AS original_end,
       count(DISTINCT event) AS original_event_types FROM d) o,
    (SELECT count(*) AS processed_count, epoch_us(min(ts)) AS processed_start, epoch_us(max(ts)) AS processed_end,
       count(DISTINCT event) AS processed_event_types FROM p) q""",
    rnd=["removed_percent"],
)
def _(t):
    d = dirty(t)
    out = clean.validate_preprocessing(d, d.filter(F.col("value").isNotNull()), USER)
    return out.withColumns({c: F.unix_micros(c) for c in out.columns if c.endswith(("_start", "_end"))})


@query(
    "c17_quality_score",
    sql=f"""WITH {DIRTY}, q AS (SELECT event_id, user_id, event, ts, value, props FROM d),
    b AS (SELECT count(*) AS rows, sum((event IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT + (ts IS NULL)::INT
        + (user_id IS NULL)::INT + (event_id IS NULL)::INT) AS miss, count(DISTINCT event) AS event_types FROM q),
    u AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM q)),
    o AS (SELECT coalesce(bool_or(back), false) AS unordered FROM (SELECT lag(ts) OVER (ORDER BY event_id) > ts AS back FROM q))
    SELECT rows, miss / (rows * 6.0) AS missing_ratio, (rows - d) / rows::DOUBLE AS duplicate_ratio, unordered, event_types,
      1 - 0.3 * miss / (rows * 6.0) - 0.2 * (rows - d) / rows::DOUBLE - CASE WHEN unordered THEN 0.2 ELSE 0 END AS quality_score
    FROM b, u, o""",
    rnd=["missing_ratio", "duplicate_ratio", "quality_score"],
)
def _(t):
    return clean.quality_score(dirty(t), GLOBAL)


@query(
    "c19_drop_empty_events",
    sql="SELECT event_id FROM events WHERE event_type NOT IN ('view', 'error')",
)
def _(t):
    blank = F.when(F.col("event") == "view", "  ").when(F.col("event") == "error", None).otherwise(F.col("event"))
    return clean.drop_empty_events(t.events().withColumn("event", blank), USER).select("event_id")


@query(
    "x9_stage_quality",
    sql=f"""WITH {DIRTY}, st AS (SELECT 'raw' AS stage, event_id, user_id, event, ts, value, props FROM d
      UNION ALL SELECT 'cleaned', event_id, user_id, event, ts, value, props FROM d WHERE event IS NOT NULL AND value IS NOT NULL),
    b AS (SELECT stage, count(*) AS rows, sum((event IS NULL)::INT + (value IS NULL)::INT) AS miss FROM st GROUP BY 1),
    o AS (SELECT stage, coalesce(bool_or(back), false) AS unordered FROM
      (SELECT stage, lag(ts) OVER (PARTITION BY stage ORDER BY event_id) > ts AS back FROM st) GROUP BY 1),
    q AS (SELECT stage, 1 - 0.3 * miss / (rows * 6.0) - CASE WHEN unordered THEN 0.2 ELSE 0 END AS quality_score FROM b JOIN o USING (stage))
    SELECT stage, quality_score, quality_score - (SELECT quality_score FROM q WHERE stage = 'raw') AS quality_change FROM q""",
    rnd=["quality_score", "quality_change"],
)
def _(t):
    d = dirty(t)
    stages = {"raw": d, "cleaned": src.drop_null_required(d, ["event", "value"])}
    return clean.stage_quality(stages, GLOBAL).select("stage", "quality_score", "quality_change")


@query(
    "f1_calendar_parts",
    sql="""SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month,
    quarter(ts) AS quarter, weekofyear(ts) AS week_of_year FROM events""",
)
def _(t):
    parts = cal.calendar_parts(F.col("ts"))
    return t.events().select("event_id", *[c.cast("long").alias(n) for n, c in parts.items()])


@query(
    "f2_weekend_business_flags",
    sql="""SELECT event_id, (isodow(ts) >= 6)::INT AS is_weekend, (hour(ts) BETWEEN 9 AND 17)::INT AS is_business_hour FROM events""",
)
def _(t):
    return t.events().withColumns(cal.weekend_business_flags(F.col("ts"))).select("event_id", "is_weekend", "is_business_hour")


@query(
    "f3_time_of_day",
    sql="""SELECT event_id, CASE WHEN hour(ts) <= 6 THEN 'night' WHEN hour(ts) <= 12 THEN 'morning'
    WHEN hour(ts) <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day FROM events""",
)
def _(t):
    return t.events().select("event_id", cal.time_of_day(F.col("ts")).alias("time_of_day"))


_CYC = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]


@query(
    "f4_cyclical",
    sql="""SELECT event_id, sin(2*pi()*hour(ts)/24) AS hour_sin, cos(2*pi()*hour(ts)/24) AS hour_cos,
    sin(2*pi()*(isodow(ts)-1)/7) AS day_sin, cos(2*pi()*(isodow(ts)-1)/7) AS day_cos,
    sin(2*pi()*month(ts)/12) AS month_sin, cos(2*pi()*month(ts)/12) AS month_cos FROM events""",
    rnd=_CYC,
)
def _(t):
    return t.events().withColumns(cal.cyclical(F.col("ts"))).select("event_id", *_CYC)


_CTX = ["time_since_midnight", "time_since_week_start", "time_since_month_start", "event_age"]


@query(
    "f5_temporal_context",
    sql="""SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 AS time_since_midnight,
    (epoch_us(ts) - epoch_us(date_trunc('week', ts)::TIMESTAMP)) / 1e6 AS time_since_week_start,
    (epoch_us(ts) - epoch_us(date_trunc('month', ts)::TIMESTAMP)) / 1e6 AS time_since_month_start,
    (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 AS event_age FROM events""",
    rnd=_CTX,
)
def _(t):
    now = F.lit("2024-02-01").cast("timestamp")
    return t.events().withColumns(cal.temporal_context(F.col("ts"), now)).select("event_id", *_CTX)


@query(
    "f6_normalize_timestamps",
    sql=f"""WITH {US}, m AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS d FROM s)
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_normalized, d AS seconds_since_first, d / 60 AS minutes_since_first,
    d / 3600 AS hours_since_first, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds_of_day, dayofyear(ts)::INT AS day_of_year FROM m""",
    rnd=["seconds_since_first", "minutes_since_first", "hours_since_first"],
)
def _(t):
    return cal.normalize_timestamps(t.log(), USER).select(
        "event_id", "timestamp_normalized", "seconds_since_first", "minutes_since_first", "hours_since_first", "seconds_of_day", "day_of_year"
    )


@query(
    "x10_normalization_stats",
    sql=f"""WITH {EV} SELECT epoch_us(min(ts)) AS original_start, epoch_us(max(ts)) AS original_end, (max(us) - min(us)) / 1e6 AS original_duration,
    count(DISTINCT event) AS original_events, epoch_us(min(date_trunc('minute', ts))) AS normalized_start,
    epoch_us(max(date_trunc('minute', ts))) AS normalized_end,
    (max(epoch_us(date_trunc('minute', ts))) - min(epoch_us(date_trunc('minute', ts)))) / 1e6 AS normalized_duration,
    count(DISTINCT upper(event)) AS normalized_events FROM e""",
    rnd=["original_duration", "normalized_duration"],
)
def _(t):
    from lumenlog.operators.encode import normalization_stats

    norm = t.events().withColumns({"ts": F.date_trunc("minute", "ts"), "event": F.upper("event")})
    out = normalization_stats(t.events(), norm, USER)
    return out.withColumns({c: F.unix_micros(c) for c in out.columns if c.endswith(("_start", "_end"))})
