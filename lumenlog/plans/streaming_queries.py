"""Streaming operators over the events table, replayed as files in time order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise, shared_dir
from lumenlog.operators.aggregates import transition_matrix
from lumenlog.plans.registry import EV, GL, GLOBAL, US, USER, query
from lumenlog.plans.segment_queries import session_sql
from lumenlog.streaming import events as st
from lumenlog.streaming.ordered import OrderedStream


def _folder(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


FILES = 6
# Rows of a batch's file while the batch has several, and the fewest rows for which dealing leaves none empty.
PIECE_ROWS, FEWEST_ROWS = 100_000, 1_000


def replay(t, files: int = FILES):
    """The whole events table as a stream of ``files`` micro-batches, in order of arrival, of one or more files each.

    A row arrives up to twelve hours after its time (by a checksum of its id), so batches overlap in time: rows come out
    of order, and behind others by less than the day that the operators allow. Batches are written one after the other,
    as the source takes files by age; a large one is written, and read, by several tasks.
    """
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _FOLDERS:
        path = _folder(t, "stream")
        e = t.events().select("event_id", "user_id", "event", "ts", "value")
        arrival = F.unix_micros("ts") + F.crc32(F.col("event_id").cast("string").cast("binary")) % 43200 * 1_000_000
        e = e.withColumn("_at", arrival)
        low, high = e.agg(F.min("_at"), F.max("_at")).first()
        e = e.withColumn("_batch", F.least(F.floor((F.col("_at") - low) * files / (high - low + 1)), F.lit(files - 1)).cast("int"))
        counts = {r["_batch"]: r["count"] for r in e.groupBy("_batch").count().collect()}
        sizes = [counts.get(i, 0) for i in range(files)]
        # Every batch has the same number of files, none of them empty: the source takes so many at a time.
        pieces = max(1, min(sum(sizes) // files // PIECE_ROWS, min(sizes) // FEWEST_ROWS))
        for i in range(files):
            part = e.filter(F.col("_batch") == i).drop("_at", "_batch")
            dealt = part.coalesce(1) if pieces == 1 else part.repartition(pieces)
            dealt.write.mode("append").parquet(path)
        _FOLDERS[key] = (path, t.events().select("event_id", "user_id", "event", "ts", "value").schema, pieces)
    path, schema, pieces = _FOLDERS[key]
    return st.read_event_stream(t.spark, path, schema, pieces)


_FOLDERS: dict = {}


def _done(t, df):
    """Run a stream to its end into a table."""
    out = _folder(t, "out")
    return st.collect_stream(df, out, _folder(t, "checkpoint"), [])


@query("t1_micro_batch_source", sql=f"WITH {EV} SELECT event_id, event FROM e")
def _(t):
    return _done(t, replay(t).select("event_id", "event"))


@query("t2_collect_stream", sql=f"WITH {EV} SELECT event_id FROM e ORDER BY ts, event_id LIMIT 500")
def _(t):
    df = replay(t).select("event_id", "ts")
    return st.collect_stream(df, _folder(t, "out"), _folder(t, "checkpoint"), ["ts", "event_id"], 500).select("event_id")


@query("t3_deduplicate_stream", sql=f"WITH {EV} SELECT event_id FROM e")
def _(t):
    stream = replay(t)
    twice = stream.unionByName(stream)
    return _done(t, st.deduplicate_stream(twice, USER, "60 days").select("event_id"))


@query(
    "t4_session_statistics",
    sql=f"""WITH {session_sql(US, 'user_id')}, m AS (SELECT user_id, segment_id, event FROM k GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY user_id, segment_id ORDER BY count(*) DESC, event) = 1)
    SELECT user_id, min(ts) AS segment_start, max(ts) AS segment_end, count(*) AS event_count, count(DISTINCT k.event)::INT AS unique_events,
      (max(us) - min(us)) / 60e6 AS duration_minutes, count(*) / greatest((max(us) - min(us)) / 60e6, 1) AS events_per_minute,
      any_value(m.event) AS most_common_event
    FROM k JOIN m USING (user_id, segment_id) GROUP BY user_id, segment_id""",
    rnd=["duration_minutes", "events_per_minute"],
)
def _(t):
    """Sessions of all micro-batches, the last ones closed by a second run of the query."""
    marks, out, checkpoint = _folder(t, "marks"), _folder(t, "out"), _folder(t, "checkpoint")
    source = replay(t)
    sessions = st.session_statistics(st.with_closing(source, marks), USER, "6 hours", 3, "1 day")
    st.write_stream(sessions, out, checkpoint).awaitTermination()
    st.close_stream(source, marks)
    return st.collect_stream(sessions, out, checkpoint, [])


def _window_sql(slide, size):
    """Counts per window of ``size`` seconds that starts at a multiple of ``slide`` seconds."""
    return f"""WITH {EV} SELECT user_id, make_timestamp(w * {slide}000000) AS window_start, make_timestamp((w * {slide} + {size}) * 1000000) AS window_end,
      event, count(*) AS count FROM (SELECT *, unnest(range((us - {size}000000) // {slide}000000 + 1, us // {slide}000000 + 1)) AS w FROM e) GROUP BY ALL"""


@query("t5_window_counts", sql=_window_sql(86400, 86400))
def _(t):
    """Update mode into a keyed table: open windows are there too."""
    counts = st.window_counts(replay(t), USER, "1 day", None, "1 day")
    return st.upsert_stream(counts, ["user_id", "window_start", "window_end", "event"], _folder(t, "out"), _folder(t, "checkpoint"))


@query("t5_window_counts_sliding", sql=_window_sql(21600, 86400))
def _(t):
    counts = st.window_counts(replay(t), USER, "1 day", "6 hours", "1 day")
    return st.upsert_stream(counts, ["user_id", "window_start", "window_end", "event"], _folder(t, "out"), _folder(t, "checkpoint"))


def _ordered(t, spec, **how):
    stream = OrderedStream(replay(t), spec, _folder(t, "ordered"), "1 day", **how)
    stream.run(_folder(t, "checkpoint"))
    return stream.rows()


METADATA_SQL = "SELECT event_id, prev AS prev_event, g0 AS time_since_previous, pos AS event_sequence, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, isodow(ts) >= 6 AS is_weekend FROM s"
METADATA = ["event_id", "prev_event", "time_since_previous", "event_sequence", "hour_of_day", "day_of_week", "is_weekend"]


@query("t6_stream_metadata", sql=f"WITH {US} {METADATA_SQL}", rnd=["time_since_previous"])
def _(t):
    return _ordered(t, USER).select(*METADATA)


@query("t6_stream_metadata_global", sql=f"WITH {GL} {METADATA_SQL}", rnd=["time_since_previous"])
def _(t):
    """One sequence of all events, cut over the partitions like any other."""
    return _ordered(t, GLOBAL).select(*METADATA)


@query(
    "t7_stream_anomalies",
    sql=f"""WITH {US}, q AS (SELECT quantile_cont(gap, 0.95) AS hi, quantile_cont(gap, 0.05) AS lo FROM s), n AS (SELECT count(prev) AS t FROM s),
    m AS (SELECT prev, event, count(*) AS c FROM s WHERE prev IS NOT NULL GROUP BY 1, 2)
    SELECT event_id, coalesce(gap > hi, false) AS unusual_gap, coalesce(gap < lo, false) AS rapid_succession, coalesce(c / t::DOUBLE < 0.04, false) AS sequence_anomaly
    FROM s CROSS JOIN q CROSS JOIN n LEFT JOIN m USING (prev, event)""",
)
def _(t):
    log = t.log()
    limits, model = materialise(st.gap_thresholds(log, USER), "limits"), materialise(transition_matrix(log, USER), "model")
    flags = _ordered(t, USER, then=lambda df: st.stream_anomalies(df, USER, limits, model, 0.04))
    return flags.select("event_id", "unusual_gap", "rapid_succession", "sequence_anomaly")


@query("t8_stream_sink", sql=f"WITH {EV} SELECT event, count(*) AS n FROM e GROUP BY 1")
def _(t):
    out = _folder(t, "sink")
    st.write_stream(replay(t), out, _folder(t, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event").agg(F.count("*").alias("n"))
