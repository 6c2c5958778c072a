"""Structured Streaming forms of the event operators.

The column expressions are those of the batch operators, so a replayed file gives the batch answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import SeqSpec
from lumenlog.streaming.tables import VersionedTable


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1, fmt: str = "parquet", ts: str = "ts") -> DataFrame:
    """Micro-batches of a growing folder of event files."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is available now and stop."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Checkpointed parquet sink; returns the running query."""
    return df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def collect_stream(df: DataFrame, path: str, checkpoint: str, order: Sequence[str], max_events: int | None = None) -> DataFrame:
    """Append the stream to a table and read it back, the first ``max_events`` in order if given."""
    write_stream(df, path, checkpoint).awaitTermination()
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.orderBy(*order).limit(max_events) if max_events is not None else table


def deduplicate_stream(df: DataFrame, spec: SeqSpec, late: str = "1 hour") -> DataFrame:
    """Drop repeats of (keys, ts, event) that arrive within the watermark."""
    return df.withWatermark(spec.ts, late).dropDuplicatesWithinWatermark([*spec.keys, spec.ts, spec.event])


def with_closing(df: DataFrame, folder: str) -> DataFrame:
    """``df`` with a second source: the mark that ``close_stream`` puts into ``folder`` at the end of the stream."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("ignore").parquet(folder)
    return df.unionByName(df.sparkSession.readStream.schema(df.schema).parquet(folder))


def close_stream(df: DataFrame, folder: str, ts: str = "ts", at: str = "9998-12-31") -> None:
    """End a stream made by ``with_closing``: a row of nulls so late that every window is behind it.

    The next run of the query, from its checkpoint, gives the rows of all windows that were open. Rows that come after
    are late.
    """
    mark = df.sparkSession.range(1).select(*[F.lit(at if f.name == ts else None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    mark.write.mode("append").parquet(folder)


def session_statistics(df: DataFrame, spec: SeqSpec, gap: str = "30 minutes", min_events: int = 5, late: str = "1 hour") -> DataFrame:
    """Statistics of closed sessions with at least ``min_events`` rows; the most common event is the smallest on ties.

    A session closes when the watermark is a gap past its last row; ``with_closing`` and ``close_stream`` close the
    last ones. Rows later than the watermark are dropped.
    """
    window = F.session_window(spec.ts, gap)
    first, last = F.min(spec.ts), F.max(spec.ts)
    minutes = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(60e6)
    out = df.withWatermark(spec.ts, late).groupBy(*spec.keys, window).agg(
        F.count("*").alias("event_count"), F.size(F.collect_set(spec.event)).alias("unique_events"), first.alias("segment_start"),
        last.alias("segment_end"), minutes.alias("duration_minutes"), F.mode(spec.event, True).alias("most_common_event"),
    )
    out = out.filter(F.col("event_count") >= min_events).drop("session_window")
    return out.withColumn("events_per_minute", F.col("event_count") / F.greatest("duration_minutes", F.lit(1.0)))


def window_counts(df: DataFrame, spec: SeqSpec, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Event counts per tumbling or sliding window and type; rows later than the watermark are dropped.

    In append mode a window's rows come once, when it is closed; in update mode every batch gives the rows that it
    changed, for ``upsert_stream``.
    """
    window = F.window(spec.ts, size, slide) if slide else F.window(spec.ts, size)
    out = df.withWatermark(spec.ts, late).groupBy(*spec.keys, window, spec.event).agg(F.count("*").alias("count"))
    return out.select(*spec.keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), spec.event, "count")


def upsert_stream(df: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Run an aggregation in update mode into a keyed table and read it: the last version of each key, open or closed."""
    table = VersionedTable(df.sparkSession, path, df.schema, keys)
    run_available(df, checkpoint, table.write, "update")
    return table.latest()


def gap_thresholds(log: DataFrame, spec: SeqSpec, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """One row of gap limits trained on a stored log, over all its sequences."""
    from lumenlog.functions.seq import with_gap
    from lumenlog.functions.stats import exact_percentiles

    return exact_percentiles(with_gap(log, spec), [], "gap", {"gap_high": high, "gap_low": low})


def stream_anomalies(metadata: DataFrame, spec: SeqSpec, thresholds: DataFrame, transitions: DataFrame, share: float = 0.01) -> DataFrame:
    """Long-gap, rapid and rare-transition flags on rows with the metadata of ``OrderedStream``.

    ``thresholds`` is one row; ``transitions`` (from_event, to_event, n) has one row per pair of types.
    """
    total = transitions.agg(F.sum("n").alias("_t")).scalar()
    model = transitions.groupBy(F.col("from_event").alias("prev_event"), F.col("to_event").alias(spec.event)).agg(F.sum("n").alias("_n"))
    limits = thresholds.select(F.struct("gap_high", "gap_low")).scalar()
    out = metadata.join(model, ["prev_event", spec.event], "left")
    has = F.col("prev_event").isNotNull()
    rare = F.coalesce(F.col("_n"), F.lit(0)) / total < share
    return out.withColumns(
        {
            "unusual_gap": has & (F.col("time_since_previous") > limits["gap_high"]),
            "rapid_succession": has & (F.col("time_since_previous") < limits["gap_low"]),
            "sequence_anomaly": has & rare,
        }
    ).drop("_n")
