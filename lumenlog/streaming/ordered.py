"""Events of a stream in the order of their time, with what each sequence carries from batch to batch.

Micro-batches bring rows in any order. A row waits in a stored table until the watermark (the latest time seen, less
the allowed lateness) has passed it. What a batch releases is ordered by (ts, tiebreak) and comes after everything
released before, so the batch operators work on it: positions come from ``index_sequence``, which cuts a hot key over
many partitions, and only the first row of a key looks up the key's carried row (last time, last event, count).

Waiting rows, carried rows and results are versions of stored tables named by the batch. A batch that is repeated after
a failure reads the same earlier versions and replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.calendar import weekend_business_flags
from lumenlog.functions.seq import POS, SIZE, SeqSpec, attach, index_sequence, over_rows, running, seconds
from lumenlog.functions.storage import materialise
from lumenlog.streaming.tables import VERSION, VersionedTable


def interval_micros(spark, text: str) -> int:
    """Microseconds of an interval such as ``1 hour``."""
    seconds_of = f"unix_micros(timestamp'1970-01-01 00:00:00' + interval '{text}') - unix_micros(timestamp'1970-01-01 00:00:00')"
    return spark.range(1).select(F.expr(seconds_of)).first()[0]


class OrderedStream:
    """Stream metadata of every released row: previous event, gap and running number in its sequence, calendar flags.

    ``then`` maps released rows with their metadata to the rows that are stored, e.g. anomaly flags. A sequence that was
    silent for longer than ``idle`` starts anew, and its carried row is forgotten when the watermark is that far ahead.

    Defined cases: a row older than the watermark that earlier batches reached is late, as is one without a time; late
    rows are kept apart (``late``) and take no part. Rows equal in (keys, ts, tiebreak) have either order. Null keys make
    a sequence of their own; ``keys=()`` is one sequence.
    """

    def __init__(self, source: DataFrame, spec: SeqSpec, folder: str, late: str = "1 hour", idle: str | None = None, then: Callable[[DataFrame], DataFrame] | None = None):
        spark = source.sparkSession
        self.source, self.spec, self.then = source, spec, then or (lambda df: df)
        self.late_by, self.idle_by = interval_micros(spark, late), None if idle is None else interval_micros(spark, idle)
        table = lambda name, schema, keys=None: VersionedTable(spark, f"{folder}/{name}", schema, keys)
        self.waiting, self.late = table("waiting", source.schema), table("late", source.schema)
        self.clock = table("clock", T.StructType([T.StructField("watermark", T.LongType())]))
        carried = [T.StructField("last_ts", T.TimestampType()), T.StructField("last_event", T.StringType()), T.StructField("events_before", T.LongType())]
        self.carried = table("carried", T.StructType([*[source.schema[k] for k in spec.keys], *carried]), spec.keys)
        nothing = self._metadata(spark.createDataFrame([], source.schema), 0).drop(POS, SIZE)
        self.result = table("result", self.then(nothing).schema)

    def _metadata(self, rows: DataFrame, batch: int) -> DataFrame:
        """``rows``, all of them behind what earlier batches released, with their metadata, position and length."""
        spec, ts, first = self.spec, F.col(self.spec.ts), F.col(POS) == 0
        log = attach(index_sequence(rows, spec), self.carried.before(batch), spec)
        log = over_rows(log, spec, lambda s: {"_ts": F.lag(s.ts).over(s.window), "_event": F.lag(s.event).over(s.window)})
        log = log.withColumns({"_ts": F.when(first, F.col("last_ts")).otherwise(F.col("_ts")), "_event": F.when(first, F.col("last_event")).otherwise(F.col("_event"))})
        silent = F.unix_micros(ts) - F.unix_micros("_ts") > self.idle_by if self.idle_by is not None else F.lit(False)
        log = log.withColumn("_anew", F.coalesce(silent, F.lit(False)))
        log = running(log, spec, {"_since": ("max", F.when(F.col("_anew"), F.col(POS)))})
        number = F.coalesce(F.col(POS) - F.col("_since"), F.col(POS) + F.coalesce("events_before", F.lit(0)))
        added = {
            "prev_event": F.when(~F.col("_anew"), F.col("_event")),
            "time_since_previous": F.coalesce(F.when(~F.col("_anew"), seconds(ts, F.col("_ts"))), F.lit(0.0)),
            "event_sequence": number,
            "hour_of_day": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "is_weekend": weekend_business_flags(ts)["is_weekend"] == 1,
        }
        return log.withColumns(added).drop("last_ts", "last_event", "events_before", "_ts", "_event", "_anew", "_since")

    def process(self, batch_rows: DataFrame, batch: int) -> None:
        """What ``foreachBatch`` calls."""
        spec, ts = self.spec, F.unix_micros(self.spec.ts)
        new = materialise(batch_rows, "batch")
        earlier = self.clock.at(batch - 1).first()
        passed = earlier.watermark if earlier else None
        newest = new.agg(F.max(ts)).first()[0]
        reached = max([x for x in (passed, None if newest is None else newest - self.late_by) if x is not None], default=None)
        old = F.col(spec.ts).isNull() | (F.lit(False) if passed is None else ts < passed)
        rows = self.waiting.at(batch - 1).unionByName(new.filter(~old))
        due = F.lit(False) if reached is None else ts < reached
        out = materialise(self._metadata(rows.filter(due), batch), "released")
        last = out.filter(F.col(POS) == F.col(SIZE) - 1)
        last = last.select(*spec.keys, F.col(spec.ts).alias("last_ts"), F.col(spec.event).alias("last_event"), (F.col("event_sequence") + 1).alias("events_before"))
        fresh = None if self.idle_by is None or reached is None else F.unix_micros("last_ts") >= reached - self.idle_by
        self.late.write(new.filter(old), batch)
        self.result.write(self.then(out.drop(POS, SIZE)), batch)
        self.carried.write(last, batch, fresh)
        self.waiting.write(rows.filter(~due), batch)
        self.clock.write(self.clock.spark.createDataFrame([(reached,)], self.clock.schema), batch)

    def run(self, checkpoint: str) -> None:
        """Process what is available now and stop."""
        query = self.source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process).trigger(availableNow=True).start()
        query.awaitTermination()

    def rows(self, complete: bool = True) -> DataFrame:
        """Stored results; ``complete`` adds those of the rows that still wait, as if the stream ended here.

        Nothing is written for these, so the stream may go on.
        """
        released = self.result.all().drop(VERSION)
        if not complete:
            return released
        last = self.clock.all().agg(F.max(VERSION)).first()[0]
        return released.unionByName(self.then(self._metadata(self.waiting.at(last), last + 1).drop(POS, SIZE)))
