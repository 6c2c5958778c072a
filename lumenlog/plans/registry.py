"""Query registry: each entry pairs a Spark plan with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.seq import SeqSpec, index_sequence
from lumenlog.functions.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_INDEXED: dict[tuple, DataFrame] = {}

USER = SeqSpec(keys=("user_id",))
GLOBAL = SeqSpec(keys=())


class Tables:
    """The given tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        df = self.table("events").withColumnRenamed("event_type", "event")
        return df.withColumn("ts", F.col("ts").cast("timestamp"))

    def indexed(self, name: str, df: DataFrame, spec: SeqSpec) -> DataFrame:
        """Index a log once per session; every later query reads the stored index."""
        key = (self.spark.sparkContext.applicationId, self.dir, name, spec)
        if key not in _INDEXED:
            _INDEXED[key] = index_sequence(df, spec)
        return _INDEXED[key]

    def log(self, spec: SeqSpec = USER) -> DataFrame:
        return self.indexed("events", self.events(), spec)


def query(name: str, sql: str | None = None, rnd: Sequence[str] = (), digits: int = 6):
    """Register ``fn(tables)``; columns in ``rnd`` are rounded the same way on both sides.

    A small fixed shift keeps exact decimal ties (microsecond values) off the rounding boundary.
    """
    nudge = float(f"1.370137e-{digits + 2}")

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(spark, sf_dir))
            fixed = {c: F.round(F.col(c).cast("double") + F.lit(nudge), digits) + F.lit(0.0) for c in rnd}
            return out.withColumns(fixed) if rnd else out

        QUERIES[name] = run
        if sql is not None:
            if rnd:
                fixes = ", ".join(f'round("{c}"::DOUBLE + {nudge!r}::DOUBLE, {digits}) + 0.0 AS "{c}"' for c in rnd)
                ORACLES[name] = f"SELECT * REPLACE ({fixes}) FROM ({sql})"
            else:
                ORACLES[name] = sql
        return fn

    return wrap


# SQL building blocks shared by the oracle queries.
EV = "e AS (SELECT event_id, user_id, event_type AS event, ts, value, props, epoch_us(ts) AS us FROM events)"
SEQ_COLS = """*, row_number() OVER w - 1 AS pos, count(*) OVER p AS n,
  (us - lag(us) OVER w) / 1e6 AS gap, coalesce((us - lag(us) OVER w) / 1e6, 0) AS g0,
  lag(event) OVER w AS prev, lead(event) OVER w AS nxt"""
US = f"""{EV}, s AS (SELECT {SEQ_COLS} FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id))"""
GL = f"""{EV}, s AS (SELECT {SEQ_COLS} FROM e WINDOW w AS (ORDER BY ts, event_id), p AS ())"""
