"""Event-log sources, required-column checks and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import SeqSpec, first_per

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("duration", T.DoubleType()),
    ]
)


def read_csv_events(spark: SparkSession, path: str, schema: T.StructType | None = EVENT_SCHEMA) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json_events(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A list of records, an object holding an ``events`` list, or one record per file."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    if "events" in df.columns:
        df = df.select(F.explode("events").alias("_e")).select("_e.*")
    return df


def read_events(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return read_csv_events(spark, path, **kwargs)
    if suffix == ".json":
        return read_json_events(spark, path, **kwargs)
    if suffix in ("", ".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported event file format: {suffix}")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def drop_null_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(required))


def parse_timestamp(df: DataFrame, column: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Cast to TIMESTAMP; a bad value is an error, or NULL when ``strict`` is off."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    value = F.col(column)
    if dict(df.dtypes)[column] == "string":
        value = parse(value, F.lit(fmt)) if fmt and not strict else (parse(value, fmt) if fmt else parse(value))
    else:
        value = value.cast("timestamp")
    return df.withColumn(column, value)


def timestamp_rejects(df: DataFrame, column: str) -> DataFrame:
    """Rows whose timestamp text cannot be parsed."""
    return df.filter(F.col(column).isNotNull() & F.try_to_timestamp(F.col(column)).isNull())


def deduplicate(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Keep the first row of each (keys, timestamp, event)."""
    return first_per(df, [*spec.keys, spec.ts, spec.event], [spec.tiebreak])


def load_events(df: DataFrame, spec: SeqSpec, dedupe: bool = True) -> DataFrame:
    """Validate, clean and type a raw event table."""
    required = [spec.ts, spec.event]
    df = drop_null_required(require_columns(df, required), required)
    df = parse_timestamp(df, spec.ts)
    return deduplicate(df, spec) if dedupe else df


def write_events(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported output format: {fmt}")
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
