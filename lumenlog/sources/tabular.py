"""Tabular sources, column names, run log and dataset catalogue."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Target column of the known dataset types.
TARGETS = {"hdb": "resale_price", "portland": "price"}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip, lower-case and underscore the column names."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def detect_target(df: DataFrame, dataset_type: str = "generic") -> str:
    if dataset_type in TARGETS:
        return TARGETS[dataset_type]
    for c in df.columns:
        if "price" in c.lower():
            return c
    raise ValueError("no target column found")


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.ByteType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_table(df: DataFrame, dataset_type: str = "generic") -> DataFrame:
    """Drop duplicate rows, normalise names, impute medians and modes, split ``month`` for hdb data."""
    from lumenlog.operators.clean import impute_median, impute_mode
    from lumenlog.operators.tabular import split_month

    out = normalise_columns(df.dropDuplicates())
    out = impute_mode(impute_median(out, numeric_columns(out)), string_columns(out), "Unknown")
    return split_month(out) if dataset_type == "hdb" and "month" in out.columns else out


def read_table(spark: SparkSession, path: str, dataset_type: str = "generic", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return clean_table(raw, dataset_type)


def log_run(
    spark: SparkSession, path: str, name: str, parameters: Mapping[str, str], results: Mapping[str, str], notes: str = ""
) -> None:
    """Append one record to the run log."""
    schema = "name string, parameters map<string,string>, results map<string,string>, notes string"
    text = lambda m: {k: str(v) for k, v in m.items()}
    record = spark.createDataFrame([(name, text(parameters), text(results), notes)], schema)
    record.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def find_runs(log: DataFrame, name_filter: str | None = None) -> DataFrame:
    return log.filter(F.contains(F.col("name"), F.lit(name_filter))) if name_filter else log


def flatten_runs(log: DataFrame, ids: list[str], parameters: list[str], results: list[str]) -> DataFrame:
    """One ``param_*`` / ``result_*`` column per listed map key."""
    return log.select(
        *ids,
        *[F.try_element_at("parameters", F.lit(k)).alias(f"param_{k}") for k in parameters],
        *[F.try_element_at("results", F.lit(k)).alias(f"result_{k}") for k in results],
    )


def run_keys(log: DataFrame, column: str) -> DataFrame:
    """Distinct keys of a run-log map column, for ``flatten_runs``."""
    return log.select(F.explode(F.map_keys(column)).alias("key")).distinct()


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and modification time of stored files, newest first (file contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(
        F.desc("modified"), "name"
    )


def dataset_info(pixels: DataFrame, by: str = "frame_id") -> DataFrame:
    """Shape and value statistics of every stored frame."""
    v = F.col("value")
    return pixels.groupBy(by).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count("*").alias("values"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
    )
