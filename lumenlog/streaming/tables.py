"""Keyed tables that micro-batches write to: each batch adds a version, the last version of a key wins.

A version is a folder named by the batch's number and written whole, so a batch that is repeated after a failure
replaces its own version and nothing else. No file system is listed by hand: readers take a range of versions through
partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "version"


class VersionedTable:
    """Rows under ``path``, a folder per version.

    With ``keys`` a version holds at most a row per key; every ``full_every``-th one holds the last row of every key, so
    readers look no further back. ``keys=()`` is a table of one row. Without keys, versions are independent.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] | None = None, full_every: int = 16):
        self.spark, self.path, self.schema, self.full_every = spark, path, schema, full_every
        self.merged, self.keys = keys is not None, list(keys or ())
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{VERSION}=-1")

    def write(self, df: DataFrame, version: int, keep: Column | None = None) -> None:
        """Put ``df`` on top of the earlier versions; rows that fail ``keep`` are left out of full versions."""
        df = df.select(*self.schema.names)
        if self.merged and version % self.full_every == 0:
            df = self._last(self._between(self._full(version - 1), version - 1).unionByName(df.withColumn(VERSION, F.lit(version).cast("long"))))
            df = df if keep is None else df.filter(keep)
        df.write.mode("overwrite").parquet(f"{self.path}/{VERSION}={version}")

    def before(self, version: int) -> DataFrame:
        """The last row of every key in the versions before ``version``."""
        return self._last(self._between(self._full(version - 1), version - 1))

    def latest(self) -> DataFrame:
        """The last row of every key."""
        return self._last(self.all())

    def all(self) -> DataFrame:
        """The rows of all versions, with ``version``."""
        kinds = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType())])
        return self.spark.read.schema(kinds).parquet(self.path)

    def at(self, version: int) -> DataFrame:
        """The rows of one version."""
        return self.all().filter(F.col(VERSION) == version).drop(VERSION)

    def _full(self, version: int) -> int:
        return version - version % self.full_every if version >= 0 else -1

    def _between(self, first: int, last: int) -> DataFrame:
        return self.all().filter(F.col(VERSION).between(first, last))

    def _last(self, df: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        last = F.max_by(F.struct(*rest), VERSION).alias("_last")
        out = df.groupBy(*self.keys).agg(last)
        if not self.keys:
            out = out.filter("_last is not null")
        return out.select(*[F.col(c) if c in self.keys else F.col("_last")[c].alias(c) for c in self.schema.names])

