"""What several text operators share: the word rule, durable tables and global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise

# A word is a run of characters other than these ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Number of words of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Global row number from 0 in ``order`` without bringing the rows into one task.

    Rows are dealt by range and numbered inside their range; the earlier ranges' row counts are added. ``order``
    must be total, or equal rows get their numbers in either order.
    """
    part = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = part.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, inside + F.col("_before") - 1).drop("_part", "_before")
