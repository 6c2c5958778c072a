"""Frames as pixel tables ``(frame_id, y, x, value)``: sources, sinks and packing."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise

PIXEL_SCHEMA = "frame_id string, y int, x int, value double"


def unpack(df: DataFrame, frame_id: str, data: str, width: int, keep: list[str] | None = None) -> DataFrame:
    """One row per pixel from a flat row-major array column."""
    out = df.select(F.col(frame_id).alias("frame_id"), *(keep or []), F.posexplode(data).alias("_i", "value"))
    return out.select(
        "frame_id", *(keep or []), F.expr(f"_i div {width}").cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"),
        F.col("value").cast("double").alias("value"),
    )


def pack(pixels: DataFrame) -> DataFrame:
    """Frame rows with a flat row-major array: one frame is one row, so frames must fit in memory."""
    items = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    return pixels.groupBy("frame_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.transform(items, lambda p: p["value"]).alias("data")
    )


def _pixels(name: str, array: np.ndarray) -> Iterator[pd.DataFrame]:
    stack = array.reshape((-1, *array.shape[-2:])) if array.ndim > 2 else array.reshape((1, *np.atleast_2d(array).shape))
    for i, frame in enumerate(stack):
        y, x = np.indices(frame.shape)
        frame_id = name if len(stack) == 1 else f"{name}#{i}"
        yield pd.DataFrame({"frame_id": frame_id, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "value": frame.ravel().astype("float64")})


def read_array_frames(spark: SparkSession, path: str, suffix: str = "*.np[yz]") -> DataFrame:
    """Pixels of ``.npy`` and ``.npz`` files (array ``data``, else the first); pickled content is refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(loaded, np.ndarray):
                    loaded = loaded["data"] if "data" in loaded.files else loaded[loaded.files[0]]
                yield from _pixels(name.rsplit("/", 1)[-1], loaded)

    return files.mapInPandas(decode, PIXEL_SCHEMA)


def _csv_rows(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(frame_id, y, cells) of CSV matrices; large files are split by byte ranges.

    A row's number is its place in its range of bytes, behind the rows of the file's earlier ranges. Blank lines do not
    count, nor does the first line with ``header``.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), name.alias("frame_id"), "value")
    lines = materialise(lines.filter(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id()), "lines")
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.select("_file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") - int(header)).alias("_shift"))
    rows = lines.join(ranges, ["_file", "_block"]).withColumn("y", (F.col("_id") + F.col("_shift")).cast("int")).filter("y >= 0")
    return rows.select("frame_id", "y", F.transform(F.split("value", ","), lambda c: F.trim(c)).alias("cells"), "value")


def _sound(width: int | None) -> Column:
    numbers = F.forall("cells", lambda c: (c == "") | c.try_cast("double").isNotNull())
    return numbers if width is None else numbers & (F.size("cells") == width)


def read_csv_frames(spark: SparkSession, path: str, width: int | None = None, header: bool = False) -> DataFrame:
    """Pixels of CSV matrices, one file per frame; an empty cell is a pixel without a value.

    ``header`` skips the first line of each file. Rows that hold something else than numbers, or not ``width`` of them
    where it is given, are left to ``rejected_csv_rows``.
    """
    rows = _csv_rows(spark, path, header).filter(_sound(width))
    cells = rows.select("frame_id", "y", F.posexplode("cells").alias("x", "_v"))
    return cells.select("frame_id", "y", "x", F.col("_v").try_cast("double").alias("value"))


def rejected_csv_rows(spark: SparkSession, path: str, width: int | None = None, header: bool = False) -> DataFrame:
    """(frame_id, y, line) of the rows that ``read_csv_frames`` does not take."""
    return _csv_rows(spark, path, header).filter(~_sound(width)).select("frame_id", "y", F.col("value").alias("line"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``*_metadata.json`` files beside frames as (frame_id, metadata map)."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*_metadata.json").text(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "_metadata.json$", "")
    return files.select(name.alias("frame_id"), F.from_json("value", "map<string,string>").alias("metadata"))


def _images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").load(path).select("image.*").withColumn("frame_id", F.element_at(F.split("origin", "/"), -1))


def read_image_frames(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files of the formats that the Java runtime reads (PNG, JPEG, BMP, TIFF), channels averaged.

    Grey TIFF levels pass the runtime's colour space and may differ from the file's. Files that cannot be decoded are left to ``rejected_images``.
    """
    images = _images(spark, path).filter("nChannels > 0").select("frame_id", "height", "width", "nChannels", "data")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                raw = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                yield from _pixels(r.frame_id, raw.astype("float64").mean(axis=2))

    return images.mapInPandas(decode, PIXEL_SCHEMA)


def rejected_images(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, origin) of files under ``path`` that are no image of a known format."""
    return _images(spark, path).filter("nChannels <= 0").select("frame_id", "origin")


def write_frames(pixels: DataFrame, path: str, dataset: str, run: str, metadata: dict[str, str] | None = None) -> None:
    """Pixels partitioned by dataset and run, with the metadata as a side table."""
    out = pixels.withColumns({"dataset": F.lit(dataset), "run_ts": F.lit(run)})
    out.write.mode("append").partitionBy("dataset", "run_ts").parquet(f"{path}/pixels")
    spark = pixels.sparkSession
    row = spark.createDataFrame([(dataset, run, {k: str(v) for k, v in (metadata or {}).items()})], "dataset string, run_ts string, metadata map<string,string>")
    row.write.mode("append").parquet(f"{path}/metadata")


def read_frames(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return spark.read.parquet(f"{path}/pixels").filter(F.col("dataset") == dataset)


def to_bytes(pixels: DataFrame) -> DataFrame:
    """0-255 rescale of each frame, truncated, as used for image export."""
    ends = pixels.groupBy("frame_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    out = pixels.join(ends, "frame_id")
    scaled = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255
    return out.withColumn("byte", F.coalesce(F.floor(scaled), F.lit(0)).cast("int")).drop("_lo", "_hi")
