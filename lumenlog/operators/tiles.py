"""Frames in tiles: a row holds a tile's pixels with a border of its neighbours, so windows need no row per neighbour.

A pixel goes to its own tile and, near an edge, to the up to three tiles whose border it is in; that is the only
shuffle. A tile has at most ``(size + 2 radius)^2`` pixels whatever the frame. Several tiles of an Arrow batch are
worked on as one array. Missing pixels (no row, or a null or NaN value) are NaN there; they get no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 128
CELLS = 1 << 21  # array cells that are worked on at a time


def tiles(pixels: DataFrame, height: int, width: int, radius: int, values: Sequence[str] = ("value",), keys: Sequence[str] = ("frame_id",), size: int = TILE) -> DataFrame:
    """(keys, _ty, _tx, _px): a row per tile with the (y, x, values) of its pixels and border."""
    spots = []
    for axis, end in (("y", height), ("x", width)):
        c = F.col(axis)
        first, last = F.greatest(F.floor((c - radius) / size), F.lit(0)), F.least(F.floor((c + radius) / size), F.lit((end - 1) // size))
        outside = F.raise_error(F.lit(f"pixel outside the frame's {axis}")).cast("array<int>")
        spots.append(F.when((c >= 0) & (c < end), F.sequence(first.cast("int"), last.cast("int"))).otherwise(outside))
    cell = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(v) for v in values])
    spread = pixels.select(*keys, cell.alias("_cell"), spots[0].alias("_y"), spots[1].alias("_x"))
    spread = spread.select(*keys, "_cell", F.explode("_y").alias("_ty"), "_x").select(*keys, "_cell", "_ty", F.explode("_x").alias("_tx"))
    return spread.groupBy(*keys, "_ty", "_tx").agg(F.collect_list("_cell").alias("_px"))


def mirrored(at: np.ndarray, end: int) -> np.ndarray:
    """Positions folded back into a frame at its edges, the edge pixel repeated."""
    at = np.mod(at, 2 * end)
    return np.minimum(at, 2 * end - 1 - at)


class Stack:
    """The tiles of a slice as arrays (tile, row, column) with their borders."""

    def __init__(self, batch: pa.RecordBatch, height: int, width: int, radius: int, values: Sequence[str], size: int, mirror: bool):
        self.radius, self.frame, self.shape = radius, (height, width), (min(size, height), min(size, width))
        self.top = batch.column("_ty").to_numpy().astype(np.int64) * size
        self.left = batch.column("_tx").to_numpy().astype(np.int64) * size
        lists = batch.column("_px")
        cells = lists.flatten()
        tile = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        y = cells.field("y").to_numpy() - self.top[tile] + radius
        x = cells.field("x").to_numpy() - self.left[tile] + radius
        full = (batch.num_rows, self.shape[0] + 2 * radius, self.shape[1] + 2 * radius)
        self.values = {}
        for v in values:
            a = np.full(full, np.nan)
            a[tile, y, x] = cells.field(v).to_numpy(zero_copy_only=False)
            self.values[v] = self._folded(a, height, width) if mirror else a

    def _folded(self, a: np.ndarray, height: int, width: int) -> np.ndarray:
        for axis, (first, end) in enumerate(((self.top, height), (self.left, width)), 1):
            at = first[:, None] - self.radius + np.arange(a.shape[axis])
            at = np.clip(mirrored(at, end) - first[:, None] + self.radius, 0, a.shape[axis] - 1)
            a = np.take_along_axis(a, at[:, :, None] if axis == 1 else at[:, None, :], axis)
        return a

    def present(self, a: np.ndarray) -> np.ndarray:
        """Which pixels of the tiles themselves are in the frame and not missing."""
        r, (h, w) = self.radius, self.shape
        y, x = self.top[:, None] + np.arange(h) < self.frame[0], self.left[:, None] + np.arange(w) < self.frame[1]
        return ~np.isnan(a[:, r : r + h, r : r + w]) & y[:, :, None] & x[:, None, :]


def slices_of(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // cells)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def filtered(pixels: DataFrame, height: int, width: int, radius: int, fn: Callable[..., np.ndarray], mirror: bool = True, work: int = 1, size: int = TILE, extra: DataFrame | None = None) -> DataFrame:
    """(frame_id, y, x, value): ``fn(stack array)`` at every present pixel.

    ``fn`` maps the array with borders to one without. ``work`` says how many numbers it holds for each cell. A table
    ``extra`` (frame_id, and one number per frame) is given to it as second argument, a number per tile.
    """
    tiled = tiles(pixels, height, width, radius, size=size)
    name = None
    if extra is not None:
        name = next(c for c in extra.columns if c != "frame_id")
        tiled = tiled.join(extra, "frame_id")
    area = (min(size, height) + 2 * radius) * (min(size, width) + 2 * radius) * work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, area):
            stack = Stack(batch, height, width, radius, ["value"], size, mirror)
            given = stack.values["value"]
            args = () if name is None else (batch.column(name).to_numpy(zero_copy_only=False)[:, None, None],)
            out = fn(given, *args)
            tile, y, x = np.nonzero(stack.present(given))
            yield pa.RecordBatch.from_arrays(
                [batch.column("frame_id").take(pa.array(tile)), pa.array((y + stack.top[tile]).astype(np.int32)), pa.array((x + stack.left[tile]).astype(np.int32)), pa.array(out[tile, y, x], from_pandas=True)],
                ["frame_id", "y", "x", "value"],
            )

    return tiled.mapInArrow(run, f"frame_id {pixels.schema['frame_id'].dataType.simpleString()}, y int, x int, value double")


def along(a: np.ndarray, taps: Sequence[float]) -> np.ndarray:
    """A kernel along the rows, then along the columns, on whole windows only."""
    for axis in (1, 2):
        n = a.shape[axis] - len(taps) + 1
        a = sum(w * np.take(a, range(i, i + n), axis) for i, w in enumerate(taps))
    return a


def weighted_mean(a: np.ndarray, taps: Sequence[float]) -> np.ndarray:
    """Separable weighted mean of the present pixels of each window."""
    there = ~np.isnan(a)
    total = along(np.where(there, a, 0.0), taps)
    if there.all():
        return total / sum(taps) ** 2
    weight = along(there.astype(float), taps)
    return np.divide(total, weight, out=np.full_like(total, np.nan), where=weight > 0)


def windows(a: np.ndarray, size: int) -> np.ndarray:
    """The pixels of each square window as a last axis."""
    view = np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(1, 2))
    return view.reshape(*view.shape[:3], -1)


def median_of(a: np.ndarray, size: int) -> np.ndarray:
    """Median of the present pixels of each window."""
    values = np.sort(windows(a, size), axis=-1)  # NaN last
    n = size * size - np.isnan(values).sum(axis=-1)
    at = lambda i: np.take_along_axis(values, np.clip(i, 0, None)[..., None], -1)[..., 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def laplacian_of(a: np.ndarray) -> np.ndarray:
    """Five-point Laplacian; a missing neighbour counts as equal to the pixel."""
    c = a[:, 1:-1, 1:-1]
    sides = (a[:, :-2, 1:-1], a[:, 2:, 1:-1], a[:, 1:-1, :-2], a[:, 1:-1, 2:])
    return sum(np.where(np.isnan(s), c, s) for s in sides) - 4 * c


def wiener_of(a: np.ndarray, size: int, noise: np.ndarray) -> np.ndarray:
    """Adaptive Wiener filter; pixels outside the frame or missing count as zero in the local moments."""
    r, filled = size // 2, np.nan_to_num(a, nan=0.0)
    mean = along(filled, [1.0] * size) / size**2
    var = along(filled * filled, [1.0] * size) / size**2 - mean * mean
    c = a[:, r : a.shape[1] - r, r : a.shape[2] - r]
    kept = mean + (c - mean) * (1 - np.divide(noise, var, out=np.ones_like(var), where=var != 0))
    return np.where((var < noise) | (var == 0), mean, kept)


def bilateral_of(a: np.ndarray, radius: int, sigma_spatial: float, sigma_intensity: float) -> np.ndarray:
    """Mean of the present pixels by nearness in place and value."""
    h, w = a.shape[1] - 2 * radius, a.shape[2] - 2 * radius
    c = a[:, radius : radius + h, radius : radius + w]
    total, weight = np.zeros_like(c), np.zeros_like(c)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            v = a[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]
            g = np.exp(-(dy * dy + dx * dx) / (2 * sigma_spatial**2)) * np.exp(-((v - c) ** 2) / (2 * sigma_intensity**2))
            total += np.nan_to_num(g * v, nan=0.0)
            weight += np.nan_to_num(g, nan=0.0)
    return np.divide(total, weight, out=np.full_like(c, np.nan), where=weight > 0)


def similarity(pairs: DataFrame, height: int, width: int, by: Sequence[str], window: int, size: int = TILE) -> DataFrame:
    """(by, total, windows): structural similarities of the full windows of each tile, added up.

    A window counts if it lies in the frame and has all its pixels; it belongs to the tile of its centre.
    """
    keys = list(dict.fromkeys([*by, "frame_id"]))
    radius = window // 2
    tiled = tiles(pairs, height, width, radius, ("r", "t"), keys, size)
    span = pairs.groupBy(*by).agg((F.max("r") - F.min("r")).cast("double").alias("_range"))
    tiled = tiled.join(span, list(by))
    area = (min(size, height) + 2 * radius) * (min(size, width) + 2 * radius) * 8
    n = float(window * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, area):
            stack = Stack(batch, height, width, radius, ["r", "t"], size, False)
            x, y = stack.values["r"], stack.values["t"]
            mean = lambda a: along(a, [1.0] * window) / n
            mx, my, unbiased = mean(x), mean(y), n / (n - 1)
            vx, vy, vxy = unbiased * (mean(x * x) - mx * mx), unbiased * (mean(y * y) - my * my), unbiased * (mean(x * y) - mx * my)
            span = batch.column("_range").to_numpy(zero_copy_only=False)[:, None, None]
            c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
            below = (mx * mx + my * my + c1) * (vx + vy + c2)
            there = ~np.isnan(below) & (below != 0)
            s = np.divide((2 * mx * my + c1) * (2 * vxy + c2), below, out=np.zeros_like(below), where=there)
            full = np.arange(stack.shape[0]) + stack.top[:, None], np.arange(stack.shape[1]) + stack.left[:, None]
            there &= ((full[0] >= radius) & (full[0] < height - radius))[:, :, None] & ((full[1] >= radius) & (full[1] < width - radius))[:, None, :]
            totals = [pa.array(np.where(there, s, 0.0).sum(axis=(1, 2))), pa.array(there.sum(axis=(1, 2)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in by], *totals], [*by, "total", "windows"])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in by)
    return tiled.mapInArrow(run, f"{kinds}, total double, windows long")
