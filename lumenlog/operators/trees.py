"""Tree ensembles fitted on sums per cell.

Trees of MLlib split at bins of the features (32 at most), so rows that lie in the same bins of all features, a cell, are
never told apart. Where the possible cells are few, a forest and boosted trees of the same form follow from sums per cell:
one pass over the rows in place of one for each level or round, and trees are grown on cells.

* random forest: each tree draws a Poisson number of copies of each row, and keeps number and label sum per cell;
* gradient boosting on squared errors: a round's residuals have the sums of labels less predictions per cell.

Bins end at the middles between values where a feature has few, else at quantiles from a sketch of all fitted rows (MLlib
takes them from 10,000 rows).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.stats import SKETCH_ACCURACY

# MLlib's number of bins and seed; sums per cell are kept for so many possible cells at most.
MAX_BINS, SEED, MOST_CELLS = 32, 42, 1 << 16
# Fixed value: rows that share one set of sums, which is passed on for each tree.
CHUNK_ROWS = 1 << 20

PARAMS = {
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3, "min_samples_leaf": 1, "learning_rate": 0.1},
}


class Cells:
    """The grid of bins between ``edges`` of each feature."""

    def __init__(self, edges: Sequence[np.ndarray]):
        self.edges, self.sizes = list(edges), [len(e) + 1 for e in edges]
        self.count = int(np.prod(self.sizes, dtype=float))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each line; a value on an edge lies below it."""
        code = np.zeros(len(x), np.int64)
        for i, (edge, size) in enumerate(zip(self.edges, self.sizes)):
            code = code * size + np.searchsorted(edge, x[:, i], "left")
        return code

    def bins(self) -> np.ndarray:
        """The bin of each feature (lines) and cell (columns)."""
        return np.array(np.unravel_index(np.arange(self.count), self.sizes))


def grow(bins: np.ndarray, sizes: Sequence[int], w: np.ndarray, s: np.ndarray, depth: int, least: int) -> np.ndarray:
    """The value that a regression tree on cells of ``w`` rows with label sum ``s`` gives each cell."""
    value = np.full(len(w), s.sum() / w.sum())
    some = w > 0
    tiny = 1e-12 * (s[some] ** 2 / w[some]).sum()
    live, at, nodes = np.arange(len(w)), np.zeros(len(w), np.int64), 1
    for _ in range(depth):
        best, feature, split = np.full(nodes, tiny), np.full(nodes, -1), np.zeros(nodes, np.int64)
        for i, size in enumerate(sizes):
            place = at * size + bins[i][live]
            sums = (np.bincount(place, x[live], nodes * size).reshape(nodes, size).cumsum(axis=1) for x in (w, s))
            (lw, tw), (ls, ts) = ((x[:, :-1], x[:, -1:]) for x in sums)
            rw, rs = tw - lw, ts - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((lw >= least) & (rw >= least), ls * ls / lw + rs * rs / rw - ts * ts / tw, -np.inf)
            if size > 1:
                k = gain.argmax(axis=1)
                gain = gain[np.arange(nodes), k]
                more = gain > best
                best, feature, split = np.where(more, gain, best), np.where(more, i, feature), np.where(more, k, split)
        on = feature[at] >= 0
        live, at = live[on], at[on]
        if not len(live):
            break
        side = bins[feature[at], live] > split[at]
        kept, at = np.unique(2 * at + side, return_inverse=True)
        nodes = len(kept)
        value[live] = (np.bincount(at, s[live], nodes) / np.bincount(at, w[live], nodes))[at]
    return value


def boosted(cells: Cells, w: np.ndarray, s: np.ndarray, n_estimators: int, max_depth: int, min_samples_leaf: int, learning_rate: float) -> np.ndarray:
    """A first tree on the labels, the others on twice the residuals, like MLlib's for squared errors."""
    tree = partial(grow, cells.bins(), cells.sizes, w, depth=max_depth, least=min_samples_leaf)
    value = tree(s=s)
    for _ in range(1, n_estimators):
        value = value + learning_rate * tree(s=2 * (s - w * value))
    return value


def _chunks(batches: Iterator[pa.RecordBatch], cells: Cells, mean: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and centred labels of up to about ``CHUNK_ROWS`` rows."""
    codes, labels, rows = [], [], 0
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(cells.sizes))
        codes.append(cells.of(x))
        labels.append(batch.column("y").to_numpy() - mean)
        rows += len(x)
        if rows >= CHUNK_ROWS:
            yield np.concatenate(codes), np.concatenate(labels)
            codes, labels, rows = [], [], 0
    if rows:
        yield np.concatenate(codes), np.concatenate(labels)


def _sums(rows: DataFrame, cells: Cells, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Number and label sum of the rows of each cell."""

    def run(batches):
        for code, y in _chunks(batches, cells, mean):
            n, s = np.bincount(code, minlength=cells.count), np.bincount(code, y, cells.count)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at])], ["cell", "n", "s"])

    w, s = np.zeros(cells.count), np.zeros(cells.count)
    # At most MOST_CELLS rows.
    for r in rows.mapInArrow(run, "cell long, n long, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        w[r["cell"]], s[r["cell"]] = r["n"], r["s"]
    return w, s


def _forest(rows: DataFrame, cells: Cells, mean: float, n_estimators: int, max_depth: int, min_samples_leaf: int) -> np.ndarray:
    """The mean of the trees, each grown where its sums meet."""

    def draw(batches):
        part = TaskContext.get().partitionId()
        for at, (code, y) in enumerate(_chunks(batches, cells, mean)):
            rng = np.random.default_rng([SEED, part, at])
            for tree in range(n_estimators):
                copies = rng.poisson(1.0, len(code)).astype(float)
                w = np.bincount(code, copies, cells.count).astype(np.uint32)
                s = np.bincount(code, copies * y, cells.count)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([w.tobytes()]), pa.array([s.tobytes()])], ["tree", "w", "s"])

    def tree_of(batches):
        w, s = np.zeros(cells.count), np.zeros(cells.count)
        for batch in batches:
            for a, b in zip(batch.column("w"), batch.column("s")):
                w += np.frombuffer(a.as_buffer(), np.uint32)
                s += np.frombuffer(b.as_buffer(), float)
        # A tree that drew no row at all says nothing: it gives the mean.
        value = grow(cells.bins(), cells.sizes, w, s, max_depth, min_samples_leaf) if w.any() else np.zeros(cells.count)
        yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()])], ["value"])

    def added(batches):
        total = np.zeros(cells.count)
        for batch in batches:
            for a in batch.column("value"):
                total += np.frombuffer(a.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["value"])

    trees = rows.mapInArrow(draw, "tree long, w binary, s binary").groupBy("tree").applyInArrow(_whole(tree_of), "value binary")
    # A row for each task that grew trees.
    sums = [np.frombuffer(r["value"], float) for r in trees.mapInArrow(added, "value binary").collect()]
    return np.sum(sums, axis=0) / n_estimators


def _whole(f):
    """``f`` over batches as a function of one group's table."""
    return lambda table: pa.Table.from_batches(list(f(table.to_batches())))


class CellModel:
    """A value for each cell."""

    def __init__(self, cells: Cells, values: np.ndarray, features: str, prediction: str):
        self.cells, self.values, self.features, self.prediction = cells, values, features, prediction

    def transform(self, df: DataFrame) -> DataFrame:
        cells, values = self.cells, self.values

        def look(x: pa.Array) -> pa.Array:
            return pa.array(values[cells.of(x.flatten().to_numpy().reshape(-1, len(cells.sizes)))])

        return df.withColumn(self.prediction, F.arrow_udf(look, "double")(vector_to_array(self.features)))


def edges_of(rows: DataFrame, quantiles: Sequence[Sequence[float]], few: Sequence[bool]) -> list[np.ndarray]:
    """The ends of the bins of each feature of rows (x, y); ``few``: whether it may have few values."""
    edges = [np.unique(np.array(q, float)) for q in quantiles]
    for i in map(int, np.flatnonzero(few)):
        values = np.array(sorted(r["v"] for r in rows.select(F.col("x")[i].alias("v")).distinct().collect()))
        if len(values) <= MAX_BINS:
            edges[i] = (values[1:] + values[:-1]) / 2
    return edges


def fit(name: str, data: DataFrame, deal, features: str, label: str, prediction: str, **params) -> CellModel | None:
    """The model fitted on an assembled table, or None where that takes whole rows: other parameters, no or odd labels, or
    too many possible cells. ``deal(data, rows)`` spreads the rows over tasks."""
    if name not in PARAMS or params.keys() - PARAMS[name].keys():
        return None
    rows = data.select(vector_to_array(features).alias("x"), F.col(label).alias("y"))
    first = rows.first()
    width = len(first["x"]) if first else 0
    if not width:
        return None
    odd = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))
    ranks = [k / MAX_BINS for k in range(1, MAX_BINS)]
    stats = rows.agg(
        F.count("*").alias("n"), F.count_if(odd).alias("odd"), F.avg("y").alias("mean"),
        *[F.approx_count_distinct(F.col("x")[i]).alias(f"d{i}") for i in range(width)],
        *[F.percentile_approx(F.col("x")[i], ranks, SKETCH_ACCURACY).alias(f"q{i}") for i in range(width)],
    ).first()
    if stats["odd"]:
        return None
    few = [stats[f"d{i}"] <= 2 * MAX_BINS for i in range(width)]
    # A feature of many values has about as many bins as there may be.
    if sum(not x for x in few) * np.log2(MAX_BINS) > np.log2(MOST_CELLS):
        return None
    cells = Cells(edges_of(rows, [stats[f"q{i}"] for i in range(width)], few))
    if cells.count > MOST_CELLS:
        return None
    dealt = deal(data, stats["n"]).select(vector_to_array(features).alias("x"), F.col(label).alias("y"))
    how = PARAMS[name] | params
    if name == "random_forest":
        values = _forest(dealt, cells, stats["mean"], **how)
    else:
        values = boosted(cells, *_sums(dealt, cells, stats["mean"]), **how)
    return CellModel(cells, values + stats["mean"], features, prediction)
