"""Linear models of many folds, candidates and training sizes from one aggregate.

Least squares with squared and absolute penalties depends on the rows only through their number, means and
co-moments. These merge: an aggregate gives them for each cell (a fold, or a fold and a slice of the training sizes),
and every training set is a sum of cells, every validation error of squares a form in its cell's moments. The driver
holds ``cells * features^2`` numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINEAR_MODELS = ("linear", "ridge", "lasso", "elastic_net")


@dataclass(frozen=True)
class Moments:
    """Number of rows, means, and sums of products of deviations of the features and, last, the label."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def together(parts: Iterable[Moments]) -> Moments:
        parts = list(parts)
        n = sum(p.n for p in parts)
        mean = sum((p.mean * p.n for p in parts), np.zeros_like(parts[0].mean)) / max(n, 1)
        products = np.zeros_like(parts[0].products)
        for p in parts:
            off = p.mean - mean
            products = products + p.products + p.n * np.outer(off, off)
        return Moments(n, mean, products)

    def squared_error(self, intercept: float, slopes: np.ndarray) -> float:
        """Mean squared error of a linear prediction over these rows."""
        w = np.append(-slopes, 1.0)
        return max(float(w @ self.products @ w), 0.0) / self.n + float(self.mean @ w - intercept) ** 2


def moments_by(data: DataFrame, width: int, by: Sequence[str], features: str = "features", label: str = "label") -> dict[tuple, Moments]:
    """Moments of an assembled table for each combination of ``by``, in one scan."""
    x = vector_to_array(features)
    names = [f"_x{i}" for i in range(width)] + ["_y"]
    rows = data.select(*by, *[x[i].alias(f"_x{i}") for i in range(width)], F.col(label).cast("double").alias("_y"))
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    aggs = [F.avg(c).alias(f"m{c}") for c in names] + [F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy(*by).agg(F.count("*").alias("n"), *aggs).collect():
        products = np.zeros((width + 1, width + 1))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[tuple(r[c] for c in by)] = Moments(r["n"], np.array([r[f"m{c}"] for c in names]), products)
    return out


def penalties(name: str, n: int, **params) -> tuple[float, float]:
    """(absolute, squared) penalty of a named model beside half its mean squared error."""
    alpha = params.get("alpha", 1.0)
    if name == "linear":
        return 0.0, 0.0
    if name == "ridge":
        return 0.0, alpha / n
    share = 1.0 if name == "lasso" else params.get("l1_ratio", 0.5)
    return alpha * share, alpha * (1 - share)


def solve(m: Moments, name: str, **params) -> tuple[float, np.ndarray]:
    """(intercept, slopes) that minimise the model's objective over the rows of ``m``.

    Without an absolute penalty by the normal equations (least norm if they are singular), with it by ``shrunken``.
    """
    if name not in LINEAR_MODELS:
        raise ValueError(f"not a linear model: {name}")
    if not m.n:
        raise ValueError("no rows to fit")
    l1, l2 = penalties(name, m.n, **params)
    deviation = np.sqrt(np.diag(m.products) / m.n)
    scale = deviation[:-1]
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    unit = m.products[:-1, :-1] / m.n * np.outer(inverse, inverse)  # features of deviation 1, or 0
    target = m.products[:-1, -1] / m.n * inverse
    squared = np.diag(l2 * inverse**2)
    slopes = shrunken(unit + squared, target, l1 * inverse, deviation[-1]) if l1 else np.linalg.lstsq(unit + squared, target, rcond=1e-13)[0]
    slopes = slopes * inverse
    return float(m.mean[-1] - m.mean[:-1] @ slopes), slopes


def shrunken(c: np.ndarray, target: np.ndarray, l1: np.ndarray, size: float) -> np.ndarray:
    """Minimum of ``w c w / 2 - target w + sum(l1 |w|)``.

    A sweep of coordinate descent proposes which slopes are not zero and their signs; their equations are solved
    exactly. It is the minimum if the signs agree and no other slope is pulled harder than its penalty. Otherwise, and
    at the latest when a sweep moves no slope by more than 1e-12 of ``size``, the descent goes on or ends.
    """
    w = np.zeros(len(c))
    free = np.flatnonzero(np.diag(c) > 0)
    moved = np.inf
    while moved > 1e-12 * size:
        moved = 0.0
        for j in free:
            pull = target[j] - c[j] @ w + c[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / c[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        on = np.flatnonzero(w)
        exact = np.zeros(len(c))
        exact[on] = np.linalg.lstsq(c[np.ix_(on, on)], target[on] - l1[on] * np.sign(w[on]), rcond=1e-13)[0]
        pull = np.abs(target - c @ exact)
        if (np.sign(exact[on]) == np.sign(w[on])).all() and (pull[free] <= l1[free] + 1e-10 * size).all():
            return exact
    return w


def predicted(intercept: Column, slopes: Column, features: str = "features") -> Column:
    """A linear prediction from an array column of slopes."""
    terms = F.zip_with(vector_to_array(features), slopes, lambda a, b: a * b)
    return F.aggregate(terms, intercept, lambda s, v: s + v)


def fold_fits(cells: dict[tuple, Moments], name: str, folds: int, **params) -> list[tuple[int, Moments | None, tuple | None, str | None]]:
    """(fold, validation moments or None, fit on the other folds or None, error or None) for every fold."""
    out = []
    for k in range(folds):
        held = cells.get((k,))
        rest = [m for (f,), m in cells.items() if f != k]
        try:
            if not rest:
                raise ValueError("no rows to fit")
            out.append((k, held, solve(Moments.together(rest), name, **params), None))
        except Exception as exc:  # noqa: BLE001 - a failing fit is recorded, not raised
            out.append((k, held, None, str(exc)[:200]))
    return out
