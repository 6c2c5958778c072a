"""Calibration curves and distributions fitted per channel ``(channel_id, x, y)``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.pvalue import correlation_p_value
from lumenlog.functions.seq import attach_row
from lumenlog.functions.stats import ratio
from lumenlog.operators.models import normality

CHANNEL = ["channel_id"]


def linear_summary(points: DataFrame) -> DataFrame:
    """Slope, intercept, r2, p, standard error and percentage errors of the line, per channel."""
    x, y = F.col("x"), F.col("y")
    fit = points.groupBy(*CHANNEL).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"),
        F.regr_count("y", "x").alias("n"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"), F.regr_sxy("y", "x").alias("_sxy"),
    )
    left = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    se = F.sqrt(F.try_divide(F.greatest(left, F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx")))
    r = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))
    fit = fit.withColumns({"standard_error": se, "p_value": correlation_p_value(r, F.col("n"))}).drop("_sxx", "_syy", "_sxy")
    line = F.col("slope") * x + F.col("intercept")
    percent = F.abs(F.try_divide(y - line, line)) * 100
    rows = points.join(fit.select(*CHANNEL, "slope", "intercept"), CHANNEL).withColumn("_p", percent)
    errors = rows.groupBy(*CHANNEL).agg(
        F.max("_p").alias("max_linearity_error"), F.avg("_p").alias("mean_linearity_error"), F.sqrt(F.avg(F.col("_p") * F.col("_p"))).alias("rms_linearity_error")
    )
    return fit.join(errors, CHANNEL)


def polynomial_fit(points: DataFrame, degree: int = 2) -> DataFrame:
    """Least-squares coefficients per channel, highest power first.

    Power sums of centred, scaled x are one aggregate; the small normal equations are solved on the
    per-channel rows.
    """
    stats = points.groupBy(*CHANNEL).agg(F.avg("x").alias("_mx"), F.stddev_pop("x").alias("_sx"))
    z = F.coalesce(F.try_divide(F.col("x") - F.col("_mx"), F.col("_sx")), F.lit(0.0))
    rows = points.join(stats, CHANNEL).withColumn("_z", z)
    power = lambda k: F.pow(F.col("_z"), F.lit(k)) if k else F.lit(1.0)
    sums = rows.groupBy(*CHANNEL, "_mx", "_sx").agg(
        F.array(*[F.sum(power(k)) for k in range(2 * degree + 1)]).alias("_a"), F.array(*[F.sum(power(k) * F.col("y")) for k in range(degree + 1)]).alias("_b")
    )

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for sa, sb, mean, sd in zip(a, b, m, s):
            normal = np.array([[sa[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            try:
                low_first = np.linalg.solve(normal, np.asarray(sb))
            except np.linalg.LinAlgError:
                out.append(None)
                continue
            scaled = np.poly1d(low_first[::-1])
            full = scaled(np.poly1d([1.0 / sd, -mean / sd])) if sd else np.poly1d([low_first[0]])
            coef = np.zeros(degree + 1)
            coef[degree + 1 - len(full.coeffs) :] = full.coeffs
            out.append(coef.tolist())
        return pd.Series(out)

    return sums.select(*CHANNEL, solve("_a", "_b", "_mx", "_sx").alias("coefficients"))


def polynomial_value(coefficients: Column, x: Column) -> Column:
    return F.aggregate(coefficients, F.lit(0.0), lambda a, c: a * x + c)


def fit_quality(points: DataFrame, fits: DataFrame) -> DataFrame:
    """R2, RMSE and relative errors of polynomial fits per channel."""
    rows = points.join(fits, CHANNEL).withColumn("_e", F.col("y") - polynomial_value(F.col("coefficients"), F.col("x")))
    e, rel = F.col("_e"), F.abs(F.try_divide(F.col("_e"), F.col("y")))
    q = rows.groupBy(*CHANNEL).agg(
        (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r_squared"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.max(rel).alias("max_relative_error"), F.sqrt(F.avg(rel * rel)).alias("rms_relative_error"),
    )
    return fits.join(q, CHANNEL)


def energy_calibration(points: DataFrame) -> DataFrame:
    out = fit_quality(points, polynomial_fit(points, 2))
    return out.withColumnsRenamed({"max_relative_error": "max_energy_error", "rms_relative_error": "rms_energy_error"})


def _gaussian(p, x):
    a, c, s, o = p
    g = np.exp(-((x - c) ** 2) / (2 * s * s))
    return a * g + o, np.stack([g, a * g * (x - c) / (s * s), a * g * (x - c) ** 2 / s**3, np.ones_like(x)], axis=-1)


def _exponential(p, x):
    a, k, o = p
    g = np.exp(-k * x)
    return a * g + o, np.stack([g, -a * x * g, np.ones_like(x)], axis=-1)


def _sigmoid(p, x):
    a, c, w, o = p
    g = 1 / (1 + np.exp(np.clip(-(x - c) / w, -500, 500)))
    d = a * g * (1 - g)
    return a * g + o, np.stack([g, -d / w, -d * (x - c) / (w * w), np.ones_like(x)], axis=-1)


def _start_gaussian(x, y, n):
    return [y.max() - y.min(), x[np.argmax(y)], max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)) / 2, 1e-6), y.min()]


def _start_exponential(x, y, n):
    span = max(x.max() - x.min(), 1e-9)
    falling = y[np.argmin(x)] >= y[np.argmax(x)]
    return [y.max() - y.min(), (1.0 if falling else -1.0) / span, y.min()]


def _start_sigmoid(x, y, n):
    return [y.max() - y.min(), x.mean(), max((x.max() - x.min()) / 10, 1e-6), y.min()]


CURVES = {
    "gaussian": (_gaussian, _start_gaussian, ["amplitude", "center", "sigma", "offset"]),
    "exponential": (_exponential, _start_exponential, ["amplitude", "decay_constant", "offset"]),
    "sigmoid": (_sigmoid, _start_sigmoid, ["amplitude", "center", "width", "offset"]),
}

# Fixed value: so many points of channels are fitted in one pass (a longer channel alone).
FIT_CELLS = 1 << 14


def _solved(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many small systems, and which have one."""
    try:
        return np.linalg.solve(h, g[..., None])[..., 0], np.ones(len(h), bool)
    except np.linalg.LinAlgError:
        out, ok = np.zeros_like(g), np.ones(len(h), bool)
        for i in range(len(h)):
            try:
                out[i] = np.linalg.solve(h[i], g[i])
            except np.linalg.LinAlgError:
                ok[i] = False
        return out, ok


def _levenberg(fn: Callable, p: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 500):
    """Weighted least squares by damped Gauss-Newton steps, for a channel per line of all arrays (weight 0 fills up)."""
    p, damp = np.array(p, dtype=float), np.full(len(p), 1e-3)
    value, jac = fn(p.T[:, :, None], x)
    cost = np.sum(n * (y - value) ** 2, axis=1)
    at = np.arange(len(p))  # channels still moving
    for _ in range(steps):
        if not len(at):
            break
        j, w = jac[at], n[at]
        jt = j.swapaxes(1, 2)
        h, g = jt @ (j * w[..., None]), (jt @ (w * (y[at] - value[at]))[..., None])[..., 0]
        diagonal = np.einsum("ijj->ij", h).copy()
        np.einsum("ijj->ij", h)[...] += damp[at, None] * np.maximum(diagonal, 1e-12)
        step, ok = _solved(h, g)
        tried = p[at] + step
        trial_value, trial_jac = fn(tried.T[:, :, None], x[at])
        trial = np.sum(w * (y[at] - trial_value) ** 2, axis=1)
        better = ok & np.isfinite(trial) & (trial <= cost[at])
        flat = cost[at] - trial <= 1e-15 * np.maximum(cost[at], 1e-300)
        still = np.max(np.abs(step), axis=1) <= 1e-10 * np.maximum(np.max(np.abs(p[at]), axis=1), 1.0)
        done = better & flat & still
        up = at[better]
        p[up], value[up], jac[up], cost[up] = tried[better], trial_value[better], trial_jac[better], trial[better]
        damp[up] = np.maximum(damp[up] / 10, 1e-12)
        damp[at[~better]] *= 10
        at = at[~(done | (ok & ~better & (damp[at] > 1e12)))]
    return p, cost


def _lots(sizes: np.ndarray) -> list[np.ndarray]:
    """Channels in lots of similar size with at most ``FIT_CELLS`` points when filled up."""
    out, now, longest = [], [], 0
    for i in np.argsort(sizes, kind="stable"):
        longest = max(int(sizes[i]), 1)
        if now and longest * (len(now) + 1) > FIT_CELLS:
            out.append(np.array(now))
            now = []
        now.append(i)
    return [*out, np.array(now)] if now else out


def _fit_lot(curve: str, cells: list[tuple[np.ndarray, ...]]) -> list[dict]:
    """Parameters, R2, RMSE and error of each channel (x, y, n, v)."""
    fn, start, names = CURVES[curve]
    blank = {**{c: float("nan") for c in names}, "r_squared": 0.0, "rmse": float("inf"), "error": None}
    out = [dict(blank) for _ in cells]
    begun = []
    for i, (x, y, n, _) in enumerate(cells):
        try:
            if len(x) < len(names):
                raise ValueError("fewer points than parameters")
            begun.append((i, start(x, y, n)))
        except (ValueError, FloatingPointError) as exc:
            out[i]["error"] = str(exc)
    if not begun:
        return out
    longest = max(len(cells[i][0]) for i, _ in begun)
    # Lines are filled up with copies of their last point at weight 0.
    fill = lambda k: np.array([np.pad(cells[i][k], (0, longest - len(cells[i][k])), "edge") for i, _ in begun])
    weights = np.array([np.pad(cells[i][2], (0, longest - len(cells[i][2]))) for i, _ in begun])
    with np.errstate(all="ignore"):
        solved, costs = _levenberg(fn, np.array([p for _, p in begun]), fill(0), fill(1), weights)
    for (i, _), p, cost in zip(begun, solved, costs):
        _, y, n, v = cells[i]
        if not np.all(np.isfinite(p)):
            out[i]["error"] = "no finite solution"
            continue
        if curve == "gaussian":
            p[2] = abs(p[2])
        inner = float(np.sum(n * v))
        total = float(np.sum(n * (y - np.average(y, weights=n)) ** 2)) + inner
        left = float(cost) + inner
        out[i].update(zip(names, map(float, p)))
        out[i]["r_squared"] = 1 - left / total if total > 0 else 0.0
        out[i]["rmse"] = float(np.sqrt(left / n.sum()))
    return out


def curve_fit(points: DataFrame, curve: str) -> DataFrame:
    """Gaussian, exponential or sigmoid parameters, R2 and RMSE per channel; a failed fit has ``error``.

    Points of one x are combined first (count, mean and scatter of y give the same least-squares
    solution), so a channel is a row as long as its distinct x values; many rows are fitted at a time.
    """
    names = CURVES[curve][2]
    cells = points.groupBy(*CHANNEL, "x").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.var_pop("y").alias("v"))
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "n", "v")])))
    rows = cells.groupBy(*CHANNEL).agg(packed.alias("_c")).select(*CHANNEL, *[F.col("_c")[c].alias(c) for c in ("x", "y", "n", "v")])
    fields = [T.StructField(c, T.DoubleType()) for c in (*names, "r_squared", "rmse")]
    schema = T.StructType([points.schema["channel_id"], *fields, T.StructField("error", T.StringType())])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = [tuple(np.asarray(a, dtype=float) for a in row) for row in zip(*(pdf[c] for c in ("x", "y", "n", "v")))]
            found: list[dict] = [{}] * len(known)
            for lot in _lots(np.array([len(c[0]) for c in known], dtype=np.int64)):
                for i, row in zip(lot, _fit_lot(curve, [known[i] for i in lot])):
                    found[i] = row
            out = pd.DataFrame(found, columns=[*schema.names[1:]])
            out.insert(0, "channel_id", pdf["channel_id"].to_numpy())
            yield out

    fits = rows.mapInPandas(fit, schema)
    if curve == "gaussian":
        return fits.withColumn("fwhm", F.col("sigma") * (2 * math.sqrt(2 * math.log(2))))
    if curve == "exponential":
        return fits.withColumn("half_life", F.try_divide(F.lit(math.log(2)), F.col("decay_constant")))
    return fits


def distribution_fit(df: DataFrame, value: str) -> DataFrame:
    """Normal, exponential and gamma fits of a column with log-likelihood and AIC, best first.

    Maximum likelihood is closed form for the first two (the exponential is shifted to the minimum);
    the gamma uses the closed-form estimator of Ye and Chen on values shifted just below the minimum.
    """
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    rows = attach_row(df.select(v.alias("v")), ends)
    # A small shift keeps the smallest value inside the gamma's open range.
    shift = F.greatest((F.col("hi") - F.col("lo")) * 1e-3, F.lit(1e-12))
    w = F.col("v") - F.col("lo") + shift
    rows = rows.withColumn("w", w).withColumn("lw", F.log("w"))
    m = rows.agg(
        F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("lo").alias("lo"), F.sum("w").alias("sw"),
        F.sum("lw").alias("sl"), F.sum(F.col("w") * F.col("lw")).alias("swl"), F.min(shift).alias("shift"),
    )
    n = F.col("n")
    normal = -n / 2 * (F.log(F.lit(2 * math.pi)) + 2 * F.log("sd") + 1)
    rate = F.col("mean") - F.col("lo")
    exponential = -n * (F.log(rate) + 1)
    scale = (n * F.col("swl") - F.col("sl") * F.col("sw")) / (n * n)
    shape = F.col("sw") / n / scale

    @F.pandas_udf("double")
    def log_gamma(s: pd.Series) -> pd.Series:
        return s.map(math.lgamma)

    gamma = (shape - 1) * F.col("sl") - F.col("sw") / scale - n * (log_gamma(shape) + shape * F.log(scale))
    none = F.lit(None).cast("double")
    fit = lambda name, a, b, c, ll, k: F.struct(
        F.lit(name).alias("distribution"), a.alias("shape"), b.alias("location"), c.alias("scale"), ll.alias("log_likelihood"), (2 * k - 2 * ll).alias("aic")
    )
    cells = F.array(
        fit("normal", none, F.col("mean"), F.col("sd"), normal, 2), fit("exponential", none, F.col("lo"), rate, exponential, 2),
        fit("gamma", shape, F.col("lo") - F.col("shift"), scale, gamma, 3),
    )
    return m.select(F.inline(cells)).orderBy("aic")


def distribution_analysis(df: DataFrame, value: str) -> DataFrame:
    """Normality test and the best-fitting distribution in one row."""
    best = distribution_fit(df, value).limit(1).select(F.col("distribution").alias("best_fit"), F.col("aic").alias("best_aic"))
    return attach_row(normality(df, value), best)
