"""Calibration, filters and image-quality metrics on pixel tables ``(frame_id, y, x, value)``.

Filters work on tiles with a border (``tiles``), never on whole frames; wavelets scatter every pixel to the targets that
need it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import POS, SIZE, SeqSpec, attach_row, index_sequence
from lumenlog.functions.stats import exact_percentiles, moments, ratio, safe_corr
from lumenlog.operators import tiles
from lumenlog.operators.aggregates import histogram
from lumenlog.operators.scans import map_cells

PIXEL = ["frame_id", "y", "x"]
INF = float("inf")


# --- calibration -------------------------------------------------------------------------------

def gain_offset(v: Column, gain: float, offset: float) -> Column:
    return (v - offset) / gain


def apply_calibration(v: Column, gain: float, offset: float, reference_gain: float = 1.0, reference_offset: float = 0.0) -> Column:
    return gain_offset(v, gain, offset) * reference_gain + reference_offset


def polynomial(v: Column, coefficients: Sequence[float] = (1.0, 0.0)) -> Column:
    """Horner form, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * v + F.lit(float(c))
    return out


def temperature_corrected(v: Column, temperature: Column) -> Column:
    return v / (1 + 0.01 * (temperature - 20))


def soft_threshold(v: Column, sigma: Column) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - sigma, F.lit(0.0))


# High-pass decomposition taps of the db4 wavelet.
DB4_HIGH = [
    -0.23037781330885523, 0.7148465705525415, -0.6308807679295904, -0.02798376941698385,
    0.18703481171888114, 0.030841381835986965, -0.032883011666982945, -0.010597401784997278,
]


def wavelet_sigma(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Noise per frame: median |diagonal level-1 detail| / 0.6745, symmetric border, decimated by two."""
    # Coefficient k reads positions 2k+1-j, so targets are the odd positions up to size + 6.
    taps = [(-j, c) for j, c in enumerate(DB4_HIGH)]

    def detail(df: DataFrame, axis: str, size: int) -> DataFrame:
        other = "x" if axis == "y" else "y"
        out = _scatter(df, axis, size, taps, "reflect", last=size + 7)
        out = out.filter(F.col(f"_t{axis}") % 2 == 1)
        return out.groupBy("frame_id", other, F.expr(f"_t{axis} div 2").alias(axis)).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))

    d = detail(detail(pixels, "y", height), "x", width).withColumn("value", F.abs("value"))
    return exact_percentiles(d, ["frame_id"], "value", {"_m": 0.5}).select("frame_id", (F.col("_m") / 0.6745).alias("sigma"))


def denoise_soft(pixels: DataFrame, sigma: float | DataFrame) -> DataFrame:
    if isinstance(sigma, DataFrame):
        return pixels.join(sigma, "frame_id").withColumn("value", soft_threshold(F.col("value"), F.col("sigma"))).drop("sigma")
    return pixels.withColumn("value", soft_threshold(F.col("value"), F.lit(float(sigma))))


def dark_offset(dark: DataFrame) -> DataFrame:
    return dark.agg(F.avg("value").alias("offset"))


def flat_gain(flat: DataFrame, expected: float = 1.0) -> DataFrame:
    return flat.agg((F.avg("value") / expected).alias("gain"), F.min("value").alias("offset"))


def mean_frame(stack: DataFrame) -> DataFrame:
    """Average of a stack of reference frames, one row per pixel position."""
    return stack.groupBy("y", "x").agg(F.avg("value").alias("value"))


def _reference(frame: DataFrame, name: str) -> DataFrame:
    return frame.select("y", "x", F.col("value").alias(name))


def auto_calibrate(pixels: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Subtract the mean dark value; multiply by mean(flat) / flat at each pixel (NULL where the flat has no value)."""
    if dark is not None:
        pixels = attach_row(pixels, dark.agg(F.avg("value").alias("_dark")))
        pixels = pixels.withColumn("value", F.col("value") - F.col("_dark")).drop("_dark")
    if flat is not None:
        pixels = attach_row(pixels.join(_reference(flat, "_flat"), ["y", "x"], "left"), flat.agg(F.avg("value").alias("_mean")))
        pixels = pixels.withColumn("value", F.col("value") * F.try_divide(F.col("_mean"), F.col("_flat"))).drop("_flat", "_mean")
    return pixels


def pixel_response(flat: DataFrame, dark: DataFrame, expected: float = 1.0) -> DataFrame:
    """Offset and gain per pixel position; gain 1 where flat does not exceed dark."""
    both = _reference(flat, "_f").join(_reference(dark, "_d"), ["y", "x"], "full")
    diff = F.col("_f") - F.col("_d")
    return both.select("y", "x", F.col("_d").alias("offset"), F.when(diff > 0, expected / F.when(diff > 0, diff)).otherwise(1.0).alias("gain"))


def apply_pixel_response(pixels: DataFrame, response: DataFrame) -> DataFrame:
    out = pixels.join(response, ["y", "x"], "left")  # NULL where no response is known
    return out.withColumn("value", (F.col("value") - F.col("offset")) * F.col("gain")).drop("offset", "gain")


def run_steps(pixels: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Apply named steps in order; the history has mean, sd, min, max and mean/sd after each."""
    stages, out = [("input", pixels)], pixels
    for name, fn in steps.items():
        out = fn(out)
        stages.append((name, out))
    history = None
    for i, (name, df) in enumerate(stages):
        row = df.groupBy("frame_id").agg(*moments(F.col("value"))).withColumns({"step": F.lit(i), "name": F.lit(name)})
        history = row if history is None else history.unionByName(row)
    snr = F.coalesce(F.try_divide(F.col("mean"), F.col("std")), F.lit(0.0))
    return out, history.withColumn("snr", snr)


# --- neighbourhood operators -------------------------------------------------------------------

def _scatter(df: DataFrame, axis: str, size: int, taps: Sequence[tuple[int, float]], border: str, last: int | None = None, first: int = 0) -> DataFrame:
    """Rows (target ``_t<axis>``, offset ``_d<axis>``, weight ``_w``) to which each pixel contributes.

    A target at t reads position t + d; ``reflect`` mirrors positions outside the frame at its edge.
    """
    if max(abs(d) for d, _ in taps) > size:
        raise ValueError("kernel radius exceeds the frame")
    end = size if last is None else last
    s = F.col(axis)
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in taps])

    def targets(o: Column) -> Column:
        spots = [s - o["d"]]
        if border == "reflect":
            spots += [-1 - s - o["d"], 2 * size - 1 - s - o["d"]]
        return F.array(*[F.struct(t.alias("t"), o["d"].alias("d"), o["w"].alias("w")) for t in spots])

    reach = F.filter(F.flatten(F.transform(table, targets)), lambda p: (p["t"] >= first) & (p["t"] < end))
    out = df.withColumn("_p", F.explode(reach))
    weight = F.col("_p")["w"] * F.col("_w") if "_w" in df.columns else F.col("_p")["w"]
    return out.withColumns({f"_t{axis}": F.col("_p")["t"], f"_d{axis}": F.col("_p")["d"], "_w": weight}).drop("_p")


def gaussian_filter(pixels: DataFrame, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """Gaussian weights to four sigma, mirrored border; missing pixels take no part."""
    r = int(4.0 * sigma + 0.5)
    taps = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return tiles.filtered(pixels, height, width, r, lambda a: tiles.weighted_mean(a, taps), work=4)


def median_filter(pixels: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    """Median of the present pixels of an odd square window, mirrored border."""
    return tiles.filtered(pixels, height, width, size // 2, lambda a: tiles.median_of(a, size), work=2 * size * size)


def laplacian(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Five-point Laplacian, mirrored border; a missing neighbour counts as equal to the pixel."""
    return tiles.filtered(pixels, height, width, 1, tiles.laplacian_of, work=4)


def noise_variance(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return laplacian(pixels, height, width).groupBy("frame_id").agg((F.var_pop("value") / 6).alias("noise"))


def wiener_filter(pixels: DataFrame, height: int, width: int, size: int = 5, noise: float | None = None) -> DataFrame:
    """Adaptive Wiener filter: local mean and variance with zeros outside the frame and for missing pixels."""
    if noise is None:
        table = noise_variance(pixels, height, width)
    else:
        table = pixels.select("frame_id").distinct().withColumn("noise", F.lit(float(noise)))
    return tiles.filtered(pixels, height, width, size // 2, lambda a, n: tiles.wiener_of(a, size, n), False, 6, extra=table)


def bilateral_filter(pixels: DataFrame, height: int, width: int, sigma_spatial: float = 1.0, sigma_intensity: float = 0.1) -> DataFrame:
    """Mean by nearness in place and value over a window cut at the frame's edge; missing pixels take no part."""
    r = (int(2 * sigma_spatial) + 1) // 2
    return tiles.filtered(pixels, height, width, r, lambda a: tiles.bilateral_of(a, r, sigma_spatial, sigma_intensity), False, 6)


def residual(pixels: DataFrame, filtered: DataFrame) -> DataFrame:
    other = filtered.withColumnRenamed("value", "_f")
    return pixels.join(other, PIXEL).withColumn("value", F.col("value") - F.col("_f")).drop("_f")


def noise_map(pixels: DataFrame, height: int, width: int, sigma: float = 2.0) -> DataFrame:
    return residual(pixels, gaussian_filter(pixels, height, width, sigma))


def _snr_db(signal: DataFrame, noise: DataFrame, name: str) -> DataFrame:
    power = lambda df, n: df.groupBy("frame_id").agg(F.avg(F.col("value") * F.col("value")).alias(n))
    both = power(signal, "_s").join(power(noise, "_n"), "frame_id")
    db = 10 * F.log10(F.try_divide(F.col("_s"), F.col("_n")))
    return both.select("frame_id", F.when(F.col("_n") == 0, F.lit(INF)).otherwise(db).alias(name))


def laplacian_snr(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return _snr_db(pixels, laplacian(pixels, height, width), "snr_db")


def gaussian_snr(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return _snr_db(pixels, noise_map(pixels, height, width, 2.0), "snr_db")


def best_denoiser(pixels: DataFrame, candidates: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Per frame, the candidate with the highest SNR of result over what it removed."""
    out = None
    for name, fn in candidates.items():
        done = fn(pixels)
        row = _snr_db(done, residual(pixels, done), "snr_db").withColumn("candidate", F.lit(name))
        out = row if out is None else out.unionByName(row)
    best = F.max_by(F.struct("candidate", "snr_db"), F.struct("snr_db", "candidate"))
    return out.groupBy("frame_id").agg(best.alias("_b")).select("frame_id", "_b.candidate", F.col("_b.snr_db").alias("best_snr"))


def peaks_2d(pixels: DataFrame, height: int, width: int, threshold: float | None = None) -> DataFrame:
    """Pixels equal to their 3x3 maximum and above the threshold (default mean + 2 sd of the frame)."""
    top = tiles.filtered(pixels, height, width, 1, lambda a: np.fmax.reduce(tiles.windows(a, 3), axis=-1), work=9)
    out = pixels.join(top.withColumnRenamed("value", "_max"), PIXEL)
    if threshold is None:
        out = out.join(pixels.groupBy("frame_id").agg((F.avg("value") + 2 * F.stddev_pop("value")).alias("_limit")), "frame_id")
    else:
        out = out.withColumn("_limit", F.lit(float(threshold)))
    return out.filter((F.col("value") == F.col("_max")) & (F.col("value") > F.col("_limit"))).select(*PIXEL, "value")


# --- metrics -----------------------------------------------------------------------------------

def pair_frames(reference: DataFrame, test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    on = [*by, *PIXEL]
    left = reference.select(*[c for c in on if c in reference.columns], F.col("value").alias("r"))
    shared = [c for c in on if c in reference.columns]
    return test.select(*on, F.col("value").alias("t")).join(left, shared)


def error_metrics(pairs: DataFrame, by: Sequence[str] = ("frame_id",)) -> DataFrame:
    """MSE, RMSE, MAE, PSNR, NRMSE, MAPE and correlation of reference ``r`` and test ``t``."""
    r, t = F.col("r"), F.col("t")
    e = r - t
    row = pairs.groupBy(*by).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.greatest(F.max(r), F.max(t)).alias("_peak"), (F.max(r) - F.min(r)).alias("_range"),
        (F.coalesce(F.avg(F.when(r != 0, F.abs(F.try_divide(e, r)))), F.lit(0.0)) * 100).alias("mape"), safe_corr(r, t).alias("correlation"),
    )
    rmse = F.sqrt("mse")
    psnr = F.when(F.col("mse") == 0, F.lit(INF)).otherwise(20 * F.log10(F.try_divide(F.when(F.col("_peak") > 0, F.col("_peak")), rmse)))
    return row.select(
        *by, "mse", rmse.alias("rmse"), "mae", psnr.alias("psnr"), F.coalesce(F.try_divide(rmse, F.col("_range")), F.lit(0.0)).alias("nrmse"), "mape", "correlation"
    )


def ssim(pairs: DataFrame, height: int, width: int, by: Sequence[str] = ("frame_id",), window: int = 7) -> DataFrame:
    """Mean structural similarity over full uniform windows, sample covariance, K1 0.01 and K2 0.03."""
    sums = tiles.similarity(pairs, height, width, by, window)
    return sums.groupBy(*by).agg(F.sum("windows").alias("_n"), F.sum("total").alias("_s")).filter("_n > 0").select(*by, (F.col("_s") / F.col("_n")).alias("ssim"))


def all_metrics(reference: DataFrame, test: DataFrame, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    on = [*by, "frame_id"]
    pairs = pair_frames(reference, test, by)
    return error_metrics(pairs, on).join(ssim(pairs, height, width, on), on, "left")


def dqe(signal: DataFrame, noise: DataFrame, photons: float) -> DataFrame:
    var = lambda df, n: df.groupBy("frame_id").agg(F.var_pop("value").alias(n))
    both = var(signal, "_s").join(var(noise, "_n"), "frame_id")
    return both.select("frame_id", F.when(F.col("_n") == 0, 1.0).otherwise(F.try_divide(F.col("_s"), F.col("_n")) / photons).alias("dqe"))


def mtf(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Modulation transfer of the middle row: gradient, DFT magnitude, first half, over the first value."""
    row = pixels.filter(F.col("y") == height // 2).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("x", "value"))).alias("_row"))
    at = lambda i: F.get(F.col("_row"), i)["value"]
    ends = lambda i: F.when(i == 0, at(i + 1) - at(i)).when(i == width - 1, at(i) - at(i - 1)).otherwise((at(i + 1) - at(i - 1)) / 2)
    row = row.withColumn("_lsf", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), ends))

    def magnitude(k: Column) -> Column:
        angle = lambda i: -2 * math.pi * k * i / width
        part = lambda f: F.aggregate(F.transform("_lsf", lambda v, i: v * f(angle(i))), F.lit(0.0), lambda a, x: a + x)
        return F.sqrt(F.pow(part(F.cos), F.lit(2)) + F.pow(part(F.sin), F.lit(2)))

    out = row.withColumn("_mag", F.transform(F.sequence(F.lit(0), F.lit(width // 2 - 1)), magnitude))
    out = out.select("frame_id", F.col("_mag")[0].alias("_dc"), F.posexplode("_mag").alias("k", "_m"))
    value = F.when(F.col("_dc") != 0, F.try_divide(F.col("_m"), F.col("_dc"))).otherwise(F.col("_m"))
    return out.select("frame_id", "k", (F.col("k") / F.lit(float(width))).alias("frequency"), value.alias("mtf"))


def power_spectrum(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """|FFT2|^2 of every frame minus its mean (many frames per sorted pass, one frame at a time)."""
    schema = T.StructType([pixels.schema["frame_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("power", T.DoubleType())])

    def spectra(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        frames = pdf["value"].to_numpy().reshape(len(starts), height, width)
        frames = frames - frames.mean(axis=(1, 2), keepdims=True)
        power = np.abs(np.fft.fft2(frames)) ** 2
        return pd.DataFrame({"frame_id": pdf["frame_id"], "y": pdf["y"], "x": pdf["x"], "power": power.ravel()})

    ordered = pixels.select("frame_id", "y", "x", "value", (F.col("y") * width + F.col("x")).alias(POS))
    return map_cells(ordered, ["frame_id"], spectra, schema)


def noise_power(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Radial mean of the power spectrum around the array centre (unshifted)."""
    c = height // 2
    dx, dy = F.col("x") - c, F.col("y") - c
    r = F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))).cast("int")
    rings = power_spectrum(pixels, height, width).withColumn("r", r).filter(F.col("r") < min(c, width // 2))
    out = rings.groupBy("frame_id", "r").agg(F.avg("power").alias("nps"))
    return out.withColumn("frequency", F.when(F.col("r") < (height + 1) // 2, F.col("r")).otherwise(F.col("r") - height) / F.lit(float(height)))


def uniformity(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(1 - sd/mean) * 100 over pixels and over the four quadrant means, with range statistics."""
    part = (F.col("y") >= height // 2).cast("int") * 2 + (F.col("x") >= width // 2).cast("int")
    quadrants = pixels.groupBy("frame_id", part.alias("q")).agg(F.avg("value").alias("m"))
    percent = lambda m, s: F.coalesce((1 - F.try_divide(s, m)) * 100, F.lit(0.0))
    regional = quadrants.groupBy("frame_id").agg(percent(F.avg("m"), F.stddev_pop("m")).alias("regional_uniformity_percentage"))
    whole = pixels.groupBy("frame_id").agg(*moments(F.col("value")))
    whole = whole.withColumns({"uniformity_percentage": percent(F.col("mean"), F.col("std")), "range": F.col("max") - F.col("min")})
    return whole.join(regional, "frame_id")


def temporal_stability(series: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per-pixel mean and variance over the frames of a series, summarised."""
    px = series.groupBy(*by, "y", "x").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    row = px.groupBy(*by).agg(
        F.avg("m").alias("overall_mean"), F.sqrt(F.avg("v")).alias("overall_temporal_std"), F.max(F.sqrt("v")).alias("max_temporal_variation"),
        F.avg(F.sqrt("v")).alias("mean_temporal_variation"),
    )
    return row.withColumn(
        "stability_percentage", F.coalesce((1 - F.try_divide(F.col("overall_temporal_std"), F.col("overall_mean"))) * 100, F.lit(0.0))
    )


def frame_means(series: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean of every frame with its 0-based time index in the series."""
    means = series.groupBy(*by, "frame_id").agg(F.avg("value").alias("value"))
    return index_sequence(means, SeqSpec(tuple(by), "frame_id", "frame_id", "frame_id")).withColumnsRenamed({POS: "t", SIZE: "n"})


def temporal_drift(series: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Slope of frame means over time and 1 - mean coefficient of variation per pixel (0 where undefined)."""
    px = series.groupBy(*by, "y", "x").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    cov = px.groupBy(*by).agg((1 - F.avg(F.coalesce(F.try_divide(F.col("s"), F.col("m")), F.lit(0.0)))).alias("overall_stability"))
    drift = frame_means(series, by).groupBy(*by).agg(F.regr_slope("value", F.col("t").cast("double")).alias("drift_slope"))
    return cov.join(drift, list(by))


def dominant_period(series: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Frequency with the largest periodogram value of the frame means, the constant excluded."""
    means = frame_means(series, by).select(*by, F.col("t").alias(POS), "value")
    schema = T.StructType([*[means.schema[c] for c in by], T.StructField("dominant_frequency", T.DoubleType())])

    def peak(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v = pdf["value"].to_numpy()
        out = pdf.iloc[starts][list(by)].copy()
        found = []
        for a, b in zip(starts, [*starts[1:], len(v)]):
            power = np.abs(np.fft.rfft(v[a:b] - v[a:b].mean())) ** 2
            power[1 : -1 if (b - a) % 2 == 0 else None] *= 2
            found.append((1 + int(np.argmax(power[1:]))) / (b - a) if b - a > 1 else 0.0)
        out["dominant_frequency"] = found
        return out

    return map_cells(means, list(by), peak, schema)


def shift_correlation(pixels: DataFrame, height: int, width: int, lags: Sequence[tuple[int, int]]) -> DataFrame:
    """Pearson correlation of each frame with itself rolled by (i, j), for the asked lags."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in lags])
    moved = pixels.select("frame_id", "y", "x", F.col("value").alias("_b"), F.inline(table))
    moved = moved.select(
        "frame_id", F.pmod(F.col("y") - F.col("i"), F.lit(height)).alias("y"), F.pmod(F.col("x") - F.col("j"), F.lit(width)).alias("x"), "i", "j", "_b"
    )
    both = pixels.join(moved, PIXEL)
    return both.groupBy("frame_id", "i", "j").agg(safe_corr(F.col("value"), F.col("_b")).alias("correlation"))


def spatial_correlation(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Correlation length (first lag below 1/e) and horizontal over vertical mean correlation.

    Only the two profiles through the centre lag are computed, not every shift.
    """
    c = height // 2
    row = [(c, j) for j in range(c, width)]
    column = [(i, c) for i in range(c, height)]
    r = shift_correlation(pixels, height, width, sorted(set(row + column)))
    h, v = (F.col("i") == c) & (F.col("j") >= c), (F.col("j") == c) & (F.col("i") >= c)
    out = r.groupBy("frame_id").agg(
        F.min(F.when(h & (F.col("correlation") < 1 / math.e), F.col("j") - c)).alias("_len"),
        F.avg(F.when(h & (F.col("j") < c + 10), F.col("correlation"))).alias("_h"), F.avg(F.when(v & (F.col("i") < c + 10), F.col("correlation"))).alias("_v"),
    )
    return out.select(
        "frame_id", F.coalesce("_len", F.lit(width // 2)).alias("correlation_length"), F.coalesce(F.try_divide(F.col("_h"), F.col("_v")), F.lit(1.0)).alias("anisotropy_ratio")
    )


# --- statistics --------------------------------------------------------------------------------

def frame_statistics(pixels: DataFrame, by: Sequence[str] = ("frame_id",)) -> DataFrame:
    v = F.col("value")
    row = pixels.groupBy(*by).agg(
        *moments(v), F.sum(v).alias("total"), F.count_if(v != 0).alias("non_zero"), (F.count_if(v != 0) / F.count("*")).alias("coverage"),
        F.when(F.stddev_pop(v) == 0, 0.0).otherwise(F.skewness(v)).alias("skewness"), F.when(F.stddev_pop(v) == 0, 0.0).otherwise(F.kurtosis(v)).alias("kurtosis"),
    )
    return row.join(exact_percentiles(pixels, list(by), "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}), list(by))


def histogram_entropy(pixels: DataFrame, by: Sequence[str] = ("frame_id",), bins: int = 50) -> DataFrame:
    h = histogram(pixels, "value", bins, list(by))
    return h.groupBy(*by).agg(F.sum(-F.col("density") * F.log(F.col("density") + 1e-10)).alias("entropy"))


def full_statistics(pixels: DataFrame, by: Sequence[str] = ("frame_id",)) -> DataFrame:
    return frame_statistics(pixels, by).join(histogram_entropy(pixels, by), list(by))


def axis_profile(pixels: DataFrame, axis: str) -> DataFrame:
    return pixels.groupBy("frame_id", axis).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def middle_profiles(pixels: DataFrame, height: int, width: int) -> DataFrame:
    row = pixels.filter(F.col("y") == height // 2).select("frame_id", F.lit("row").alias("profile"), F.col("x").alias("position"), "value")
    return row.unionByName(pixels.filter(F.col("x") == width // 2).select("frame_id", F.lit("column").alias("profile"), F.col("y").alias("position"), "value"))


def block_deviation(pixels: DataFrame, height: int, width: int, size: int = 5) -> DataFrame:
    """Population sd of each full, non-overlapping block, written to its pixels."""
    full = pixels.filter((F.col("y") < height // size * size) & (F.col("x") < width // size * size))
    by = ["frame_id", "_by", "_bx"]
    full = full.withColumns({"_by": F.expr(f"y div {size}"), "_bx": F.expr(f"x div {size}")})
    return full.join(full.groupBy(*by).agg(F.stddev_pop("value").alias("block_std")), by).select(*PIXEL, "block_std")


def ecdf(pixels: DataFrame) -> DataFrame:
    """Sorted values with rank / N per frame, from a value-ordered index."""
    spec = SeqSpec(("frame_id",), "value", "value", "_i")
    ranked = index_sequence(pixels.withColumn("_i", F.col("y").cast("long") * (1 << 31) + F.col("x")), spec)
    return ranked.select(*PIXEL, "value", ((F.col(POS) + 1) / F.col(SIZE)).alias("ecdf"))


def roi_statistics(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Statistics inside end-exclusive rectangles (roi, y0, y1, x0, x1) of every frame.

    Rectangles meet pixels by equality on the row coordinate, then filter on the column.
    """
    rows = rois.filter((F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    inside = pixels.join(rows, "y").filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return inside.groupBy("frame_id", "roi").agg(*moments(F.col("value")), F.sum("value").alias("sum"))


# --- assessment --------------------------------------------------------------------------------

def rating(score: Column, cuts: Sequence[float], names: Sequence[str], strict: bool = False) -> Column:
    out = None
    for cut, name in zip(cuts, names):
        hit = score > cut if strict else score >= cut
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(names[-1])


# Rating cut-offs.
BANDS = ["Excellent", "Good", "Fair", "Poor"]
NOISE_CUTS, QUALITY_CUTS, CALIBRATION_CUTS = (30, 20, 10), (90, 75, 60), (85, 70, 55)
SCORE_CUTS, SCORE_BANDS = (0.9, 0.8, 0.7, 0.6), ["Excellent", "Good", "Fair", "Poor", "Very Poor"]


def _mean_of(parts: Sequence[Column]) -> Column:
    present = F.filter(F.array(*parts), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.coalesce(F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present).cast("double")), F.lit(0.0))


def assess_detector(pixels: DataFrame, height: int, width: int, reference: DataFrame | None = None) -> DataFrame:
    """Uniformity, noise and accuracy scores of every frame, their mean and ratings."""
    out = uniformity(pixels, height, width).join(gaussian_snr(pixels, height, width), "frame_id")
    parts = [F.col("uniformity_percentage"), F.least(F.col("snr_db") / 30 * 100, F.lit(100.0))]
    if reference is not None:
        out = out.join(all_metrics(reference, pixels, height, width), "frame_id")
        parts = [F.col("ssim") * 100, F.least(F.col("psnr") / 40 * 100, F.lit(100.0)), *parts]
    out = out.withColumn("noise_level", F.col("std")).withColumn("overall_score", _mean_of(parts))
    return out.withColumns(
        {
            "noise_quality": rating(F.col("snr_db"), NOISE_CUTS, BANDS, strict=True),
            "quality_rating": rating(F.col("overall_score"), QUALITY_CUTS, BANDS),
        }
    )


def compare_signals(reference: DataFrame, tests: DataFrame, height: int, width: int) -> DataFrame:
    """Metrics of every named test signal (``name`` column) with statistics of the differences."""
    by = ["name", "frame_id"]
    out = all_metrics(reference, tests, height, width, ["name"])
    pairs = pair_frames(reference, tests, ["name"])
    diff = pairs.withColumn("value", F.col("r") - F.col("t")).groupBy(*by).agg(*moments(F.col("value"), "difference_"))
    return out.join(diff, by).withColumn("verdict", F.when(F.col("ssim") > 0.8, "Good").otherwise("Poor"))


def compare_calibrations(raw: DataFrame, calibrated: DataFrame, reference: DataFrame, height: int, width: int) -> DataFrame:
    """Per method (``name``): raw vs calibrated, calibrated vs reference, improvement and score."""
    by = ["name", "frame_id"]
    first = all_metrics(raw, calibrated, height, width, ["name"]).select(*by, *[F.col(c).alias(f"raw_{c}") for c in ("psnr", "ssim", "rmse", "mae")])
    second = all_metrics(reference, calibrated, height, width, ["name"]).select(
        *by, *[F.col(c).alias(f"calibrated_{c}") for c in ("psnr", "ssim", "rmse", "mae", "correlation")]
    )
    out = first.join(second, by)
    gain = lambda c: F.try_divide(F.col(f"raw_{c}") - F.col(f"calibrated_{c}"), F.col(f"raw_{c}")) * 100
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    score = 0.4 * zero(F.col("calibrated_ssim")) + 0.3 * zero(F.least(F.col("calibrated_psnr") / 50, F.lit(1.0))) + 0.3 * zero(F.col("calibrated_correlation"))
    out = out.withColumns({"rmse_improvement": gain("rmse"), "mae_improvement": gain("mae"), "quality_score": score})
    return out.withColumn("quality_rating", rating(F.col("quality_score"), SCORE_CUTS, SCORE_BANDS))


def rank_calibrations(comparison: DataFrame) -> DataFrame:
    means = comparison.groupBy("name").agg(F.avg("quality_score").alias("quality_score"))
    return means.orderBy(F.desc("quality_score"), "name")


def assess_calibration(raw: DataFrame, calibrated: DataFrame, reference: DataFrame, height: int, width: int) -> DataFrame:
    """Calibration score per frame from improvement, similarity, PSNR and linearity."""
    before = all_metrics(reference, raw, height, width).select("frame_id", F.col("rmse").alias("_r0"), F.col("mae").alias("_m0"))
    after = all_metrics(reference, calibrated, height, width)
    out = after.join(before, "frame_id")
    gain = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a)) * 100
    improvement = (gain("_r0", "rmse") + gain("_m0", "mae")) / 2
    r2 = F.col("correlation") * F.col("correlation")
    parts = [F.greatest(improvement, F.lit(0.0)), F.col("ssim") * 100, F.least(F.col("psnr") / 40 * 100, F.lit(100.0)), r2 * 100]
    out = out.withColumns({"average_improvement": improvement, "linearity_r_squared": r2, "overall_score": _mean_of(parts)})
    return out.withColumn("quality_rating", rating(F.col("overall_score"), CALIBRATION_CUTS, BANDS)).drop("_r0", "_m0")
