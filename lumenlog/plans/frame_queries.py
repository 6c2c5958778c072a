"""Queries for frames (embeddings read as 8x8 pixel tables) and curve fits."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from lumenlog.functions.storage import shared_dir
from lumenlog.operators import fit
from lumenlog.operators import frames as fr
from lumenlog.plans.registry import query
from lumenlog.sources import frames as fs
from lumenlog.sources import tabular as ts

H = W = 8
PX = """px AS MATERIALIZED (SELECT vec_id AS frame_id, label AS series_id, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE AS value
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
DF = "dk AS (SELECT y, x, min(value) AS d FROM px WHERE series_id = 0 GROUP BY 1, 2), fl AS (SELECT y, x, avg(value) + 1 AS f FROM px GROUP BY 1, 2)"


def px(t):
    return fs.unpack(t.table("embeddings").withColumn("series_id", F.col("label")), "vec_id", "embedding", W, ["series_id"])


def dark(t):
    p = px(t)
    return p.filter(F.col("series_id") == 0).groupBy("y", "x").agg(F.min("value").alias("value"))


def flat(t):
    return fr.mean_frame(px(t)).withColumn("value", F.col("value") + 1)


def value_query(name, sql, rnd=("value",), digits=6):
    return query(name, sql=sql, rnd=list(rnd), digits=digits)


@value_query("f18_gain_offset", f"WITH {PX} SELECT frame_id, y, x, (value - 0.1) / 0.8 * 2 + 0.5 AS value FROM px")
def _(t):
    v = fr.apply_calibration(F.col("value"), 0.8, 0.1, 2.0, 0.5)
    return px(t).withColumn("value", v).drop("series_id")


@value_query("f19_polynomial", f"WITH {PX} SELECT frame_id, y, x, 0.3 * value * value + 1.2 * value + 0.1 AS value FROM px")
def _(t):
    return px(t).withColumn("value", fr.polynomial(F.col("value"), [0.3, 1.2, 0.1])).drop("series_id")


@value_query("f20_temperature", f"WITH {PX} SELECT frame_id, y, x, value / (1 + 0.01 * (series_id + 18 - 20)) AS value FROM px")
def _(t):
    return px(t).withColumn("value", fr.temperature_corrected(F.col("value"), F.col("series_id") + 18)).drop("series_id")


@value_query("f21_soft_threshold", f"WITH {PX} SELECT frame_id, y, x, sign(value) * greatest(abs(value) - 0.05, 0) AS value FROM px")
def _(t):
    return fr.denoise_soft(px(t), 0.05).drop("series_id")


@query("f21_soft_threshold_estimated")
def _(t):
    return fr.denoise_soft(px(t), fr.wavelet_sigma(px(t), H, W)).drop("series_id")


@query(
    "f22_rating",
    sql=f"""WITH {PX} SELECT frame_id, CASE WHEN max(value) * 100 >= 40 THEN 'Excellent' WHEN max(value) * 100 >= 30 THEN 'Good' WHEN max(value) * 100 >= 25 THEN 'Fair' ELSE 'Poor' END AS rating
    FROM px GROUP BY 1""",
)
def _(t):
    top = px(t).groupBy("frame_id").agg(F.max("value").alias("m"))
    return top.select("frame_id", fr.rating(F.col("m") * 100, (40, 30, 25), fr.BANDS).alias("rating"))


@query("s12_frame_sink", sql=f"WITH {PX} SELECT frame_id, y, x, value FROM px WHERE series_id < 5", rnd=["value"])
def _(t):
    path = f"{shared_dir(t.spark)}/frames-{uuid.uuid4().hex}"
    p = px(t)
    for name, part in (("low", p.filter(F.col("series_id") < 5)), ("high", p.filter(F.col("series_id") >= 5))):
        fs.write_frames(part.drop("series_id"), path, name, "run1", {"detector": "8x8"})
    return fs.read_frames(t.spark, path, "low").select("frame_id", "y", "x", "value")


@query(
    "s13_rescale_bytes",
    sql=f"""WITH {PX} SELECT frame_id, y, x, floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 255)::INT AS byte FROM px WINDOW w AS (PARTITION BY frame_id)""",
)
def _(t):
    return fs.to_bytes(px(t)).select("frame_id", "y", "x", "byte")


@query(
    "s14_dataset_info",
    sql=f"""WITH {PX} SELECT frame_id, 8::INT AS height, 8::INT AS width, count(*) AS values, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std FROM px GROUP BY 1""",
    rnd=["min", "max", "mean", "std"],
)
def _(t):
    return ts.dataset_info(px(t))


@query("s14_list_datasets")
def _(t):
    path = f"{shared_dir(t.spark)}/catalogue-{uuid.uuid4().hex}"
    px(t).repartition(2).write.parquet(path)
    return ts.list_datasets(t.spark, path).select("name", "size")


@query(
    "c20_roi_statistics",
    sql=f"""WITH {PX}, r AS (SELECT * FROM (VALUES ('a', 1, 5, 2, 6), ('b', 0, 8, 3, 4)) v(roi, y0, y1, x0, x1))
    SELECT frame_id, roi, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, sum(value) AS sum
    FROM px JOIN r ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY 1, 2""",
    rnd=["mean", "std", "min", "max", "sum"],
)
def _(t):
    rois = t.spark.createDataFrame([("a", 1, 5, 2, 6), ("b", 0, 8, 3, 4)], "roi string, y0 int, y1 int, x0 int, x1 int")
    return fr.roi_statistics(px(t), rois)


_A14 = ["mean", "std", "min", "max", "total", "coverage", "skewness", "kurtosis", "q25", "median", "q75"]


@query(
    "a14_frame_statistics",
    sql=f"""WITH {PX} SELECT frame_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, sum(value) AS total,
    count(*) FILTER (value <> 0) AS non_zero, avg((value <> 0)::INT) AS coverage,
    (avg(value**3) - 3*avg(value)*avg(value**2) + 2*avg(value)**3) / var_pop(value)**1.5 AS skewness, kurtosis_pop(value) AS kurtosis,
    quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM px GROUP BY 1""",
    rnd=_A14,
)
def _(t):
    return fr.frame_statistics(px(t))


@query(
    "a15_shape_statistics",
    sql=f"""WITH {PX} SELECT series_id, (avg(value**3) - 3*avg(value)*avg(value**2) + 2*avg(value)**3) / var_pop(value)**1.5 AS skewness, kurtosis_pop(value) AS kurtosis FROM px GROUP BY 1""",
    rnd=["skewness", "kurtosis"],
)
def _(t):
    return fr.frame_statistics(px(t), ["series_id"]).select("series_id", "skewness", "kurtosis")


@query(
    "a16_histogram_entropy",
    sql=f"""WITH {PX}, s AS (SELECT frame_id, min(value) AS lo, (max(value) - min(value)) / 50 AS w, count(*) AS n FROM px GROUP BY 1),
    b AS (SELECT frame_id, least(floor((value - lo) / w), 49) AS bin, count(*) / (any_value(n) * any_value(w)) AS d FROM px JOIN s USING (frame_id) GROUP BY 1, 2)
    SELECT frame_id, sum(-d * ln(d + 1e-10)) AS entropy FROM b GROUP BY 1""",
    rnd=["entropy"],
    digits=4,
)
def _(t):
    return fr.histogram_entropy(px(t))


@query("a17_axis_profile", sql=f"WITH {PX} SELECT frame_id, y, avg(value) AS mean, stddev_pop(value) AS std FROM px GROUP BY 1, 2", rnd=["mean", "std"])
def _(t):
    return fr.axis_profile(px(t), "y")


@query("a17_middle_profiles", sql=f"WITH {PX} SELECT frame_id, 'row' AS profile, x AS position, value FROM px WHERE y = 4 UNION ALL SELECT frame_id, 'column', y, value FROM px WHERE x = 4", rnd=["value"])
def _(t):
    return fr.middle_profiles(px(t), H, W)


@query("a18_block_deviation", sql=f"WITH {PX} SELECT frame_id, y, x, stddev_pop(value) OVER (PARTITION BY frame_id, y // 3, x // 3) AS block_std FROM px WHERE y < 6 AND x < 6", rnd=["block_std"])
def _(t):
    return fr.block_deviation(px(t), H, W, 3)


@query("a19_ecdf", sql=f"WITH {PX} SELECT frame_id, y, x, row_number() OVER (PARTITION BY frame_id ORDER BY value, y, x) / 64.0 AS ecdf FROM px", rnd=["ecdf"])
def _(t):
    return fr.ecdf(px(t)).select("frame_id", "y", "x", "ecdf")


_A20 = ["mean", "std", "min", "max", "snr"]


@query(
    "a20_step_history",
    sql=f"""WITH {PX}, st AS (SELECT 0 AS step, 'input' AS name, frame_id, value FROM px UNION ALL SELECT 1, 'scaled', frame_id, value * 2 FROM px UNION ALL SELECT 2, 'shifted', frame_id, value * 2 + 1 FROM px)
    SELECT frame_id, step, name, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, avg(value) / stddev_pop(value) AS snr FROM st GROUP BY 1, 2, 3""",
    rnd=_A20,
)
def _(t):
    steps = {"scaled": lambda d: d.withColumn("value", F.col("value") * 2), "shifted": lambda d: d.withColumn("value", F.col("value") + 1)}
    return fr.run_steps(px(t), steps)[1]


@query("a26_systematic_sample", sql=f"WITH {PX} SELECT frame_id, y, x, value FROM px WHERE (y * 8 + x) % 10 = 0", rnd=["value"])
def _(t):
    from lumenlog.operators.aggregates import systematic_sample

    return systematic_sample(px(t).drop("series_id"), F.col("y") * W + F.col("x"), 10)


@query("n1_dark_offset", sql=f"WITH {PX}, {DF} SELECT avg(d) AS offset FROM dk", rnd=["offset"])
def _(t):
    return fr.dark_offset(dark(t))


@query("n2_flat_gain", sql=f"WITH {PX}, {DF} SELECT avg(f) / 2 AS gain, min(f) AS offset FROM fl", rnd=["gain", "offset"])
def _(t):
    return fr.flat_gain(flat(t), 2.0)


_AUTO = f"""{PX}, {DF}, ca AS (SELECT frame_id, y, x, (value - (SELECT avg(d) FROM dk)) * (SELECT avg(f) FROM fl) / f AS value FROM px JOIN fl USING (y, x))"""


@value_query("n3_auto_calibrate", f"WITH {_AUTO} SELECT * FROM ca")
def _(t):
    return fr.auto_calibrate(px(t).drop("series_id"), dark(t), flat(t))


@value_query("n4_pixel_response", f"WITH {PX}, {DF} SELECT frame_id, y, x, (value - d) * CASE WHEN f > d THEN 1.5 / (f - d) ELSE 1 END AS value FROM px JOIN fl USING (y, x) JOIN dk USING (y, x)")
def _(t):
    return fr.apply_pixel_response(px(t).drop("series_id"), fr.pixel_response(flat(t), dark(t), 1.5))


@query("n5_calibration_pipeline")
def _(t):
    steps = {"auto": lambda d: fr.auto_calibrate(d, dark(t), flat(t)), "poly": lambda d: d.withColumn("value", fr.polynomial(F.col("value"), [0.1, 1.0, 0.0]))}
    return fr.run_steps(px(t).drop("series_id"), steps)[1]


def _mirror(c):
    return f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 7 THEN 15 - ({c}) ELSE {c} END"


def _gauss_sql(sigma, src="px", out="ga"):
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    k = ", ".join(f"({d - r}, {w / sum(raw)!r}::DOUBLE)" for d, w in enumerate(raw))
    return f"""kw{out} AS (SELECT * FROM (VALUES {k}) v(d, w)), tg{out} AS (SELECT t, w, {_mirror('t + d')} AS s FROM kw{out}, (SELECT unnest(range(8)) AS t)),
    c1{out} AS (SELECT frame_id, tg.t AS y, x, sum(value * w) AS value FROM {src} JOIN tg{out} tg ON tg.s = y GROUP BY 1, 2, 3),
    {out} AS (SELECT frame_id, y, tg.t AS x, sum(value * w) AS value FROM c1{out} JOIN tg{out} tg ON tg.s = x GROUP BY 1, 2, 3)"""


def _window_sql(r, border):
    pos = (lambda c: _mirror(c)) if border == "reflect" else (lambda c: c)
    return f"""nb AS (SELECT a.frame_id, a.y, a.x, a.value AS c, dy, dx, b.value FROM px a CROSS JOIN (SELECT unnest(range({-r}, {r + 1})) AS dy) CROSS JOIN (SELECT unnest(range({-r}, {r + 1})) AS dx)
    JOIN px b ON b.frame_id = a.frame_id AND b.y = {pos('a.y + dy')} AND b.x = {pos('a.x + dx')})"""


def _csv_folder(t, header: bool) -> str:
    """A CSV matrix for each label: a line of components per vector, in the order of the ids."""
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    rows = t.table("embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(H * W)])
    rows = rows.repartition("label").sortWithinPartitions("label", "vec_id").drop("vec_id")
    rows.write.partitionBy("label").option("header", header).csv(path)
    return path


_CSV = "(SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS y, embedding FROM embeddings), (SELECT unnest(range(64)) AS i)"


@query("s10_csv_frames", sql=f"SELECT y, i::INT AS x, embedding[i + 1]::DOUBLE AS value FROM {_CSV}")
def _(t):
    return fs.read_csv_frames(t.spark, _csv_folder(t, False), H * W).select("y", "x", "value")


@query("s10_csv_frames_with_header", sql=f"SELECT y, i::INT AS x, embedding[i + 1]::DOUBLE AS value FROM {_CSV}")
def _(t):
    return fs.read_csv_frames(t.spark, _csv_folder(t, True), header=True).select("y", "x", "value")


@query("s10_rejected_csv_rows", sql=f"SELECT count(*) AS rejected FROM {_CSV} WHERE i = 0")
def _(t):
    """All rows have another width than the one asked for."""
    return fs.rejected_csv_rows(t.spark, _csv_folder(t, False), H * W - 1).agg(F.count("*").alias("rejected"))


@value_query("n6_gaussian_filter", f"WITH {PX}, {_gauss_sql(1.0)} SELECT frame_id, y::INT AS y, x::INT AS x, value FROM ga")
def _(t):
    return fr.gaussian_filter(px(t), H, W, 1.0)


@value_query("n7_median_filter", f"WITH {PX}, {_window_sql(1, 'reflect')} SELECT frame_id, y, x, median(value) AS value FROM nb GROUP BY 1, 2, 3")
def _(t):
    return fr.median_filter(px(t), H, W)


_LAP = f"""lp AS (SELECT a.frame_id, a.y, a.x, sum(b.value * w) AS value FROM px a CROSS JOIN (SELECT * FROM (VALUES (-1,0,1),(1,0,1),(0,-1,1),(0,1,1),(0,0,-4)) v(dy, dx, w))
  JOIN px b ON b.frame_id = a.frame_id AND b.y = {_mirror('a.y + dy')} AND b.x = {_mirror('a.x + dx')} GROUP BY 1, 2, 3)"""


@value_query(
    "n8_wiener_filter",
    f"""WITH {PX}, {_LAP}, nv AS (SELECT frame_id, var_pop(value) / 6 AS noise FROM lp GROUP BY 1), {_window_sql(1, 'clip')},
    l AS (SELECT frame_id, y, x, any_value(c) AS c, sum(value) / 9 AS m, sum(value * value) / 9 - (sum(value) / 9) ** 2 AS v FROM nb GROUP BY 1, 2, 3)
    SELECT frame_id, y, x, CASE WHEN v < noise THEN m ELSE m + (c - m) * (1 - noise / v) END AS value FROM l JOIN nv USING (frame_id)""",
)
def _(t):
    return fr.wiener_filter(px(t), H, W, 3)


@value_query(
    "n9_bilateral_filter",
    f"""WITH {PX}, {_window_sql(1, 'clip')}, g AS (SELECT *, exp(-(dy * dy + dx * dx) / 2.0) * exp(-((value - c) ** 2) / (2 * 0.1 ** 2)) AS w FROM nb)
    SELECT frame_id, y, x, sum(w * value) / sum(w) AS value FROM g GROUP BY 1, 2, 3""",
)
def _(t):
    return fr.bilateral_filter(px(t), H, W)


_NM = f"{PX}, {_gauss_sql(2.0)}, nm AS (SELECT px.frame_id, px.series_id, px.y, px.x, px.value AS v, px.value - ga.value AS value FROM px JOIN ga ON px.frame_id = ga.frame_id AND px.y = ga.y AND px.x = ga.x)"


@value_query("n10_noise_map", f"WITH {_NM} SELECT frame_id, y, x, value FROM nm")
def _(t):
    return fr.noise_map(px(t).drop("series_id"), H, W)


@query("n11_laplacian_snr", sql=f"WITH {PX}, {_LAP} SELECT frame_id, 10 * log10(avg(px.value ** 2) / avg(lp.value ** 2)) AS snr_db FROM px JOIN lp USING (frame_id, y, x) GROUP BY 1", rnd=["snr_db"])
def _(t):
    return fr.laplacian_snr(px(t), H, W)


def _cand(name, sigma):
    return f"""SELECT px.frame_id, '{name}' AS candidate, 10 * log10(avg({name}.value ** 2) / avg((px.value - {name}.value) ** 2)) AS snr_db
    FROM px JOIN {name} ON px.frame_id = {name}.frame_id AND px.y = {name}.y AND px.x = {name}.x GROUP BY 1"""


@query(
    "n12_best_denoiser",
    sql=f"""WITH {PX}, {_gauss_sql(0.6, 'px', 'g1')}, {_gauss_sql(1.0, 'px', 'g2')}, c AS ({_cand('g1', 0.6)} UNION ALL {_cand('g2', 1.0)})
    SELECT frame_id, candidate, snr_db AS best_snr FROM c QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY snr_db DESC, candidate DESC) = 1""",
    rnd=["best_snr"],
)
def _(t):
    return fr.best_denoiser(px(t).drop("series_id"), {"g1": lambda d: fr.gaussian_filter(d, H, W, 0.6), "g2": lambda d: fr.gaussian_filter(d, H, W, 1.0)})


def _test(t):
    return px(t).drop("series_id").withColumn("value", F.col("value") * 0.9 + 0.01 * F.col("x"))


_PAIR = "pr AS (SELECT frame_id, y, x, value AS r, value * 0.9 + 0.01 * x AS t FROM px)"
_EM = ["mse", "rmse", "mae", "psnr", "nrmse", "mape", "correlation"]
_EMSQL = """avg((r - t) ** 2) AS mse, sqrt(avg((r - t) ** 2)) AS rmse, avg(abs(r - t)) AS mae, 20 * log10(greatest(max(r), max(t)) / sqrt(avg((r - t) ** 2))) AS psnr,
  sqrt(avg((r - t) ** 2)) / (max(r) - min(r)) AS nrmse, avg(abs((r - t) / r)) FILTER (r <> 0) * 100 AS mape, corr(r, t) AS correlation"""


@query("n13_error_metrics", sql=f"WITH {PX}, {_PAIR} SELECT frame_id, {_EMSQL} FROM pr GROUP BY 1", rnd=_EM)
def _(t):
    return fr.error_metrics(fr.pair_frames(px(t), _test(t)))


@query("n14_gaussian_snr", sql=f"WITH {_NM} SELECT frame_id, 10 * log10(avg(v ** 2) / avg(value ** 2)) AS snr_db FROM nm GROUP BY 1", rnd=["snr_db"])
def _(t):
    return fr.gaussian_snr(px(t), H, W)


_SSIM = """w AS (SELECT a.frame_id, a.y, a.x, avg(b.r) AS mx, avg(b.t) AS my, covar_samp(b.r, b.t) AS vxy, var_samp(b.r) AS vx, var_samp(b.t) AS vy FROM pr a JOIN pr b ON a.frame_id = b.frame_id
    AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 WHERE a.y BETWEEN 3 AND 4 AND a.x BETWEEN 3 AND 4 GROUP BY 1, 2, 3),
  rg AS (SELECT frame_id, (0.01 * (max(r) - min(r))) ** 2 AS c1, (0.03 * (max(r) - min(r))) ** 2 AS c2 FROM pr GROUP BY 1),
  ss AS (SELECT frame_id, avg((2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))) AS ssim FROM w JOIN rg USING (frame_id) GROUP BY 1)"""


@query("n15_ssim", sql=f"WITH {PX}, {_PAIR}, {_SSIM} SELECT frame_id, ssim FROM ss", rnd=["ssim"])
def _(t):
    return fr.ssim(fr.pair_frames(px(t), _test(t)), H, W)


@query("n16_dqe", sql=f"WITH {_NM} SELECT frame_id, var_pop(v) / var_pop(value) / 100 AS dqe FROM nm GROUP BY 1", rnd=["dqe"])
def _(t):
    return fr.dqe(px(t), fr.noise_map(px(t).drop("series_id"), H, W), 100.0)


@query(
    "n17_mtf",
    sql=f"""WITH {PX}, r AS (SELECT frame_id, x, CASE x WHEN 0 THEN lead(value) OVER w - value WHEN 7 THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS l
      FROM px WHERE y = 4 WINDOW w AS (PARTITION BY frame_id ORDER BY x)),
    m AS (SELECT frame_id, k, sqrt(sum(l * cos(2 * pi() * k * x / 8)) ** 2 + sum(l * sin(2 * pi() * k * x / 8)) ** 2) AS m FROM r, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2)
    SELECT frame_id, k::INT AS k, k / 8.0 AS frequency, m / first_value(m) OVER (PARTITION BY frame_id ORDER BY k) AS mtf FROM m""",
    rnd=["frequency", "mtf"],
    digits=4,
)
def _(t):
    return fr.mtf(px(t), H, W)


@query("n18_noise_power")
def _(t):
    return fr.noise_power(px(t), H, W)


_UNI = ["mean", "std", "min", "max", "range", "uniformity_percentage", "regional_uniformity_percentage"]
_UNISQL = """un AS (SELECT frame_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range,
    (1 - stddev_pop(value) / avg(value)) * 100 AS uniformity_percentage FROM ip GROUP BY 1),
  rgn AS (SELECT frame_id, (1 - stddev_pop(m) / avg(m)) * 100 AS regional_uniformity_percentage FROM (SELECT frame_id, y // 4 AS a, x // 4 AS b, avg(value) AS m FROM ip GROUP BY 1, 2, 3) GROUP BY 1)"""
_IP = "ip AS (SELECT frame_id, series_id, y, x, value + 2 AS value FROM px)"


def _lifted(t):
    return px(t).withColumn("value", F.col("value") + 2)


@query("n19_uniformity", sql=f"WITH {PX}, {_IP}, {_UNISQL} SELECT * FROM un JOIN rgn USING (frame_id)", rnd=_UNI)
def _(t):
    return fr.uniformity(_lifted(t), H, W)


_N20 = ["overall_mean", "overall_temporal_std", "stability_percentage", "max_temporal_variation", "mean_temporal_variation"]


@query(
    "n20_temporal_stability",
    sql=f"""WITH {PX}, {_IP}, p AS (SELECT series_id, y, x, avg(value) AS m, var_pop(value) AS v FROM ip GROUP BY 1, 2, 3)
    SELECT series_id, avg(m) AS overall_mean, sqrt(avg(v)) AS overall_temporal_std, (1 - sqrt(avg(v)) / avg(m)) * 100 AS stability_percentage,
      max(sqrt(v)) AS max_temporal_variation, avg(sqrt(v)) AS mean_temporal_variation FROM p GROUP BY 1""",
    rnd=_N20,
)
def _(t):
    return fr.temporal_stability(_lifted(t))


@query(
    "n21_temporal_drift",
    sql=f"""WITH {PX}, {_IP}, p AS (SELECT series_id, y, x, stddev_pop(value) / avg(value) AS c FROM ip GROUP BY 1, 2, 3), o AS (SELECT series_id, 1 - avg(c) AS overall_stability FROM p GROUP BY 1),
    f AS (SELECT series_id, frame_id, avg(value) AS m, row_number() OVER (PARTITION BY series_id ORDER BY frame_id) - 1 AS t FROM ip GROUP BY 1, 2)
    SELECT series_id, overall_stability, drift_slope FROM o JOIN (SELECT series_id, regr_slope(m, t) AS drift_slope FROM f GROUP BY 1) USING (series_id)""",
    rnd=["overall_stability", "drift_slope"],
    digits=8,
)
def _(t):
    return fr.temporal_drift(_lifted(t))


@query("n21_dominant_period")
def _(t):
    return fr.dominant_period(_lifted(t))


@query(
    "n22_shift_correlation",
    sql=f"""WITH {PX} SELECT a.frame_id, i::INT AS i, j::INT AS j, corr(a.value, b.value) AS correlation FROM px a CROSS JOIN (SELECT * FROM (VALUES (0, 1), (1, 0), (4, 5)) v(i, j))
    JOIN px b ON a.frame_id = b.frame_id AND b.y = (a.y + i) % 8 AND b.x = (a.x + j) % 8 GROUP BY 1, 2, 3""",
    rnd=["correlation"],
)
def _(t):
    return fr.shift_correlation(px(t), H, W, [(0, 1), (1, 0), (4, 5)])


@query(
    "n22_spatial_correlation",
    sql=f"""WITH {PX}, l AS (SELECT 4 AS i, 4 + k AS j FROM (SELECT unnest(range(4)) AS k) UNION SELECT 4 + k, 4 FROM (SELECT unnest(range(4)) AS k)),
    r AS (SELECT a.frame_id, i, j, corr(a.value, b.value) AS c FROM px a CROSS JOIN l JOIN px b ON a.frame_id = b.frame_id AND b.y = (a.y + i) % 8 AND b.x = (a.x + j) % 8 GROUP BY 1, 2, 3)
    SELECT frame_id, coalesce(min(j - 4) FILTER (i = 4 AND c < exp(-1)), 4)::INT AS correlation_length, avg(c) FILTER (i = 4) / avg(c) FILTER (j = 4) AS anisotropy_ratio FROM r GROUP BY 1""",
    rnd=["anisotropy_ratio"],
    digits=4,
)
def _(t):
    return fr.spatial_correlation(px(t), H, W)


@query(
    "n23_peaks_2d",
    sql=f"""WITH {PX}, {_window_sql(1, 'reflect')}, m AS (SELECT frame_id, y, x, any_value(c) AS value, max(value) AS mx FROM nb GROUP BY 1, 2, 3),
    l AS (SELECT frame_id, avg(value) + 2 * stddev_pop(value) AS lim FROM px GROUP BY 1) SELECT frame_id, y, x, value FROM m JOIN l USING (frame_id) WHERE value = mx AND value > lim""",
    rnd=["value"],
)
def _(t):
    return fr.peaks_2d(px(t), H, W)


@query(
    "n24_compare_signals",
    sql=f"""WITH {PX}, {_PAIR}, {_SSIM} SELECT 'scaled' AS name, frame_id, any_value(ssim) AS ssim, {_EMSQL}, avg(r - t) AS difference_mean, stddev_pop(r - t) AS difference_std,
    CASE WHEN any_value(ssim) > 0.8 THEN 'Good' ELSE 'Poor' END AS verdict FROM pr JOIN ss USING (frame_id) GROUP BY 2""",
    rnd=[*_EM, "ssim", "difference_mean", "difference_std"],
)
def _(t):
    tests = _test(t).withColumn("name", F.lit("scaled"))
    return fr.compare_signals(px(t), tests, H, W).drop("difference_min", "difference_max")


@query(
    "n25_rank_calibrations",
    sql=f"""WITH {PX}, {_PAIR}, {_SSIM}, q AS (SELECT frame_id, 0.4 * any_value(ssim) + 0.3 * least(20 * log10(greatest(max(r), max(t)) / sqrt(avg((r - t) ** 2))) / 50, 1) + 0.3 * corr(r, t) AS s FROM pr JOIN ss USING (frame_id) GROUP BY 1)
    SELECT 'scaled' AS name, avg(s) AS quality_score FROM q""",
    rnd=["quality_score"],
)
def _(t):
    done = _test(t).withColumn("name", F.lit("scaled"))
    raw = px(t).drop("series_id").withColumn("value", F.col("value") * 1.3)
    return fr.rank_calibrations(fr.compare_calibrations(raw, done, px(t), H, W))


@query(
    "n26_assess_detector",
    sql=f"""WITH {PX}, {_IP}, {_UNISQL}, {_gauss_sql(2.0, 'ip')}, sn AS (SELECT ip.frame_id, 10 * log10(avg(ip.value ** 2) / avg((ip.value - ga.value) ** 2)) AS snr_db FROM ip JOIN ga ON ip.frame_id = ga.frame_id AND ip.y = ga.y AND ip.x = ga.x GROUP BY 1),
    o AS (SELECT frame_id, snr_db, uniformity_percentage, (uniformity_percentage + least(snr_db / 30 * 100, 100)) / 2 AS overall_score FROM un JOIN sn USING (frame_id))
    SELECT frame_id, overall_score, CASE WHEN snr_db > 30 THEN 'Excellent' WHEN snr_db > 20 THEN 'Good' WHEN snr_db > 10 THEN 'Fair' ELSE 'Poor' END AS noise_quality,
      CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75 THEN 'Good' WHEN overall_score >= 60 THEN 'Fair' ELSE 'Poor' END AS quality_rating FROM o""",
    rnd=["overall_score"],
)
def _(t):
    return fr.assess_detector(_lifted(t).drop("series_id"), H, W).select("frame_id", "overall_score", "noise_quality", "quality_rating")


@query("n26_assess_calibration")
def _(t):
    raw = px(t).drop("series_id").withColumn("value", F.col("value") * 1.3)
    return fr.assess_calibration(raw, _test(t), px(t), H, W).select("frame_id", "overall_score", "quality_rating")


@query("x14_frame_run")
def _(t):
    raw = px(t).drop("series_id")
    steps = {"auto": lambda d: fr.auto_calibrate(d, dark(t), flat(t)), "gaussian": lambda d: fr.gaussian_filter(d, H, W, 1.0)}
    done, _ = fr.run_steps(raw, steps)
    return fr.all_metrics(raw, done, H, W)


CH = "ch AS (SELECT l_suppkey AS channel_id, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


def channels(t):
    return t.table("lineitem").select(F.col("l_suppkey").alias("channel_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


_K8 = ["slope", "intercept", "r_squared", "standard_error", "max_linearity_error", "mean_linearity_error", "rms_linearity_error"]


@query(
    "k8_linear_summary",
    sql=f"""WITH {CH}, f AS (SELECT channel_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared, count(*) AS n,
      sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / ((count(*) - 2) * regr_sxx(y, x))) AS standard_error FROM ch GROUP BY 1),
    e AS (SELECT channel_id, abs((y - (slope * x + intercept)) / (slope * x + intercept)) * 100 AS p FROM ch JOIN f USING (channel_id))
    SELECT f.*, max_linearity_error, mean_linearity_error, rms_linearity_error FROM f JOIN
      (SELECT channel_id, max(p) AS max_linearity_error, avg(p) AS mean_linearity_error, sqrt(avg(p * p)) AS rms_linearity_error FROM e GROUP BY 1) USING (channel_id)""",
    rnd=_K8,
    digits=4,
)
def _(t):
    return fit.linear_summary(channels(t)).drop("p_value")


_V1 = f"""{CH}, st AS (SELECT channel_id, avg(x) AS m, avg(y) AS my FROM ch GROUP BY 1), z AS (SELECT channel_id, x - m AS z, y - my AS y, m, my, y AS yy, x FROM ch JOIN st USING (channel_id)),
  s AS (SELECT channel_id, any_value(m) AS m, any_value(my) AS my, count(*) AS n, sum(z ** 2) AS s2, sum(z ** 3) AS s3, sum(z ** 4) AS s4, sum(z * y) AS zy, sum(z * z * y) AS zzy FROM z GROUP BY 1),
  q AS (SELECT *, (s2 * zzy - s3 * zy) / (s2 * (s4 - s2 * s2 / n) - s3 * s3) AS c2 FROM s), p AS (SELECT *, (zy - c2 * s3) / s2 AS c1 FROM q),
  k AS (SELECT channel_id, c2 AS a, c1 - 2 * c2 * m AS b, my - c2 * s2 / n - c1 * m + c2 * m * m AS c FROM p),
  er AS (SELECT channel_id, a, b, c, y, y - (a * x * x + b * x + c) AS e FROM ch JOIN k USING (channel_id))"""


@query(
    "v1_polynomial_fit",
    sql=f"WITH {_V1} SELECT channel_id, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, 1 - avg(e * e) / var_pop(y) AS r_squared, sqrt(avg(e * e)) AS rmse FROM er GROUP BY 1",
    rnd=["a", "b", "c", "r_squared", "rmse"],
    digits=3,
)
def _(t):
    out = fit.fit_quality(channels(t), fit.polynomial_fit(channels(t), 2))
    return out.select("channel_id", *[F.col("coefficients")[i].alias(n) for i, n in enumerate("abc")], "r_squared", "rmse")


@query(
    "v5_energy_calibration",
    sql=f"WITH {_V1} SELECT channel_id, max(abs(e / y)) AS max_energy_error, sqrt(avg((e / y) ** 2)) AS rms_energy_error FROM er GROUP BY 1",
    rnd=["max_energy_error", "rms_energy_error"],
)
def _(t):
    return fit.energy_calibration(channels(t)).select("channel_id", "max_energy_error", "rms_energy_error")


def _spectrum(t):
    from lumenlog.operators.aggregates import histogram

    h = histogram(t.events(), "value", 40, ["event"])
    return h.select(F.col("event").alias("channel_id"), (F.col("bin_start") + (F.col("bin_end") - F.col("bin_start")) / 2).alias("x"), F.col("count").cast("double").alias("y"))


@query("v2_gaussian_fit")
def _(t):
    return fit.curve_fit(_spectrum(t), "gaussian")


@query("v3_exponential_fit")
def _(t):
    return fit.curve_fit(_spectrum(t), "exponential")


@query("v4_sigmoid_fit")
def _(t):
    return fit.curve_fit(channels(t), "sigmoid")


@query(
    "k6_distribution_fit",
    sql="""WITH s AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, greatest((max(value) - min(value)) * 1e-3, 1e-12) AS shift FROM events),
      g AS (SELECT count(w) AS n, sum(w) AS sw, sum(ln(w)) AS sl, sum(w * ln(w)) AS swl FROM (SELECT value - lo + shift AS w FROM events, s)),
      h AS (SELECT *, (n * swl - sl * sw) / (n * n::DOUBLE) AS scale, sw / n / ((n * swl - sl * sw) / (n * n::DOUBLE)) AS shape FROM g)
    SELECT 'normal' AS distribution, 4 + n * (ln(2 * pi()) + 2 * ln(sd) + 1) AS aic FROM s UNION ALL SELECT 'exponential', 4 + 2 * n * (ln(m - lo) + 1) FROM s
    UNION ALL SELECT 'gamma', 6 - 2 * ((shape - 1) * sl - sw / scale - n * (lgamma(shape) + shape * ln(scale))) FROM h""",
    rnd=["aic"],
    digits=3,
)
def _(t):
    return fit.distribution_fit(t.events(), "value").select("distribution", "aic")


@query("k6_distribution_analysis")
def _(t):
    return fit.distribution_analysis(t.events(), "value")
