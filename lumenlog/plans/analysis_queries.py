"""Queries for sequence measures, correlation analysis and anomaly detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import anomaly as an
from lumenlog.operators import correlate as co
from lumenlog.operators import evaluate as ev
from lumenlog.operators import similarity as si
from lumenlog.plans.reconstruction_queries import _RE, _recon
from lumenlog.plans.registry import EV, GL, GLOBAL, US, USER, query

TYPES = ["click", "error", "purchase", "signup", "view"]

_MODE = """mo AS (SELECT user_id, event FROM (SELECT user_id, event, count(*) AS c FROM s GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event) = 1)"""


@query(
    "q1_basic_statistics",
    sql=f"""WITH {US}, {_MODE} SELECT user_id, count(*) AS length, count(DISTINCT s.event) AS unique_events, any_value(mo.event) AS most_common_event,
    count(DISTINCT s.event) / count(*)::DOUBLE AS event_diversity FROM s JOIN mo USING (user_id) GROUP BY 1""",
    rnd=["event_diversity"],
)
def _(t):
    return si.basic_statistics(t.log(), USER)


_ENT = """ct AS (SELECT user_id, event, count(*) AS c FROM s GROUP BY 1, 2), pp AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id)::DOUBLE AS p FROM ct),
  en AS (SELECT user_id, sum(-p * log2(p + 1e-10)) AS h2, sum(-p * ln(p + 1e-10)) AS h, count(*) AS k, sum(c) AS n FROM pp GROUP BY 1),
  tg AS (SELECT user_id, count(DISTINCT g) AS tri FROM (SELECT user_id, event || '|' || nxt || '|' || lead(event, 2) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM s) GROUP BY 1)"""


@query(
    "q2_complexity_metrics",
    sql=f"""WITH {US}, {_ENT} SELECT user_id, h2 AS entropy, log2(k) AS max_entropy, h2 / log2(k) AS normalized_entropy, n / tri::DOUBLE AS compression_ratio FROM en JOIN tg USING (user_id)""",
    rnd=["entropy", "max_entropy", "normalized_entropy", "compression_ratio"],
)
def _(t):
    return si.complexity_metrics(t.log(), USER)


_TR = "tr AS (SELECT user_id, event, nxt, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2, 3)"


@query(
    "q3_transition_analysis",
    sql=f"""WITH {US}, {_TR}, mc AS (SELECT user_id, event || '->' || nxt AS m FROM tr QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event || '->' || nxt) = 1)
    SELECT user_id, sum(n)::BIGINT AS total_transitions, count(*) AS unique_transitions, any_value(m) AS most_common_transition, count(*) / sum(n)::DOUBLE AS transition_diversity
    FROM tr JOIN mc USING (user_id) GROUP BY 1""",
    rnd=["transition_diversity"],
)
def _(t):
    return si.transition_analysis(t.log(), USER)


_RUN = """rr AS (SELECT user_id, run, count(*) AS c FROM (SELECT *, sum((prev IS DISTINCT FROM event)::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s) GROUP BY 1, 2)"""


@query(
    "q3_repetition_analysis",
    sql=f"""WITH {US}, {_RUN} SELECT user_id, count(*) FILTER (c > 1) AS total_repetitions, coalesce(avg(c) FILTER (c > 1), 0) AS avg_repetition_length,
    coalesce(max(c) FILTER (c > 1), 0) AS max_repetition_length FROM rr GROUP BY 1""",
    rnd=["avg_repetition_length"],
)
def _(t):
    return si.repetition_analysis(t.log(), USER)


_SE = """cd AS (SELECT user_id, pos, dense_rank() OVER (PARTITION BY user_id ORDER BY event) - 1 AS c FROM s),
  g AS (SELECT user_id, pos, c AS a, lead(c) OVER w AS b, lead(c, 2) OVER w AS d FROM cd WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
  tl AS (SELECT user_id, 0.2 * stddev_pop(c) AS tol FROM cd GROUP BY 1),
  ma AS (SELECT x.user_id, count(*) AS m FROM g x JOIN g y ON x.user_id = y.user_id AND x.pos < y.pos JOIN tl ON tl.user_id = x.user_id
    WHERE x.b IS NOT NULL AND y.b IS NOT NULL AND greatest(abs(x.a - y.a), abs(x.b - y.b)) <= tol GROUP BY 1),
  mb AS (SELECT x.user_id, count(*) AS m FROM g x JOIN g y ON x.user_id = y.user_id AND x.pos < y.pos JOIN tl ON tl.user_id = x.user_id
    WHERE x.d IS NOT NULL AND y.d IS NOT NULL AND greatest(abs(x.a - y.a), abs(x.b - y.b), abs(x.d - y.d)) <= tol GROUP BY 1)"""


@query(
    "q4_sample_entropy",
    sql=f"WITH {US}, {_SE} SELECT tl.user_id, coalesce(-ln(mb.m / ma.m::DOUBLE), 0) AS sample_entropy FROM tl LEFT JOIN ma ON ma.user_id = tl.user_id LEFT JOIN mb ON mb.user_id = tl.user_id",
    rnd=["sample_entropy"],
)
def _(t):
    return si.sample_entropy(t.log(), USER)


@query(
    "q4_sample_entropy_wide_tolerance",
    sql=f"WITH {US}, {_SE.replace('0.2 *', '0.9 *')} SELECT tl.user_id, coalesce(-ln(mb.m / ma.m::DOUBLE), 0) AS sample_entropy FROM tl LEFT JOIN ma ON ma.user_id = tl.user_id LEFT JOIN mb ON mb.user_id = tl.user_id",
    rnd=["sample_entropy"],
)
def _(t):
    return si.sample_entropy(t.log(), USER, r=0.9)


@query(
    "q5_sequence_complexity",
    sql=f"""WITH {US}, {_ENT}, {_TR}, tp AS (SELECT user_id, event, n / sum(n) OVER (PARTITION BY user_id, event)::DOUBLE AS p FROM tr),
    th AS (SELECT user_id, avg(h) AS a FROM (SELECT user_id, event, sum(-p * ln(p + 1e-10)) AS h FROM tp GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, h AS entropy, h / ln(k) AS normalized_entropy, a AS avg_transition_entropy FROM en JOIN th USING (user_id)""",
    rnd=["entropy", "normalized_entropy", "avg_transition_entropy"],
)
def _(t):
    return si.sequence_complexity(t.log(), USER)


def _lz_sql():
    parts = ["l1 AS MATERIALIZED (SELECT user_id, pos, n, event AS p FROM s)"]
    for d in range(1, 10):
        parts.append(f"f{d} AS MATERIALIZED (SELECT user_id, p, min(pos) AS pos FROM l{d} GROUP BY 1, 2)")
        parts.append(
            f"""l{d + 1} AS MATERIALIZED (SELECT l.user_id, l.pos, l.n, l.p || '|' || x.event AS p FROM l{d} l JOIN s x ON x.user_id = l.user_id AND x.pos = l.pos + {d}
            LEFT JOIN f{d} f ON f.user_id = l.user_id AND f.pos = l.pos WHERE f.pos IS NULL)"""
        )
    union = " UNION ALL ".join(f"SELECT user_id FROM f{d}" for d in range(1, 10))
    return f"""WITH {US}, {', '.join(parts)}, c AS (SELECT user_id, count(*) AS c FROM ({union}) GROUP BY 1)
    SELECT user_id, c.c / any_value(n)::DOUBLE AS lempel_ziv_complexity FROM s JOIN c USING (user_id) GROUP BY user_id, c.c"""


@query("q5_lempel_ziv", sql=_lz_sql(), rnd=["lempel_ziv_complexity"])
def _(t):
    return si.lempel_ziv(t.log(), USER)


@query("q6_lcs_length", sql=f"WITH {US}, {_RE} SELECT user_id, count(*) AS lcs, count(*) AS n1, (SELECT count(*) FROM re WHERE re.user_id = s.user_id) AS n2 FROM s GROUP BY 1")
def _(t):
    return ev.lcs_length(t.log(), _recon(t), USER)


@query(
    "q7_edit_distance",
    sql=f"""WITH {US}, {_RE}, m AS (SELECT user_id, string_agg(event[1], '' ORDER BY pos) AS a FROM s GROUP BY 1),
    k AS (SELECT user_id, string_agg(event[1], '' ORDER BY pos) AS b FROM s WHERE pos % 5 <> 2 GROUP BY 1)
    SELECT user_id, levenshtein(a, b)::INT AS edit_distance FROM m JOIN k USING (user_id)""",
)
def _(t):
    thinned = t.log().filter(F.col("_pos") % 5 != 2)
    return si.edit_distance(t.log(), thinned, USER, TYPES)


@query(
    "q8_compare_sequences",
    sql=f"""WITH {US}, {_RE}, a AS (SELECT user_id, event, count(*) AS a FROM s GROUP BY 1, 2), b AS (SELECT user_id, event, count(*) AS b FROM re GROUP BY 1, 2),
    x AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event = b.event)
    SELECT user_id, sum(a) / sum(b)::DOUBLE AS length_ratio, count(*) FILTER (a > 0 AND b > 0) / count(*)::DOUBLE AS event_overlap,
      sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))::DOUBLE AS cosine_similarity FROM x GROUP BY 1""",
    rnd=["length_ratio", "event_overlap", "cosine_similarity"],
)
def _(t):
    return si.compare_sequences(t.log(), _recon(t), USER)


@query(
    "q9_similar_subsequences",
    sql=f"""WITH {US}, w AS (SELECT user_id, pos, list_sort(list_distinct([event, nxt, lead(event, 2) OVER v, lead(event, 3) OVER v])) AS st FROM s
      WINDOW v AS (PARTITION BY user_id ORDER BY pos) QUALIFY pos + 4 < n),
    p AS (SELECT x.user_id, x.st AS a, y.st AS b FROM w x JOIN w y ON x.user_id = y.user_id AND y.pos >= x.pos + 4),
    j AS (SELECT user_id, least(array_to_string(a, '|'), array_to_string(b, '|')) AS set1, greatest(array_to_string(a, '|'), array_to_string(b, '|')) AS set2,
      len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS similarity FROM p)
    SELECT user_id, set1, set2, similarity, count(*) AS pairs FROM j WHERE similarity >= 0.6 GROUP BY 1, 2, 3, 4""",
    rnd=["similarity"],
)
def _(t):
    return si.similar_subsequences(t.log(), USER, 4, 0.6)


_LAGS = (1, 2, 3, 5, 10)


@query(
    "q10_gap_autocorrelation",
    sql=f"""WITH {US}, l AS (SELECT user_id, g0, {", ".join(f"lag(g0, {k}) OVER w AS l{k}" for k in _LAGS)} FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
    SELECT user_id, {", ".join(f"coalesce(CASE WHEN isnan(corr(l{k}, g0)) THEN 0 ELSE corr(l{k}, g0) END, 0) AS autocorr_lag_{k}" for k in _LAGS)} FROM l GROUP BY 1""",
    rnd=[f"autocorr_lag_{k}" for k in _LAGS],
)
def _(t):
    return si.gap_autocorrelation(t.log(), USER)


@query(
    "q11_dominant_frequency",
    sql=f"""WITH {US}, c AS (SELECT user_id, pos, n, g0 - avg(g0) OVER (PARTITION BY user_id) AS g FROM s),
    f AS (SELECT user_id, k, any_value(n) AS n, power(sum(g * cos(2 * pi() * k * pos / n)), 2) + power(sum(g * sin(2 * pi() * k * pos / n)), 2) AS pw
      FROM c, (SELECT unnest(range(1, 400)) AS k) WHERE k < n GROUP BY 1, 2),
    d AS (SELECT user_id, k, pw, pw / sum(pw) OVER (PARTITION BY user_id) AS st, n FROM f)
    SELECT user_id, k AS dominant_frequency, st AS periodicity_strength FROM d WHERE k < n // 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pw DESC) = 1""",
    rnd=["periodicity_strength"],
)
def _(t):
    return si.dominant_frequency(t.log(), USER)


@query(
    "x3_analyze_sequence",
    sql=f"""WITH {US}, {_ENT}, {_TR}, {_RUN}, tt AS (SELECT user_id, count(*) AS u FROM tr GROUP BY 1), rp AS (SELECT user_id, count(*) FILTER (c > 1) AS r FROM rr GROUP BY 1)
    SELECT user_id, n::BIGINT AS length, h2 AS entropy, u AS unique_transitions, r AS total_repetitions FROM en JOIN tt USING (user_id) JOIN rp USING (user_id)""",
    rnd=["entropy"],
)
def _(t):
    return si.analyze_sequence(t.log(), USER).select("user_id", "length", "entropy", "unique_transitions", "total_repetitions")


_K1 = """ty AS (SELECT DISTINCT event AS x FROM s), cm AS (SELECT a.x AS f, b.x AS t, coalesce(n, 0) AS n FROM ty a CROSS JOIN ty b LEFT JOIN
  (SELECT event, nxt, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2) q ON q.event = a.x AND q.nxt = b.x),
  ec AS (SELECT p.f AS event1, q.f AS event2, corr(p.n, q.n) AS correlation FROM cm p JOIN cm q ON p.t = q.t AND p.f <> q.f GROUP BY 1, 2)"""


@query(
    "k1_event_correlations",
    sql=f"WITH {GL}, {_K1} SELECT * FROM ec WHERE abs(correlation) > 0.1 ORDER BY abs(correlation) DESC, event1, event2",
    rnd=["correlation"],
)
def _(t):
    return co.event_correlations(t.log(GLOBAL), GLOBAL, 0.1, None)


_CODE = "cd AS (SELECT event, row_number() OVER (ORDER BY min((ts, event_id))) - 1 AS code FROM e GROUP BY 1)"


def _avg_rank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "k2_temporal_correlations",
    sql=f"""WITH {EV}, {_CODE}, r AS (SELECT {_avg_rank('code')} AS rc, {_avg_rank('hour(ts)')} AS rh, {_avg_rank('isodow(ts)')} AS rd FROM e JOIN cd USING (event))
    SELECT 'hour' AS feature, corr(rc, rh) AS correlation FROM r UNION ALL SELECT 'day_of_week', corr(rc, rd) FROM r""",
    rnd=["correlation"],
)
def _(t):
    return co.temporal_correlations(t.events(), GLOBAL).select("feature", "correlation")


@query("k2_temporal_correlations_p_values")
def _(t):
    return co.temporal_correlations(t.events(), GLOBAL)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]
_K3 = "cr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM lineitem" for a, b in _PAIRS) + ")"


@query("k3_feature_correlations", sql=f"WITH {_K3} SELECT * FROM cr", rnd=["correlation"])
def _(t):
    return co.feature_correlations(t.table("lineitem"), _NUM)


@query(
    "k3_mean_correlation",
    sql=f"WITH {_K3} SELECT count(*) AS pairs, count(*) FILTER (abs(correlation) > 0.8) AS high_pairs, avg(abs(correlation)) AS mean_abs_correlation FROM cr",
    rnd=["mean_abs_correlation"],
)
def _(t):
    return co.mean_correlation(co.feature_correlations(t.table("lineitem"), _NUM))


@query(
    "k4_cross_correlations",
    sql=f"""WITH {EV}, {_CODE} SELECT 'value' AS feature, corr(value, code) AS correlation FROM e JOIN cd USING (event) UNION ALL
    SELECT 'user_id', corr(user_id, code) FROM e JOIN cd USING (event)""",
    rnd=["correlation"],
)
def _(t):
    return co.cross_correlations(t.events(), GLOBAL, ["value", "user_id"]).select("feature", "correlation")


@query(
    "k5_lag_correlations",
    sql=f"""WITH {GL}, l AS (SELECT a.pos, b.pos - a.pos AS lag, a.event AS old, b.event AS cur FROM s a JOIN s b ON b.pos BETWEEN a.pos + 1 AND a.pos + 10)
    SELECT x.event, lag::INT AS lag, corr((old = x.event)::INT, (cur = x.event)::INT) AS correlation FROM l, (SELECT DISTINCT event FROM s) x GROUP BY 1, 2""",
    rnd=["correlation"],
)
def _(t):
    return co.lag_correlations(t.log(GLOBAL), GLOBAL)


@query(
    "x4_analyze_correlations",
    sql=f"""WITH {GL}, {_K1} SELECT 'event' AS analysis, count(*) AS rows FROM ec WHERE abs(correlation) > 0.5 UNION ALL SELECT 'cross', 2 UNION ALL SELECT 'temporal', 2""",
)
def _(t):
    found = co.analyze_correlations(t.log(GLOBAL), GLOBAL, ["value", "user_id"])
    out = None
    for name in ("event", "cross", "temporal"):
        row = found[name].agg(F.count("*").alias("rows")).withColumn("analysis", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "z1_stream_gap_anomalies",
    sql=f"""WITH {US}, q AS (SELECT user_id, quantile_cont(gap, 0.95) AS hi, quantile_cont(g0, 0.05) AS lo FROM s GROUP BY 1)
    SELECT event_id, coalesce(gap > hi, false) AS unusual_gap, g0 < lo AS rapid_succession FROM s JOIN q USING (user_id)""",
)
def _(t):
    return an.stream_gap_anomalies(t.log(), USER).select("event_id", "unusual_gap", "rapid_succession")


_Z2 = """q AS (SELECT user_id, quantile_cont(gap, 0.95) AS hi, quantile_cont(gap, 0.05) AS lo FROM s GROUP BY 1),
  z2 AS (SELECT s.*, coalesce(gap > hi, false) AS long_gap_anomaly, coalesce(gap < lo, false) AS short_gap_anomaly FROM s JOIN q USING (user_id))"""


@query("z2_temporal_anomalies", sql=f"WITH {US}, {_Z2} SELECT event_id, long_gap_anomaly, short_gap_anomaly FROM z2")
def _(t):
    return an.temporal_anomalies(t.log(), USER).select("event_id", "long_gap_anomaly", "short_gap_anomaly")


@query(
    "z3_sequence_anomalies",
    sql=f"""WITH {US} SELECT event_id, prev IS NOT NULL AND count(*) OVER (PARTITION BY user_id, prev, event) / (n - 1)::DOUBLE < 0.03 AS sequence_anomaly FROM s""",
)
def _(t):
    return an.sequence_anomalies(t.log(), USER, 0.03).select("event_id", "sequence_anomaly")


@query(
    "z4_zscore_anomalies",
    sql="""SELECT event_id, abs((value - avg(value) OVER ()) / stddev_pop(value) OVER ()) > 2.5 AS value_zscore_anomaly FROM events""",
)
def _(t):
    return an.zscore_anomalies(t.events(), ["value"], 2.5).select("event_id", "value_zscore_anomaly")


@query("z5_isolation_forest")
def _(t):
    out = an.isolation_forest(t.table("lineitem").withColumn("row_key", F.col("l_orderkey") * 10 + F.col("l_linenumber")), _NUM, "row_key")
    return out.select("l_orderkey", "l_linenumber", "isolation_score", "isolation_forest_anomaly")


_Z6 = f"""{US}, {_Z2}, z6 AS (SELECT event_id, event, long_gap_anomaly, short_gap_anomaly,
  prev IS NOT NULL AND count(*) OVER (PARTITION BY user_id, prev, event) / (n - 1)::DOUBLE < 0.01 AS sequence_anomaly,
  abs((value - avg(value) OVER ()) / stddev_pop(value) OVER ()) > 3 AS value_zscore_anomaly FROM z2)"""


@query(
    "z6_detect_anomalies_zscore",
    sql=f"WITH {_Z6} SELECT event_id, long_gap_anomaly OR short_gap_anomaly OR sequence_anomaly OR value_zscore_anomaly AS is_anomaly FROM z6",
)
def _(t):
    return an.detect_anomalies(t.log(), USER, ["value"], "zscore").select("event_id", "is_anomaly")


@query(
    "z6_anomaly_summary",
    sql=f"WITH {_Z6} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS count, avg({f}::INT) * 100 AS percentage FROM z6"
        for f in ("value_zscore_anomaly", "long_gap_anomaly", "short_gap_anomaly", "sequence_anomaly")
    ),
    rnd=["percentage"],
)
def _(t):
    found = an.detect_anomalies(t.log(), USER, ["value"], "zscore").drop("is_anomaly")
    return an.anomaly_summary(found)
