"""Queries for pattern mining and pattern evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.operators import patterns as pm
from lumenlog.plans.registry import GL, GLOBAL, US, USER, query


def _joined(df):
    return df.withColumn("pattern", F.array_join("pattern", "|"))


def _grams(keys, lengths):
    part = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    rows = []
    for k in lengths:
        parts = " || '|' || ".join(["event"] + [f"lead(event, {i}) OVER ({part}ORDER BY pos)" for i in range(1, k)])
        rows.append(f"SELECT {sel}pos, n, {k} AS length, {parts} AS pattern FROM s")
    return "gr AS (SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE pattern IS NOT NULL)"


_M1 = f"""{GL}, {_grams('', (2, 3, 4))}, fp AS (SELECT pattern, length, count(*) AS count, count(*) / (any_value(n) - length + 1)::DOUBLE AS support
  FROM gr GROUP BY 1, 2 HAVING count(*) >= floor(0.005 * (any_value(n) - length + 1)))"""


def _frequent(t):
    return pm.frequent_patterns(t.log(GLOBAL), GLOBAL, 0.005, 2, 4)


@query(
    "m1_frequent_patterns",
    sql=f"WITH {_M1} SELECT pattern, length, count, support, 'frequent' AS type FROM fp",
    rnd=["support"],
)
def _(t):
    return _joined(_frequent(t))


@query(
    "m1_frequent_patterns_by_user",
    sql=f"""WITH {US}, {_grams('user_id', (2, 3))} SELECT user_id, pattern, length, count(*) AS count, count(*) / (any_value(n) - length + 1)::DOUBLE AS support
    FROM gr GROUP BY 1, 2, 3 HAVING count(*) >= floor(0.05 * (any_value(n) - length + 1))""",
    rnd=["support"],
)
def _(t):
    return _joined(pm.frequent_patterns(t.log(), USER, 0.05, 2, 3)).drop("type")


@query(
    "m2_frequent_patterns_over_rows",
    sql=f"""WITH {GL}, {_grams('', (2, 3))} SELECT pattern, length, count(*) AS count, count(*) / any_value(n)::DOUBLE AS support
    FROM gr GROUP BY 1, 2 HAVING count(*) >= floor(0.008 * any_value(n))""",
    rnd=["support"],
)
def _(t):
    return _joined(pm.frequent_patterns(t.log(GLOBAL), GLOBAL, 0.008, 2, 3, "rows")).drop("type")


@query(
    "m3_gapped_patterns",
    sql=f"""WITH {GL} SELECT a.event || '|' || b.event || '|' || c.event AS pattern, count(*) AS count, count(*) / any_value(a.n)::DOUBLE AS support
    FROM s a JOIN s b ON b.pos BETWEEN a.pos + 1 AND a.pos + 5 JOIN s c ON c.pos BETWEEN b.pos + 1 AND b.pos + 5
    GROUP BY 1 HAVING count(*) >= floor(0.2 * any_value(a.n))""",
    rnd=["support"],
)
def _(t):
    return _joined(pm.gapped_patterns(t.log(GLOBAL), GLOBAL, 3, 5, 0.2)).select("pattern", "count", "support")


def _gapped_sql(base, keys, lengths, support):
    """Every length of gapped patterns of the rows ``s``, by occurrence."""
    sel, same = (f"{keys}, ", f"b.{keys} = a.{keys} AND ") if keys else ("", "")
    names, parts = "abcdef", []
    for k in lengths:
        joins = " ".join(f"JOIN s {y} ON {same.replace('b.', y + '.')}{y}.pos BETWEEN {x}.pos + 1 AND {x}.pos + 5" for x, y in zip(names, names[1:k]))
        text = " || '|' || ".join(f"{x}.event" for x in names[:k])
        own = f"a.{keys}, " if keys else ""
        parts.append(f"SELECT {own}{text} AS pattern, {k} AS length, count(*) AS count, any_value(a.n) AS n FROM s a {joins} WHERE a.n > {k} GROUP BY {own}pattern")
    return f"{base}, gp AS (SELECT {sel}pattern, length::INT AS length, count, count / n::DOUBLE AS support FROM ({' UNION ALL '.join(parts)}) WHERE count >= floor({support} * n))"


@query("m3_gapped_patterns_lengths", sql=f"WITH {_gapped_sql(GL, '', (2, 3, 4), 0.2)} SELECT pattern, length, count, support FROM gp", rnd=["support"])
def _(t):
    """Lengths two to four in one call."""
    return _joined(pm.gapped_patterns(t.log(GLOBAL), GLOBAL, 2, 5, 0.2, 4)).select("pattern", "length", "count", "support")


@query("m3_gapped_patterns_by_user", sql=f"WITH {_gapped_sql(US, 'user_id', (2, 3), 0.2)} SELECT user_id, pattern, length, count, support FROM gp", rnd=["support"])
def _(t):
    return _joined(pm.gapped_patterns(t.log(), USER, 2, 5, 0.2, 3)).select("user_id", "pattern", "length", "count", "support")


_M4 = f"""{GL}, {_grams('', (3,))}, sp AS (SELECT *, pos - lag(pos) OVER (PARTITION BY pattern ORDER BY pos) AS d FROM gr)"""


@query(
    "m4_motifs",
    sql=f"""WITH {_M4} SELECT pattern, count(*) AS count, avg(d) AS avg_spacing, stddev_pop(d) AS spacing_std FROM sp
    GROUP BY 1 HAVING count(*) >= greatest(2, floor(0.008 * any_value(n)))""",
    rnd=["avg_spacing", "spacing_std"],
)
def _(t):
    return _joined(pm.motifs(t.log(GLOBAL), GLOBAL, 3, 0.008)).select("pattern", "count", "avg_spacing", "spacing_std")


@query("m4_motif_positions", sql=f"WITH {_M4} SELECT pattern, pos, coalesce(d, -1) AS spacing FROM sp")
def _(t):
    out = _joined(pm.motif_positions(t.log(GLOBAL), GLOBAL, 3))
    return out.select("pattern", F.col("_pos").alias("pos"), F.coalesce("spacing", F.lit(-1)).alias("spacing"))


_M5 = """t0 AS (SELECT user_id, event, us, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY user_id, event) AS c,
      (us - lag(us) OVER w) / 1e6 AS iv FROM s WINDOW w AS (PARTITION BY user_id, event ORDER BY pos)),
    l AS (SELECT a.user_id, a.event, a.c, k, a.p, a.iv, b.iv AS lv FROM t0 a CROSS JOIN (SELECT unnest(range(2, 10)) AS k) LEFT JOIN t0 b
      ON a.user_id = b.user_id AND a.event = b.event AND b.p = a.p - k),
    g AS (SELECT user_id, event AS event_type, any_value(c) AS count, k AS period_multiplier,
      CASE WHEN stddev_pop(iv) FILTER (lv IS NOT NULL) > 0 AND stddev_pop(lv) FILTER (iv IS NOT NULL) > 0 THEN corr(lv, iv) END AS correlation,
      avg(iv) FILTER (p <= k) AS period_seconds FROM l GROUP BY 1, 2, 4),
    pe AS (SELECT user_id, event_type, count, period_multiplier, correlation, period_seconds FROM g
    WHERE count >= 3 AND period_multiplier < count - 1 AND correlation > 0.7)"""


@query(
    "m5_periodic_patterns",
    sql=f"WITH {US}, {_M5} SELECT * FROM pe",
    rnd=["correlation", "period_seconds"],
    digits=4,
)
def _(t):
    out = pm.periodic_patterns(t.log(), USER)
    return out.select("user_id", "event_type", "count", F.col("period_multiplier").cast("long"), "correlation", "period_seconds")


_M6 = """h AS (SELECT a.user_id, a.pos, a.event AS condition, b.event AS consequence, min(b.pos - a.pos) AS d FROM s a JOIN s b
      ON a.user_id = b.user_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 AND a.event <> b.event GROUP BY ALL),
    c AS (SELECT user_id, condition, consequence, d, count(*) AS c FROM h GROUP BY ALL),
    bd AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, condition, consequence ORDER BY c DESC, d) = 1),
    nc AS (SELECT user_id, event AS condition, count(*) AS total_conditions FROM s GROUP BY 1, 2),
    co AS (SELECT user_id, condition, consequence, c AS count, d AS best_distance, total_conditions, c / total_conditions::DOUBLE AS conditional_probability
    FROM bd JOIN nc USING (user_id, condition) WHERE total_conditions >= 2 AND c / total_conditions::DOUBLE > 0.3)"""


@query(
    "m6_conditional_patterns",
    sql=f"WITH {US}, {_M6} SELECT * FROM co",
    rnd=["conditional_probability"],
)
def _(t):
    return pm.conditional_patterns(t.log(), USER).drop("type")


@query(
    "m7_temporal_patterns",
    sql=f"""WITH {GL}, x AS (SELECT 'hourly' AS pattern_type, hour(ts)::INT AS time_value, event FROM s UNION ALL
      SELECT 'daily', (isodow(ts) - 1)::INT, event FROM s),
    c AS (SELECT pattern_type, time_value, event AS dominant_event, count(*) AS count, (sum(count(*)) OVER (PARTITION BY pattern_type, time_value))::BIGINT AS total_events FROM x GROUP BY 1, 2, 3)
    SELECT *, count / total_events::DOUBLE AS dominance_ratio, 'temporal' AS type FROM c WHERE total_events >= 5
    QUALIFY row_number() OVER (PARTITION BY pattern_type, time_value ORDER BY count DESC, dominant_event) = 1""",
    rnd=["dominance_ratio"],
)
def _(t):
    return pm.temporal_patterns(t.events(), GLOBAL)


@query(
    "m8_pattern_instances",
    sql=f"""WITH {US} SELECT user_id, pos AS start_index, pos + 1 AS end_index, us AS start_time, lead(us) OVER w AS end_time,
    (lead(us) OVER w - us) / 1e6 AS duration FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos) QUALIFY event = 'view' AND nxt = 'click'""",
    rnd=["duration"],
)
def _(t):
    out = pm.pattern_instances(t.log(), USER, ["view", "click"])
    return out.withColumns({c: F.unix_micros(c) for c in ("start_time", "end_time")})


@query(
    "c18_filter_patterns",
    sql=f"WITH {_M1} SELECT pattern, count FROM fp WHERE support >= 0.008 AND length <= 3",
)
def _(t):
    return _joined(pm.filter_patterns(_frequent(t), 0.008, 3, ["frequent"])).select("pattern", "count")


_M9 = f"""{_M1}, {_grams('', (3,)).replace('gr AS', 'g3 AS')}, mo AS (SELECT pattern, 3 AS length, count(*) AS count FROM g3 GROUP BY 1
  HAVING count(*) >= greatest(2, floor(0.0085 * any_value(n)))),
  al AS (SELECT pattern, length, count, support, 'frequent' AS type FROM fp UNION ALL SELECT pattern, length, count, NULL, 'motif' FROM mo)"""


def _mixed(t):
    return pm.union_patterns(_frequent(t), pm.motifs(t.log(GLOBAL), GLOBAL, 3, 0.0085))


@query(
    "m9_pattern_statistics",
    sql=f"""WITH {_M9} SELECT coalesce(type, 'all') AS type, count(*) AS total_patterns, avg(length) AS mean_length,
    coalesce(avg(support), -1) AS mean_support, coalesce(max(support), -1) AS max_support, count(DISTINCT pattern) AS unique_patterns
    FROM al GROUP BY ROLLUP (type)""",
    rnd=["mean_length", "mean_support", "max_support"],
)
def _(t):
    return pm.pattern_statistics(_mixed(t)).na.fill(-1.0, ["mean_support", "max_support"])


@query(
    "m10_compare_patterns",
    sql=f"""WITH {_M1}, a AS (SELECT DISTINCT pattern FROM fp), s2 AS (SELECT event, lead(event) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM e),
    b AS (SELECT event || '|' || nxt AS pattern FROM s2 WHERE nxt IS NOT NULL GROUP BY 1 HAVING count(*) >= 400),
    f AS (SELECT a.pattern AS pa, b.pattern AS pb FROM a FULL JOIN b ON a.pattern = b.pattern)
    SELECT count(pa) AS patterns1, count(pb) AS patterns2, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS common,
      count(*) FILTER (pb IS NULL) AS only1, count(*) FILTER (pa IS NULL) AS only2,
      count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) / count(*)::DOUBLE AS jaccard,
      count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) * 100 / count(*)::DOUBLE AS overlap_percent FROM f""",
    rnd=["jaccard", "overlap_percent"],
)
def _(t):
    from lumenlog.operators.aggregates import transition_matrix

    pairs = transition_matrix(t.log(), USER).groupBy("from_event", "to_event").agg(F.sum("n").alias("count"))
    second = pairs.filter(F.col("count") >= 400).select(F.array("from_event", "to_event").alias("pattern"))
    return pm.compare_patterns(_frequent(t), second)


@query(
    "m11_top_patterns",
    sql=f"""WITH {_M1} SELECT replace(pattern, '|', ' -> ') AS name, 'frequent' AS type, length, count, support AS measure FROM fp
    ORDER BY measure DESC, name LIMIT 10""",
    rnd=["measure"],
)
def _(t):
    return pm.top_patterns(_frequent(t), 10)


@query(
    "m12_pattern_nodes",
    sql=f"WITH {_M1} SELECT event, sum(support) AS weight FROM (SELECT unnest(string_split(pattern, '|')) AS event, support FROM fp) GROUP BY 1",
    rnd=["weight"],
)
def _(t):
    return pm.pattern_nodes(_frequent(t))


@query(
    "m12_pattern_edges",
    sql=f"""WITH {_M1}, x AS (SELECT string_split(pattern, '|') AS p, support, pattern, length FROM fp),
    i AS (SELECT p, support, pattern, unnest(range(1, length)) AS i FROM x),
    y AS (SELECT least(p[i], p[i + 1]) AS a, greatest(p[i], p[i + 1]) AS b, support, pattern FROM i)
    SELECT a, b, support AS weight FROM y QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY support, pattern DESC) = 1""",
    rnd=["weight"],
)
def _(t):
    return pm.pattern_edges(_frequent(t))


_QUAL = """qu AS (SELECT *, 0.4 * support + 0.2 * greatest(1 - abs(length - 5) / 5.0, 0) + 0.2 * least(length / 10.0, 1)
  + 0.2 * len(list_distinct(string_split(pattern, '|'))) / len(string_split(pattern, '|')) AS quality FROM fp)"""


@query("m13_pattern_quality", sql=f"WITH {_M1}, {_QUAL} SELECT pattern, quality, CASE WHEN quality < 0.3 THEN 'Low (0-0.3)' WHEN quality < 0.7 THEN 'Medium (0.3-0.7)' ELSE 'High (0.7-1.0)' END AS quality_band FROM qu", rnd=["quality"])
def _(t):
    return _joined(pm.pattern_quality(_frequent(t))).select("pattern", "quality", "quality_band")


_MET = """me AS (SELECT count(*) AS total_patterns, count(DISTINCT pattern) AS unique_patterns, avg(length) AS mean_length, median(length) AS median_length,
  avg(support) AS mean_support, median(support) AS median_support, stddev_pop(support) AS std_support, avg(quality) AS mean_quality,
  median(quality) AS median_quality, stddev_pop(quality) AS std_quality, count(*) FILTER (quality < 0.3) AS low_quality,
  (SELECT count(DISTINCT u) FROM (SELECT unnest(string_split(pattern, '|')) AS u FROM fp)) AS unique_events_covered,
  (SELECT sum(length) FROM fp) AS occ FROM qu)"""
_METCOLS = ["mean_length", "median_length", "mean_support", "median_support", "std_support", "mean_quality", "median_quality", "std_quality"]


@query(
    "m13_pattern_metrics",
    sql=f"""WITH {_M1}, {_QUAL}, {_MET} SELECT total_patterns, unique_patterns, {", ".join(_METCOLS)}, low_quality, unique_events_covered,
    unique_patterns / total_patterns::DOUBLE AS pattern_diversity, unique_events_covered / occ::DOUBLE AS event_diversity,
    unique_events_covered / total_patterns::DOUBLE AS avg_events_per_pattern FROM me""",
    rnd=[*_METCOLS, "pattern_diversity", "event_diversity", "avg_events_per_pattern"],
)
def _(t):
    return pm.pattern_metrics(_frequent(t)).select(
        "total_patterns", "unique_patterns", *_METCOLS, "low_quality", "unique_events_covered", "pattern_diversity", "event_diversity", "avg_events_per_pattern"
    )


_ACC = """ac AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (b IS NULL) AS fp_, count(*) FILTER (a IS NULL) AS fn_ FROM
  (SELECT DISTINCT pattern AS a FROM fp) x FULL JOIN (SELECT DISTINCT pattern AS b FROM gr WHERE length = 2) y ON a = b)"""


@query(
    "m14_pattern_accuracy",
    sql=f"""WITH {_M1}, {_ACC} SELECT tp AS true_positives, fp_ AS false_positives, fn_ AS false_negatives, tp / (tp + fp_)::DOUBLE AS precision,
    tp / (tp + fn_)::DOUBLE AS recall, 2 * tp / (2 * tp + fp_ + fn_)::DOUBLE AS f1_score, tp / (tp + fp_ + fn_)::DOUBLE AS accuracy FROM ac""",
    rnd=["precision", "recall", "f1_score", "accuracy"],
)
def _(t):
    return pm.pattern_accuracy(_frequent(t), pm.ngram_rows(t.log(GLOBAL), GLOBAL, 2, 2))


@query(
    "m15_compare_pattern_methods",
    sql=f"""WITH {_M1}, {_QUAL}, {_MET}, {_ACC} SELECT 'frequent' AS method, 0.3 * unique_patterns / total_patterns::DOUBLE + 0.3 * mean_quality
      + 0.2 * least(unique_events_covered / total_patterns::DOUBLE / 5, 1) + 0.2 * 2 * tp / (2 * tp + fp_ + fn_)::DOUBLE AS overall_score FROM me, ac""",
    rnd=["overall_score"],
)
def _(t):
    truth = pm.ngram_rows(t.log(GLOBAL), GLOBAL, 2, 2)
    return pm.compare_pattern_methods({"frequent": _frequent(t)}, truth).select("method", "overall_score")


@query(
    "x8_pattern_evaluation",
    sql=f"""WITH {_M1}, {_QUAL}, {_MET}, {_ACC} SELECT total_patterns, mean_quality, 2 * tp / (2 * tp + fp_ + fn_)::DOUBLE AS f1_score FROM me, ac""",
    rnd=["mean_quality", "f1_score"],
)
def _(t):
    out = pm.pattern_evaluation(_frequent(t), pm.ngram_rows(t.log(GLOBAL), GLOBAL, 2, 2))
    return out.select("total_patterns", "mean_quality", "f1_score")


_X2 = f"""{_gapped_sql(US, 'user_id', (2, 3), 0.05)}, {_grams('user_id', (2, 3))},
  fp AS (SELECT user_id, pattern FROM gr WHERE n > length GROUP BY user_id, pattern, length, n HAVING count(*) >= floor(0.05 * (n - length + 1))),
  mo AS (SELECT user_id, pattern FROM gr WHERE length = 3 GROUP BY user_id, pattern, n HAVING count(*) >= greatest(2, floor(0.02 * n))), {_M5}, {_M6},
  tm AS (SELECT user_id, 'hourly', hour(ts) FROM s GROUP BY ALL HAVING count(*) >= 5 UNION ALL SELECT user_id, 'daily', isodow(ts) FROM s GROUP BY ALL HAVING count(*) >= 5)"""
_FAMILIES = {"frequent": "fp", "sequential": "gp", "motifs": "mo", "periodic": "pe", "conditional": "co", "temporal": "tm"}


@query("x2_detect_patterns", sql=f"WITH {_X2} " + " UNION ALL ".join(f"SELECT '{n}' AS family, user_id, count(*) AS patterns FROM {c} GROUP BY user_id" for n, c in _FAMILIES.items()))
def _(t):
    """How many patterns of each of the six families a user has."""
    found = pm.detect_patterns(t.log(), USER, min_support=0.05, min_length=2, max_length=3)
    out = None
    for name, df in found.items():
        rows = df.groupBy("user_id").agg(F.count("*").alias("patterns")).withColumn("family", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
