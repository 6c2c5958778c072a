"""Queries for event reconstruction and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlog.functions.seq import index_sequence
from lumenlog.operators import aggregates as ag
from lumenlog.operators import evaluate as ev
from lumenlog.operators import reconstruct as rc
from lumenlog.operators import sequence_features as sf
from lumenlog.plans.registry import EV, GL, GLOBAL, US, USER, query

RULE = ["view", "click", "purchase"]
PAIRS = [("signup", "purchase"), ("view", "click")]
PERIODIC = {"view": 21600.0}
JUMPS = [("view", "purchase", "click")]
IMPOSSIBLE = [("purchase", "signup", "view"), ("error", "purchase", "click")]
RULES = {"sequences": [RULE], "pairs": PAIRS, "periodic": PERIODIC, "transitions": IMPOSSIBLE}


def _us(df):
    return df.withColumn("ts", F.unix_micros("ts"))


_R1 = """w3 AS (SELECT user_id, pos, n, event AS e0, us AS t0, nxt AS e1, lead(us) OVER w AS t1, lead(event, 2) OVER w AS e2, lead(us, 2) OVER w AS t2
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
  m0 AS (SELECT *, t0 + (t1 - t0) // 2 AS mid FROM w3 WHERE e0 = 'view' AND pos + 3 <= n AND NOT (e1 = 'click' AND e2 = 'purchase')),
  r1 AS (SELECT user_id, pos, 'click' AS event, mid AS expected_us FROM m0 WHERE e1 <> 'click'
    UNION ALL SELECT user_id, pos, 'purchase', t1 + (t2 - t1) // 2 FROM m0 WHERE e1 = 'click' AND e2 <> 'purchase'
    UNION ALL SELECT user_id, pos, 'purchase', mid + (t1 - mid) // 2 FROM m0 WHERE e1 <> 'click' AND e1 <> 'purchase')"""


@query("r1_missing_sequence_events", sql=f"WITH {US}, {_R1} SELECT user_id, pos, event, expected_us FROM r1")
def _(t):
    return rc.missing_sequence_events(t.log(), USER, [RULE]).withColumnRenamed("_pos", "pos")


@query(
    "r2_fill_sequence_events",
    sql=f"""WITH {US}, {_R1} SELECT user_id, expected_us AS ts, event, 'rule_based_sequence' AS reconstruction_method, 0.8::DOUBLE AS reconstruction_confidence FROM r1
    UNION ALL SELECT user_id, us, event, 'original', 1.0 FROM s""",
)
def _(t):
    out = rc.fill(t.log(), rc.fill_sequence_events(t.log(), USER, [RULE]))
    return _us(out.select("user_id", "ts", "event", rc.METHOD, rc.CONFIDENCE))


def _pair_sql():
    parts = []
    for a, b in PAIRS:
        parts.append(
            f"""SELECT user_id, '{a}' AS start_event, '{b}' AS end_event,
            greatest(count(*) FILTER (event = '{a}') - count(*) FILTER (event = '{b}'), 0) AS unmatched_starts,
            greatest(count(*) FILTER (event = '{b}') - count(*) FILTER (event = '{a}'), 0) AS unmatched_ends,
            max(us) FILTER (event = '{a}') AS last_start_us FROM e GROUP BY 1"""
        )
    return "pr AS (" + " UNION ALL ".join(parts) + ")"


@query(
    "r3_unmatched_pairs",
    sql=f"WITH {EV}, {_pair_sql()} SELECT user_id, start_event, end_event, unmatched_starts, unmatched_ends, coalesce(last_start_us, 0) AS last_start_us FROM pr",
)
def _(t):
    return rc.unmatched_pairs(t.events(), USER, PAIRS).withColumn("last_start_us", F.coalesce("last_start_us", F.lit(0)))


@query(
    "r4_fill_pair_events",
    sql=f"WITH {EV}, {_pair_sql()} SELECT user_id, last_start_us + 1800000000 AS ts, end_event AS event FROM pr WHERE unmatched_starts > 0",
)
def _(t):
    return _us(rc.fill_pair_events(t.events(), USER, PAIRS).select("user_id", "ts", "event"))


_R5 = """b5 AS (SELECT user_id, us AS start_us, lead(us) OVER (PARTITION BY user_id ORDER BY pos) AS end_us FROM s WHERE event = 'view'),
  r5 AS (SELECT *, (floor((end_us - start_us) / 1e6 / 21600.0) - 1)::BIGINT AS missing_count FROM b5 WHERE floor((end_us - start_us) / 1e6 / 21600.0) > 1)"""


@query("r5_missing_periodic_events", sql=f"WITH {US}, {_R5} SELECT user_id, 'view' AS event, start_us, end_us, missing_count FROM r5")
def _(t):
    return rc.missing_periodic_events(t.log(), USER, PERIODIC)


@query(
    "r6_fill_periodic_events",
    sql=f"""WITH {US}, {_R5}, x AS (SELECT *, unnest(generate_series(1, missing_count)) AS i FROM r5)
    SELECT user_id, start_us + ((end_us - start_us) * i) // (missing_count + 1) AS ts, 'view' AS event FROM x""",
)
def _(t):
    return _us(rc.fill_periodic_events(t.log(), USER, PERIODIC).select("user_id", "ts", "event"))


@query(
    "r7_insert_direct_jumps",
    sql=f"""WITH {US} SELECT user_id, us + (lead(us) OVER w - us) // 2 AS ts, 'click' AS event, 'sequence_correction' AS reconstruction_method
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos) QUALIFY event = 'view' AND nxt = 'purchase'""",
)
def _(t):
    return _us(rc.insert_direct_jumps(t.log(), USER, JUMPS).select("user_id", "ts", "event", rc.METHOD))


@query(
    "r8_insert_impossible_transitions",
    sql=f"""WITH {US} SELECT user_id, us + (lead(us) OVER w - us) // 2 AS ts, CASE event WHEN 'purchase' THEN 'view' ELSE 'click' END AS event, 0.7::DOUBLE AS reconstruction_confidence
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos) QUALIFY (event = 'purchase' AND nxt = 'signup') OR (event = 'error' AND nxt = 'purchase')""",
)
def _(t):
    return _us(rc.insert_impossible_transitions(t.log(), USER, IMPOSSIBLE).select("user_id", "ts", "event", rc.CONFIDENCE))


_R9 = """gm AS (SELECT user_id, event AS prev, CASE WHEN count(*) = 1 THEN 60 ELSE avg(tg) END AS mean, CASE WHEN count(*) = 1 THEN 30 ELSE stddev_samp(tg) END AS sd
    FROM (SELECT *, (us - lag(us) OVER (PARTITION BY user_id, event ORDER BY pos)) / 1e6 AS tg FROM s) GROUP BY 1, 2),
  z AS (SELECT s.*, gap AS gap_size, CASE WHEN sd > 0 THEN (gap - mean) / sd ELSE 0 END AS z_score,
    CASE WHEN mean > 0 THEN least(greatest(floor(gap / mean) - 1, 0), 5) ELSE 1 END::INT AS num_events FROM s JOIN gm USING (user_id, prev) WHERE s.prev IS NOT NULL)"""


@query(
    "r9_significant_gaps",
    sql=f"WITH {US}, {_R9} SELECT event_id, gap_size, z_score, abs(z_score) > 0.5 AS is_significant FROM z",
    rnd=["gap_size", "z_score"],
)
def _(t):
    log = t.log()
    out = rc.significant_gaps(log, USER, ag.gap_model(log, USER), threshold=0.5).filter(F.col("gap_size").isNotNull())
    return out.select("event_id", "gap_size", "z_score", "is_significant")


@query("r10_num_events", sql=f"WITH {US}, {_R9} SELECT event_id, num_events FROM z")
def _(t):
    log = t.log()
    out = rc.significant_gaps(log, USER, ag.gap_model(log, USER)).filter(F.col("gap_size").isNotNull())
    return out.select("event_id", "num_events")


def _markov_sql(base, steps):
    """One CTE per inserted step: the heaviest successor, the true next event's weight doubled."""
    out = [
        f"""{base}, mk AS (SELECT prev AS st, event AS nx, (count(*) + 0.1) / (sum(count(*)) OVER (PARTITION BY prev) + 0.1 * count(*) OVER (PARTITION BY prev))::DOUBLE AS p
        FROM s WHERE prev IS NOT NULL GROUP BY 1, 2),
        k0 AS (SELECT event_id, prev_us, us, event AS tru, prev AS st, num_events AS m FROM zz WHERE abs(z_score) > 0.5 AND num_events > 0)"""
    ]
    for i in range(1, steps + 1):
        out.append(
            f"""k{i} AS (SELECT k.event_id, k.prev_us, k.us, k.tru, mk.nx AS st, k.m, mk.p AS conf FROM k{i - 1} k JOIN mk ON mk.st = k.st
            QUALIFY row_number() OVER (PARTITION BY k.event_id ORDER BY CASE WHEN mk.nx = k.tru THEN least(mk.p * 2, 1.0) ELSE mk.p END DESC, mk.nx) = 1)"""
        )
    return ", ".join(out)


_R11B = GL + ", " + _R9.replace("avg(tg)", "avg(tg) / 10").replace("stddev_samp(tg)", "stddev_samp(tg) / 10").replace("user_id, event", "event").replace("PARTITION BY user_id, event", "PARTITION BY event").replace(
    "GROUP BY 1, 2", "GROUP BY 1").replace("USING (user_id, prev)", "USING (prev)") + """,
  zz AS (SELECT z.*, l.pu AS prev_us FROM z JOIN (SELECT event_id, lag(us) OVER (ORDER BY pos) AS pu FROM s) l USING (event_id))"""


def _tenth(model):
    """A tenth of the same-type gaps as the expected gap, so that gaps hold several events."""
    return model.withColumns({"mean": F.col("mean") / 10, "std": F.col("std") / 10})


@query(
    "r11_markov_fill_argmax",
    sql=f"WITH {_markov_sql(_R11B, 5)} "
    + " UNION ALL ".join(
        f"SELECT prev_us + (us - prev_us) * {i} // (m + 1) AS ts, st AS event, conf AS reconstruction_confidence FROM k{i} WHERE m >= {i}" for i in range(1, 6)
    ),
    rnd=["reconstruction_confidence"],
)
def _(t):
    log = t.log(GLOBAL)
    models = rc.train_models(log, GLOBAL)
    gaps = rc.significant_gaps(log, GLOBAL, _tenth(models["gaps"]), threshold=0.5)
    out = rc.markov_fill(log, GLOBAL, models["markov"], models["probabilities"], gaps, mode="argmax")
    return _us(out.select("ts", "event", rc.CONFIDENCE))


@query("r11_markov_fill_sampled")
def _(t):
    log = t.log()
    models = rc.train_models(log, USER)
    gaps = rc.significant_gaps(log, USER, _tenth(models["gaps"]))
    out = rc.markov_fill(log, USER, models["markov"], models["probabilities"], gaps)
    return _us(out.select("user_id", "ts", "event", rc.METHOD, rc.CONFIDENCE))


_R12 = """mk AS (SELECT prev AS a, event AS b, (count(*) + 0.1) / (sum(count(*)) OVER (PARTITION BY prev) + 0.1 * count(*) OVER (PARTITION BY prev))::DOUBLE AS p
    FROM s WHERE prev IS NOT NULL GROUP BY 1, 2),
  ty AS (SELECT DISTINCT event AS x FROM s),
  sc AS (SELECT a.x AS a, c.x AS c, m.x AS m, coalesce(p1.p, 0.1) * coalesce(p2.p, 0.1) AS p FROM ty a CROSS JOIN ty c CROSS JOIN ty m
    LEFT JOIN mk p1 ON p1.a = a.x AND p1.b = m.x LEFT JOIN mk p2 ON p2.a = m.x AND p2.b = c.x),
  be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY a, c ORDER BY p DESC, m) = 1)"""


@query(
    "r12_optimize_sequence_once",
    sql=f"""WITH {GL}, {_R12} SELECT s.event_id, CASE WHEN be.p > sc.p * 1.05 THEN be.m ELSE s.event END AS optimized_event FROM s
    LEFT JOIN be ON be.a = s.prev AND be.c = s.nxt LEFT JOIN sc ON sc.a = s.prev AND sc.c = s.nxt AND sc.m = s.event""",
)
def _(t):
    log = t.log(GLOBAL)
    m = rc.train_models(log, GLOBAL)
    return rc.optimize_sequence_once(log, GLOBAL, m["markov"], m["probabilities"], factor=1.05).select("event_id", "optimized_event")


@query(
    "r12_optimize_sequence",
    sql=f"""WITH RECURSIVE {GL}, {_R12}, bj AS MATERIALIZED (SELECT be.a, be.c, sc.m AS b, CASE WHEN be.p > sc.p * 1.05 THEN be.m ELSE sc.m END AS r FROM be JOIN sc USING (a, c)),
    ss AS MATERIALIZED (SELECT pos, event_id, event, nxt FROM s),
    w AS (SELECT pos, event_id, event AS o FROM ss WHERE pos = 0
      UNION ALL SELECT ss.pos, ss.event_id, CASE WHEN ss.nxt IS NULL THEN ss.event ELSE bj.r END FROM w JOIN ss ON ss.pos = w.pos + 1
        LEFT JOIN bj ON bj.a = w.o AND bj.c = ss.nxt AND bj.b = ss.event)
    SELECT event_id, o AS optimized_event FROM w""",
)
def _(t):
    log = t.log(GLOBAL)
    m = rc.train_models(log, GLOBAL)
    return rc.optimize_sequence(log, GLOBAL, m["markov"], m["probabilities"], factor=1.05).select("event_id", "optimized_event")


def _recon(t):
    """A reconstruction with rule rows, stored once per session for the evaluation queries."""
    log = t.log()
    filled = rc.with_insert_order(rc.fill(log, rc.insert_direct_jumps(log, USER, JUMPS), rc.insert_impossible_transitions(log, USER, IMPOSSIBLE)), USER)
    return t.indexed("recon", filled, USER)


_RE = """ins AS (SELECT user_id, us + (lead(us) OVER w - us) // 2 AS us, CASE WHEN event = 'view' THEN 'click' WHEN event = 'purchase' THEN 'view' ELSE 'click' END AS event,
    CASE WHEN event = 'view' THEN 1.0 ELSE 0.7 END AS conf, CASE WHEN event = 'view' THEN 'sequence_correction' ELSE 'impossible_transition' END AS method
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)
    QUALIFY (event = 'view' AND nxt = 'purchase') OR (event = 'purchase' AND nxt = 'signup') OR (event = 'error' AND nxt = 'purchase')),
  re AS (SELECT user_id, us, event, conf, method FROM ins UNION ALL SELECT user_id, us, event, 1.0, 'original' FROM s),
  rs AS (SELECT *, lead(event) OVER v AS nxt, (us - lag(us) OVER v) / 1e6 AS gap, row_number() OVER v - 1 AS pos FROM re WINDOW v AS (PARTITION BY user_id ORDER BY us))"""


@query("r13_confidence_scores", sql=f"WITH {US}, {_RE} SELECT user_id, us AS ts, event, conf::DOUBLE AS reconstruction_confidence FROM re")
def _(t):
    return _us(rc.as_original(_recon(t)).select("user_id", "ts", "event", rc.CONFIDENCE))


@query("a13_confidence_by_event", sql=f"WITH {US}, {_RE} SELECT event, count(*) AS count, avg(conf) AS mean_confidence FROM re GROUP BY 1", rnd=["mean_confidence"])
def _(t):
    return ag.confidence_by(_recon(t), "event")


@query("a13_confidence_by_method", sql=f"WITH {US}, {_RE} SELECT method AS reconstruction_method, count(*) AS count, avg(conf) AS mean_confidence FROM re GROUP BY 1", rnd=["mean_confidence"])
def _(t):
    return ag.confidence_by(_recon(t), rc.METHOD)


@query("r14_hybrid")
def _(t):
    out = rc.reconstruct_hybrid(t.log(), USER, **RULES)
    return _us(out.select("user_id", "ts", "event", rc.METHOD, rc.CONFIDENCE))


@query("r15_rule_based")
def _(t):
    out = rc.reconstruct_events(t.log(), USER, "rule_based", **RULES)
    return _us(out.select("user_id", "ts", "event", rc.METHOD, rc.CONFIDENCE))


@query("x6_rule_insertions", sql=f"""WITH {US}, {_R1}, {_R5}, {_pair_sql()} SELECT 'rule_based_sequence' AS reconstruction_method, count(*) AS rows FROM r1
    UNION ALL SELECT 'rule_based_pair', count(*) FROM pr WHERE unmatched_starts > 0 UNION ALL SELECT 'rule_based_periodic', sum(missing_count)::BIGINT FROM r5""")
def _(t):
    log = t.log()
    rows = rc.fill_sequence_events(log, USER, [RULE]).unionByName(rc.fill_pair_events(log, USER, PAIRS)).unionByName(rc.fill_periodic_events(log, USER, PERIODIC))
    return rows.groupBy(rc.METHOD).agg(F.count("*").alias("rows"))


@query(
    "r16_correct_sequence_errors",
    sql=f"""WITH {EV}, h AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, us // 1000 AS ms FROM e),
    q AS (SELECT event_id, event, pos, max(ms - pos) OVER (ORDER BY pos) + pos AS ms FROM h),
    n AS (SELECT *, lead(event) OVER (ORDER BY pos) AS nx, lead(ms) OVER (ORDER BY pos) AS nms FROM q)
    SELECT ms * 1000 AS ts, event, 'original' AS reconstruction_method FROM n
    UNION ALL SELECT ms * 1000 + (nms - ms) * 1000 // 2, 'click', 'sequence_correction' FROM n WHERE event = 'view' AND nx = 'purchase'""",
)
def _(t):
    out = rc.correct_sequence_errors(t.log(GLOBAL), GLOBAL, JUMPS)
    return _us(out.select("ts", "event", rc.METHOD))


@query(
    "r17_reconstruction_counts",
    sql=f"""WITH {US}, {_RE} SELECT 'rules' AS method, (SELECT count(*) FROM s) AS original_count, (SELECT count(*) FROM re) AS reconstructed_count,
    (SELECT count(*) FROM ins) AS added_count, (SELECT count(*) FROM re) / (SELECT count(*) FROM s)::DOUBLE AS ratio""",
    rnd=["ratio"],
)
def _(t):
    return ev.reconstruction_counts(t.events(), _recon(t), "rules")


@query(
    "r18_validate_reconstruction",
    sql=f"""WITH {US}, {_RE} SELECT (SELECT count(*) FROM s) AS original_events, (SELECT count(*) FROM re) AS reconstructed_events,
    (SELECT count(*) FROM s WHERE us IN (SELECT us FROM re)) AS events_preserved, (SELECT count(*) FROM ins) AS new_events, true AS time_range_preserved,
    true AS event_types_preserved, 1.0::DOUBLE AS preservation_rate, (SELECT count(*) FROM rs WHERE event = 'view' AND nxt = 'purchase') = 0 AS is_logically_consistent""",
)
def _(t):
    return ev.validate_reconstruction(t.log(), _recon(t), USER, [("view", "purchase")])


_TYPES = """ty AS (SELECT coalesce(a.event, b.event) AS event, a.c AS ca, b.c AS cb FROM (SELECT event, count(*) AS c FROM s GROUP BY 1) a
  FULL JOIN (SELECT event, count(*) AS c FROM re GROUP BY 1) b ON a.event = b.event)"""


@query(
    "r19_basic_metrics",
    sql=f"""WITH {US}, {_RE}, {_TYPES} SELECT sum(ca)::BIGINT AS original_events, sum(cb)::BIGINT AS reconstructed_events, (sum(cb) - sum(ca))::BIGINT AS events_added,
    sum(cb) / sum(ca)::DOUBLE AS reconstruction_ratio, count(ca) AS original_event_types, count(cb) AS reconstructed_event_types,
    count(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL) AS common_event_types, count(*) FILTER (ca IS NULL) AS new_event_types,
    count(*) FILTER (cb IS NULL) AS lost_event_types, count(*) FILTER (ca IS NOT NULL AND cb IS NOT NULL) / count(ca)::DOUBLE AS event_type_preservation_rate FROM ty""",
    rnd=["reconstruction_ratio", "event_type_preservation_rate"],
)
def _(t):
    return ev.basic_metrics(t.log(), _recon(t), USER)


_SHIFT = """sh AS (SELECT user_id, event, event_id, us + CASE WHEN event_id % 3 = 0 THEN 2000000 WHEN event_id % 3 = 1 THEN 5000000 ELSE 6000000 END AS us FROM e)"""


def _shifted(t):
    move = F.when(F.col("event_id") % 3 == 0, 2_000_000).when(F.col("event_id") % 3 == 1, 5_000_000).otherwise(6_000_000)
    return t.events().withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + move))


# Greedy matches of the shifted log (left, in time order) with the true one: before a left row's tolerance lie ``f`` right
# rows, up to its end ``g``, and ``p`` are used or passed. A row with no right row in common with those before it starts anew.
_GREEDY = """tr AS (SELECT user_id, event, us, count(*) OVER (PARTITION BY user_id, event ORDER BY us) AS c FROM e),
  bd AS (SELECT l.user_id, l.event, l.us, l.event_id, coalesce(a.c, 0) AS f, coalesce(z.c, 0) AS g FROM sh l
    ASOF LEFT JOIN tr a ON l.user_id = a.user_id AND l.event = a.event AND l.us - 5000000 > a.us
    ASOF LEFT JOIN tr z ON l.user_id = z.user_id AND l.event = z.event AND l.us + 5000000 >= z.us),
  nb AS (SELECT *, row_number() OVER w AS i, coalesce(lag(g) OVER w <= f, true) AS anew FROM bd WINDOW w AS (PARTITION BY user_id, event ORDER BY us, event_id)),
  gm AS (SELECT user_id, event, i, least(f + 1, g) AS p, f < g AS hit FROM nb WHERE anew
    UNION ALL SELECT n.user_id, n.event, n.i, least(greatest(m.p, n.f) + 1, n.g), greatest(m.p, n.f) < n.g
    FROM gm m JOIN nb n ON n.user_id = m.user_id AND n.event = m.event AND n.i = m.i + 1 AND NOT n.anew)"""


@query(
    "r20_accuracy_metrics",
    sql=f"""WITH RECURSIVE {EV}, {_SHIFT}, {_GREEDY}, m AS (SELECT count(*) FILTER (hit) AS tp FROM gm), c AS (SELECT count(*) AS n FROM e)
    SELECT tp AS true_positives, n - tp AS false_positives, n - tp AS false_negatives, tp / n::DOUBLE AS precision, tp / n::DOUBLE AS recall,
      tp / n::DOUBLE AS f1_score, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS event_type_accuracy, tp / n::DOUBLE AS exact_match_rate FROM m, c""",
    rnd=["precision", "recall", "f1_score", "exact_match_rate"],
)
def _(t):
    return ev.accuracy_metrics(_shifted(t), t.events(), USER, 5.0)


@query("r20_match_events_global")
def _(t):
    shifted = _shifted(t)
    return ev.match_events(shifted, t.events(), GLOBAL, 400.0).withColumn("ts", F.unix_micros("ts"))


@query(
    "r21_time_order_completeness",
    sql=f"""WITH {US}, {_RE}, f AS (SELECT user_id, event, min(pos) AS a FROM s GROUP BY 1, 2), g AS (SELECT user_id, event, min(pos) AS b FROM rs GROUP BY 1, 2),
    x AS (SELECT * FROM f JOIN g USING (user_id, event)), p AS (SELECT (p.a < q.a) = (p.b < q.b) AS ok FROM x p JOIN x q ON p.user_id = q.user_id AND p.event < q.event)
    SELECT 1.0::DOUBLE AS time_completeness, true AS time_range_preserved, avg(ok::INT) AS event_order_preserved FROM p""",
    rnd=["event_order_preserved"],
)
def _(t):
    return ev.time_order_completeness(t.log(), _recon(t), USER)


@query("r21_sequence_completeness", sql="SELECT 1.0::DOUBLE AS sequence_completeness")
def _(t):
    return ev.completeness_metrics(t.log(), _recon(t), USER).select("sequence_completeness")


_GAPS = """gs AS (SELECT avg(gap) AS om, stddev_samp(gap) AS os, quantile_cont(gap, 0.5) AS omed FROM s),
  gr AS (SELECT avg(gap) AS rm, stddev_samp(gap) AS rsd, quantile_cont(gap, 0.5) AS rmed FROM rs)"""


@query(
    "r22_temporal_metrics",
    sql=f"""WITH {US}, {_RE}, {_GAPS} SELECT om AS original_mean, os AS original_std, omed AS original_median, rm AS reconstructed_mean, rsd AS reconstructed_std,
    rmed AS reconstructed_median, abs(om - rm) AS gap_mean_difference, abs(os - rsd) AS gap_std_difference, 1 / (1 + abs(om - rm) + abs(os - rsd)) AS temporal_consistency FROM gs, gr""",
    rnd=["original_mean", "original_std", "original_median", "reconstructed_mean", "reconstructed_std", "reconstructed_median", "gap_mean_difference", "gap_std_difference", "temporal_consistency"],
    digits=5,
)
def _(t):
    return ev.temporal_metrics(t.log(), _recon(t), USER)


_QUAL = """tt AS (SELECT ca / sum(ca) OVER ()::DOUBLE AS p, cb / sum(cb) OVER ()::DOUBLE AS q FROM ty),
  vi AS (SELECT count(*) FILTER (event = 'view' AND nxt = 'purchase') AS v, count(nxt) AS n FROM rs),
  qm AS (SELECT 1 - any_value(v) / any_value(n)::DOUBLE AS lc, sum(-q * log2(q)) / log2(count(*)) AS rsc, 1 - sum(abs(p - q)) / 2 AS pl FROM tt, vi)"""


@query(
    "r23_quality_metrics",
    sql=f"""WITH {US}, {_RE}, {_TYPES}, {_QUAL} SELECT lc AS logical_consistency, rsc AS redundancy_score, pl AS plausibility_score, (lc + rsc + pl) / 3 AS overall_quality FROM qm""",
    rnd=["logical_consistency", "redundancy_score", "plausibility_score", "overall_quality"],
)
def _(t):
    return ev.quality_metrics(t.log(), _recon(t), USER, [("view", "purchase")])


@query(
    "r24_confidence_metrics",
    sql=f"""WITH {US}, {_RE} SELECT avg(conf) AS mean_confidence, median(conf) AS median_confidence, min(conf) AS min_confidence, max(conf) AS max_confidence,
    stddev_samp(conf) AS std_confidence, avg((conf >= 0.8)::INT) AS high_confidence_ratio, avg((conf < 0.5)::INT) AS low_confidence_ratio FROM re WHERE conf < 1""",
    rnd=["mean_confidence", "median_confidence", "min_confidence", "max_confidence", "std_confidence", "high_confidence_ratio", "low_confidence_ratio"],
)
def _(t):
    return ev.confidence_metrics(_recon(t))


_OVERALL = f"""{US}, {_RE}, {_TYPES}, {_QUAL.replace("event = 'view' AND nxt = 'purchase'", "false")}, {_GAPS}, cf AS (SELECT avg(conf) AS c FROM re WHERE conf < 1),
  nn AS (SELECT (SELECT count(*) FROM s) AS o, (SELECT count(*) FROM re) AS r),
  ov AS (SELECT 2.0 * o / (o + r) AS f1_score, 0.3 * 2.0 * o / (o + r) + 0.25 + 0.2 / (1 + abs(om - rm) + abs(os - rsd)) + 0.15 * (lc + rsc + pl) / 3 + 0.1 * c AS overall_score
    FROM nn, gs, gr, qm, cf)"""


@query(
    "x7_evaluate_reconstruction",
    sql=f"WITH {_OVERALL} SELECT f1_score, 1.0::DOUBLE AS sequence_completeness, overall_score FROM ov",
    rnd=["f1_score", "overall_score"],
)
def _(t):
    # A zero tolerance keeps the match to the original rows themselves.
    return ev.evaluate_reconstruction(t.log(), _recon(t), USER, tolerance=0.0).select("f1_score", "sequence_completeness", "overall_score")


@query(
    "r25_compare_reconstruction_methods",
    sql=f"WITH {_OVERALL} SELECT 'rules' AS method, overall_score FROM ov UNION ALL SELECT 'none', 0.3 + 0.25 + 0.2 + 0.15 * (1 + (SELECT sum(-p * log2(p)) / log2(count(*)) FROM tt) + 1) / 3 + 0.1",
    rnd=["overall_score"],
)
def _(t):
    log = t.log()
    rows = {
        "rules": ev.evaluate_reconstruction(log, _recon(t), USER, tolerance=0.0),
        "none": ev.evaluate_reconstruction(log, rc.as_original(log), USER, tolerance=0.0),
    }
    return ev.compare_reconstruction_methods(rows).select("method", "overall_score")


@query(
    "r26_largest_gaps",
    sql=f"""WITH {GL}, l AS (SELECT quantile_cont(gap, 0.95) AS lim FROM s) SELECT event_id, gap FROM s, l WHERE gap > lim ORDER BY gap DESC, event_id LIMIT 5""",
    rnd=["gap"],
)
def _(t):
    return ev.largest_gaps(t.log(GLOBAL), GLOBAL).select("event_id", "gap")


@query(
    "x5_train_models",
    sql=f"""WITH {GL} SELECT 'gaps' AS model, count(DISTINCT event) AS rows FROM s UNION ALL SELECT 'markov', count(DISTINCT (prev, event)) FROM s WHERE prev IS NOT NULL
    UNION ALL SELECT 'probabilities', count(DISTINCT event) FROM s""",
)
def _(t):
    models = rc.train_models(t.log(GLOBAL), GLOBAL)
    out = None
    for name, df in models.items():
        row = df.agg(F.count("*").alias("rows")).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
