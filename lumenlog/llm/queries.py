"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise
from lumenlog.llm import bpe, codes, hnsw, impact, jaccard, licenses, lm, mixture, passages, periodic, quality, simhash, texts, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIXTURE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mixture:' || coalesce(doc_id::VARCHAR, '')) AS o,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sizes GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
w AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM r),
f AS (SELECT *, sum(cap) OVER a - cap AS full_caps, sum(weight) OVER () - (sum(weight) OVER a - weight) AS open_weights,
             (SELECT sum(source_size) FROM per) AS total
      FROM w WINDOW a AS (ORDER BY cap / weight, rank)),
lv AS (SELECT (total - full_caps)::BIGINT / open_weights::BIGINT AS level FROM f
       WHERE (total - full_caps)::BIGINT / open_weights::BIGINT * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT w.*, least(cap::DOUBLE, weight * coalesce((SELECT level FROM lv), 1e300)) AS target FROM w),
seats AS (SELECT floor(sum(target) / 16 + 0.5)::BIGINT AS n FROM t),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS place
      FROM t, unnest(range(0, (target / 16)::BIGINT + (SELECT count(*) FROM t) + 2)) AS u(k) WHERE target > 0),
b AS (SELECT t.*, ceil(n_docs / 4096)::BIGINT AS shards,
             (SELECT count(*) FROM q WHERE q.source IS NOT DISTINCT FROM t.source AND place <= (SELECT n FROM seats)) AS blocks FROM t),
p AS (SELECT s.*, b.source_size, b.target, b.blocks, ('0x' || o[1:8])::BIGINT % b.shards AS shard
      FROM sizes s JOIN b ON s.source IS NOT DISTINCT FROM b.source),
c AS (SELECT source, blocks, shard, sum(size)::BIGINT AS shard_size FROM p GROUP BY ALL),
cq AS (SELECT source, shard, blocks,
              row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS place
       FROM c, unnest(range(0, blocks + 1)) AS u(k) WHERE shard_size > 0),
cs AS (SELECT c.source, c.shard, c.shard_size,
              least(16 * (SELECT count(*) FROM cq WHERE cq.source IS NOT DISTINCT FROM c.source AND cq.shard = c.shard
                          AND place <= cq.blocks), 3 * c.shard_size) AS words FROM c),
x AS (SELECT p.doc_id, p.size, p.source_size, p.target, cs.words, cs.shard_size,
             coalesce(sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY o, p.doc_id NULLS FIRST, p.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM p JOIN cs ON p.source IS NOT DISTINCT FROM cs.source AND p.shard = cs.shard)
SELECT doc_id, size, source_size, target,
       (CASE WHEN shard_size = 0 THEN 0
             ELSE size * (words // shard_size) + greatest(0, least(words % shard_size - start, size)) END)::BIGINT AS taken
FROM x
"""


@query("op10_mixing", MIXTURE_SQL)
def op10_mixing(spark, sf_dir):
    out = mixture.mixture(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    """Ids of every text and the text they decode to, as digests."""
    coded = bpe.transcode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return quality.classify(docs.select("doc_id", "text"), field).select("doc_id", held_out, "score", "predicted")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_topk", TOP_K_SQL)
def op4_topk(spark, sf_dir):
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_ann")
def op3_ann(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_passages")
def op8_passages(spark, sf_dir):
    return passages.repeats(table(spark, sf_dir, "documents"))


@query("op6_lm")
def op6_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op5_licenses")
def op5_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each tenth document, by checksum of its id, repeats words from some place on with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(texts.WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")

    def at(_, i):
        return F.get(F.col("_words"), F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))

    chosen = (h % 10 == 0) & F.col("text").isNotNull() & (texts.word_count("text") > 0)
    marked = docs.select("doc_id", "text", F.when(chosen, words).alias("_words"), F.when(chosen, a).alias("_a"), F.when(chosen, period).alias("_p"))
    planted = F.concat_ws(" ", F.transform("_words", at))
    return marked.select("doc_id", F.when(F.col("_words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op11_runs")
def op11_runs(spark, sf_dir):
    """Periodic runs of every text, the strongest one, and digests of all of them and of the collapsed text."""
    found = periodic.periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    stronger = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), stronger)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", "_b.start", "_b.length", "_b.period",
        F.floor(1000 * F.col("_b.length") / F.col("_b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
t AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT s.doc_id, len(any_value(g))::BIGINT AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""


@query("op13_jaccard", JACCARD_SQL)
def op13_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


CODES_START = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, range(4) AS r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < 256),
"""
CODES_ROUND = """
a{0} AS MATERIALIZED (
  SELECT vec_id, label, x.p, any_value(x) AS x,
         min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best
  FROM x JOIN b{0} ON x.p = b{0}.p GROUP BY vec_id, label, x.p),
m{0} AS (SELECT p, e, list(floor(total / n) ORDER BY i) AS c
        FROM (SELECT p, best.e AS e, i, sum(x[i]) AS total, count(*) AS n FROM a{0}, range(1, 65) AS r(i) WHERE i <= len(x) GROUP BY ALL)
        GROUP BY p, e),
b{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN m{0} m ON b.p = m.p AND b.e = m.e),
"""
CODES_END = """
f AS (SELECT vec_id, label, x.p, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}) AS best
      FROM x JOIN b4 ON x.p = b4.p GROUP BY vec_id, label, x.p),
g AS (SELECT vec_id, label, string_agg(printf('%02x', best.e::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM s) AS codebooks_sha256 FROM g
"""


@query("op12_codes", CODES_START + "".join(CODES_ROUND.format(i, i + 1) for i in range(4)) + CODES_END)
def op12_codes(spark, sf_dir):
    made = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = codes.with_label_error(materialise(made.coded.select("vec_id", "label", "code", "error"), "codes"))
    return rows.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(made.text()), 256).alias("codebooks_sha256"))
