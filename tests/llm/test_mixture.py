"""Apportionment against its definition, targets, mixed documents and odd rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lumenlog.llm import mixture


def plain_seats(weights, seats):
    quotients = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(weights) if w > 0 for k in range(seats)))
    got = Counter(i for _, i in quotients[:seats])
    return [got[i] for i in range(len(weights))]


def test_sainte_lague(spark):
    r = random.Random(5)
    for weights, seats in (([r.random() * 10 ** r.randrange(5) for _ in range(40)], 1000), ([5, 3, 1], 7), ([1] * 9, 4), ([0, 2], 3), ([7], 0), ([0.0, 0.0], 5)):
        cells = spark.createDataFrame(list(enumerate(map(float, weights))), "i int, w double")
        want = plain_seats(weights, seats)
        assert [x.n for x in mixture.sainte_lague(cells, "w", F.lit(seats), [F.col("i")], name="n").orderBy("i").collect()] == want
        both = cells.withColumn("g", F.lit(None).cast("string")).union(cells.withColumn("g", F.lit("b")))
        got = mixture.sainte_lague(both, "w", F.lit(seats), [F.col("i")], by=["g"], name="n").orderBy("g", "i").collect()
        assert [x.n for x in got] == want * 2


def plain_targets(sizes):
    sources = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), sum(sizes.values())
    while True:
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over


def docs_of(spark, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice((0, 3, 40, 300))), r.choice(["a", "b", "b", "b", "c", "é", "Z", None]), 0) for i in range(600)]
    rows += [(600, None, "a", 0), (None, "x y", "c", 0), (7, "w w", "b", 0), (7, "w w", "b", 0), (601, "tiny", "d", 0), (602, None, "e", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)


def test_targets_and_takes(spark):
    rows, df = docs_of(spark)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    for shard in (50, 4096):
        got = mixture.mixture(df, docs_per_shard=shard).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for x in got:
            assert 0 <= x.taken <= 3 * x.size and abs(x.target - want[x.source]) < 1e-6 and x.source_size == sizes[x.source]
            taken[x.source] += x.taken
        for s, t in want.items():
            assert abs(taken[s] - t) <= 16 + 0.01 * t
        assert sorted(map(str, got)) == sorted(map(str, mixture.mixture(df.repartition(5), docs_per_shard=shard).collect()))
    assert mixture.mixture(df.filter("false")).collect() == []


def test_mixed_documents(spark):
    rows, df = docs_of(spark)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    out = mixture.mix_documents(df)
    assert out.columns == df.columns
    got = Counter()
    for x in out.collect():
        assert x.n_chars == len(x.text)
        got[x.doc_id] += len(x.text.split())
    plan = Counter()
    for x in mixture.mixture(df.withColumn("_text", F.xxhash64("text")), keep=["_text"]).collect():
        plan[x.doc_id] += x.taken
    assert all(abs(got[i] - plan[i]) <= (2 if i == 7 else 0) for i in plan)
    assert mixture.mix_documents(df.filter("false")).collect() == []
