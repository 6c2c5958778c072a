"""Cases of the fourth round's findings on the operators for training data."""

import random

import numpy as np

import corpus_pipeline as C
from lumenlog.llm import simhash


def broadcasts(plan):
    """The subtrees of a plan's text that are broadcast."""
    lines, depth = plan.splitlines(), lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("BroadcastExchange"):
            end = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            yield "\n".join(lines[i:end])


def test_exploded_fingerprints_are_never_broadcast(spark, monkeypatch):
    """Spark sizes exploded rows as those before: with its usual limit it would broadcast all of them."""
    plans = []

    def kept(f):
        def run(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return f(df, *rest)

        return run

    monkeypatch.setattr(simhash, "materialise", kept(simhash.materialise))
    monkeypatch.setattr(simhash, "connected_components", kept(simhash.connected_components))
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(50)]
    fps = np.array(fps + [f ^ 1 << 7 for f in fps[:20]], np.uint64).view(np.int64).tolist()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = simhash.components(spark.createDataFrame([(f, 1) for f in fps], "fp long, n long"))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert found.count() == 70 and found.select("component").distinct().count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum("Generate explode" in p for p in plans) >= 4
    assert [b for p in plans for b in broadcasts(p) if "Generate explode" in b] == []


def test_the_pipeline_never_broadcasts_exploded_fingerprints(spark, monkeypatch):
    """The pipeline's second stage is the whole of ``deduplicate``: its joins of exploded rows are merge joins."""
    plans, stored = [], simhash.materialise

    def kept(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *rest)

    monkeypatch.setattr(simhash, "materialise", kept)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(8)], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        stages = dict(C.STAGES)
        assert stages["near_duplicates"](spark, docs, "").count() <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    exploded = [p for p in plans if "Generate explode" in p]
    assert exploded and not any("Generate explode" in b for p in exploded for b in broadcasts(p))
