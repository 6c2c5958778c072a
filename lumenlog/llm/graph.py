"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    A large star links the larger neighbours of a node to its smallest one, a small star the smaller ones; the rounds
    needed grow with the logarithm of the size, and the number of edges never grows. Minima are pre-aggregated and
    joined back, so a node with very many neighbours stays a skewed join that Spark can split. Every round is stored.
    Loops (a = b) are allowed and make a node of its own; nulls are not edges.
    """
    pairs = edges.select("a", "b").filter("a is not null and b is not null")
    alone = pairs.filter("a = b").select(F.col("a").alias("node"))
    now = materialise(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        now = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        star = now.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = materialise(star.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node")).union(alone).distinct().join(now, F.col("node") == F.col("a"), "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
