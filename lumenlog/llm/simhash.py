"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two fingerprints within ``radius`` bits agree in one segment up to
``radius // segments`` bits, so each fingerprint looks up the small Hamming ball of every segment in that segment's
table, and complete distances are verified. Everything after the fingerprints is DataFrame code on distinct
fingerprints: exact copies are one node.

Links are not listed, components are. A bucket (a segment with a value) may hold a large group of near copies, whose
links grow with the square of the group. Hence three rounds:

1. every member of a bucket is compared with one hub, the fingerprint of most documents;
2. members outside the bucket's most frequent component look for any member of it: a semi-join, a row each;
3. what is left is pairs with a member outside that component, kept only if the components still differ.

Every pair of different components that share a bucket is met in round 2 or 3, so no link between components is lost.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a component's id is its smallest
doc_id that is not null (null if there is none); repeated rows are rows of the result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise
from lumenlog.llm.arrow import slices
from lumenlog.llm.graph import connected_components

# Fixed value of the contract: the seed of the shingle hash.
SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of the hashes of all word shingles, as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    line = b" ".join(words)
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    for at in range(0, n, 16384):  # a very long text in parts
        some = min(n, at + 16384)
        ends = (starts[at + width : some + width] - 1).tolist()
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at:some].tolist(), ends)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, _text, fp): fp is the fingerprint as Spark's signed long, _text a hash of the text."""

    def run(batches):
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(fp.view(np.int64))], ["doc_id", "_text", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, _text long, fp long")


def cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, the longer ones first."""
    ends = [0]
    for i in range(segments):
        ends.append(ends[-1] + 64 // segments + (i < 64 % segments))
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def balls(bits: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of ``bits`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ 1 << i for m in masks for i in range(bits)}
    return sorted(masks)


def segment(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))


def tables(nodes: DataFrame, segments: int, radius: int) -> DataFrame:
    """A row (seg, val) for each fingerprint and segment, or for each value of the ball around it.

    Spark sizes these rows as the fingerprints before ``explode``, some 70 times too low, and would broadcast them: every
    join of them is a merge join.
    """
    entries = [
        F.struct(F.lit(i).alias("seg"), segment(F.col("fp"), at, bits).bitwiseXOR(F.lit(mask).cast("long")).alias("val"))
        for i, (at, bits) in enumerate(cuts(segments))
        for mask in balls(bits, radius)
    ]
    return nodes.select("*", F.explode(F.array(*entries)).alias("_e")).select(*nodes.columns, "_e.seg", "_e.val")


def near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def relabel(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: the component of ``column``, or itself where it has no link."""
    to = labels.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_to", column)).drop("_node", "_to")


def components(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """(fp, component) for the distinct fingerprints ``fps`` (fp, n): those linked within ``radius`` bits share one."""
    exact = tables(fps, segments, 0)
    hub = exact.groupBy("seg", "val").agg(F.max(F.struct("n", "fp"))["fp"].alias("hub"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    star = exact.join(hub.hint("merge"), ["seg", "val"]).filter(F.col("fp") != F.col("hub")).filter(near("fp", "hub", radius)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    nodes = materialise(relabel(fps.select("fp"), "fp", connected_components(star), "one"), "nodes")
    table = tables(nodes, segments, 0).select("seg", "val", F.col("fp").alias("t"), F.col("one").alias("t_one"))
    most = table.groupBy("seg", "val", "t_one").count().groupBy("seg", "val").agg(F.max(F.struct("count", "t_one"))["t_one"].alias("main"))
    table = materialise(table.join(most.hint("merge"), ["seg", "val"]), "table")
    probes = tables(nodes, segments, radius // segments)
    main = table.filter("t_one = main").select("seg", "val", "t", "main")
    mains = most.select(F.col("seg").alias("_seg"), F.col("val").alias("_val"), F.col("main").alias("_main"))
    outside = probes.join(mains.hint("merge"), (F.col("seg") == F.col("_seg")) & (F.col("val") == F.col("_val"))).filter("one <> _main").drop("_seg", "_val")
    joins = outside.join(main.hint("merge"), (outside["seg"] == main["seg"]) & (outside["val"] == main["val"]) & near("fp", "t", radius), "left_semi")
    second = connected_components(joins.select(F.col("one").alias("a"), F.col("_main").alias("b")))
    nodes = materialise(relabel(nodes, "one", second, "two"), "nodes")
    rest = relabel(table.filter("t_one <> main"), "t_one", second, "t_two").select(F.col("seg").alias("_seg"), F.col("val").alias("_val"), "t", "t_two")
    probes = tables(nodes, segments, radius // segments)
    met = (F.col("seg") == F.col("_seg")) & (F.col("val") == F.col("_val")) & (F.col("two") != F.col("t_two")) & near("fp", "t", radius)
    third = connected_components(probes.join(rest.hint("merge"), met).select(F.col("two").alias("a"), F.col("t_two").alias("b")))
    return relabel(nodes, "two", third, "component").select("fp", "component")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """(doc_id, _text, fingerprint, component, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component`` names the component by a fingerprint.
    """
    rows = materialise(fingerprints(docs, width), "fingerprints")
    per = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    per = materialise(per, "distinct")
    groups = materialise(components(per.select("fp", "n"), radius, segments).join(per, "fp"), "groups")
    ids = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    named = groups.select("fp", "component").join(ids, "component").select(F.col("fp").alias("_fp"), "component", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "_text", hexed.alias("fingerprint"), "component", "component_id")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, then of the smallest text hash."""
    found = near_duplicates(docs, **how)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_text").alias("text"))
    kept = found.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.id").alias("_id"), F.col("first.text").alias("_t"))
    rows = docs.withColumn("_text", F.xxhash64("text"))
    rows = rows.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")))
    return rows.dropDuplicates(["doc_id", "_text"]).select(*docs.columns)
