"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Everything is DataFrame code. Sources share all words by weight; no source may be used more often than
``max_repeats`` times. The targets are turned into block quotas by highest quotients, first for the sources, then for
the shards of each source. A shard is a seeded order of its documents, read as one stream of blocks that starts anew
up to ``max_repeats`` times; its quota is the number of blocks read.

Defined cases: a null text has size 0; null sources form one source, ranked last; repeated rows are documents of
their own; sources without words get target 0; an empty table gives an empty result. Columns that are not named here
are neither read nor passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.seq import null_safe_join
from lumenlog.functions.storage import materialise
from lumenlog.llm.texts import ranked, word_count

# Fixed values of the contract: weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size, n_docs, rank, target): all words shared by weight, capped, the excess shared anew.

    The level at which uncapped sources stand rises with every round that caps more of them, so the loop ends; each
    round is one aggregate row on the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = ranked(per, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = materialise(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        row = per.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if row[2] == capped or not row[1]:
            break
        capped, level = row[2], (total - (row[0] or 0)) / row[1]
    return per.select("source", "source_size", "n_docs", "rank", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def sainte_lague(cells: DataFrame, weight: str, seats: Column, order: Sequence[Column], by: Sequence[str] = (), name: str = "blocks") -> DataFrame:
    """Deal ``seats`` to the cells (of each group ``by``) by the highest quotients weight / (2k + 1).

    Rounding weight * seats / total misses the seats by at most half the cells, and moving the divisor to make up for
    it moves a cell by less than ``n * weight / (2 * total) + 1`` seats. So only quotients that close to the rounded
    share are ranked, at most a few times as many as there are cells, however many seats there are.
    """
    w = F.col(weight).cast("double")
    totals = cells.groupBy(*by).agg(F.sum(w).alias("_total"), F.count("*").alias("_n"))
    if by:
        c = null_safe_join(cells, totals, by)
    else:
        row = totals.first()
        c = cells.withColumns({"_total": F.lit(float(row["_total"] or 0)), "_n": F.lit(row["_n"])})
    c = c.withColumn("_seats", seats.cast("long"))
    base = F.floor(w * F.col("_seats") / F.col("_total") + 0.5)
    reach = F.ceil(F.col("_n") * w / (2 * F.col("_total"))) + 1
    some = (F.col("_total") > 0) & (w > 0)
    c = c.withColumn("_lo", F.when(some, F.greatest(F.lit(0), base - reach)).otherwise(0).cast("long")).withColumn("_hi", F.when(some, base + reach).otherwise(0).cast("long"))
    c = materialise(c, "cells")
    near = c.filter("_hi > _lo").withColumn("_k", F.explode(F.sequence("_lo", F.col("_hi") - 1))).withColumn("_quotient", w / (2 * F.col("_k") + 1))
    highest = [F.col("_quotient").desc(), *order]
    if by:
        sure = F.sum(F.when(F.col("_k") == F.col("_lo"), F.col("_lo")).otherwise(0)).over(Window.partitionBy(*by))
        near = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*highest)) - 1).withColumn("_left", F.col("_seats") - sure)
    else:
        low = c.agg(F.sum("_lo")).first()[0] or 0
        near = ranked(near, highest, "_rank").withColumn("_left", F.col("_seats") - low)
    more = near.filter("_rank < _left").groupBy(*cells.columns).agg(F.count("*").alias("_more"))
    dealt = (F.col("_lo") + F.coalesce("_more", F.lit(0))).alias(name)
    return null_safe_join(c, more, cells.columns, "left").select(*cells.columns, dealt)


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = 3,
    block_words: int = 16,
    docs_per_shard: int = 4096,
    seed: str = "mixture",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, *keep, size, source, source_size, target, taken) for every row of ``docs``.

    Only ids, sources and sizes move. A source is cut into shards of about ``docs_per_shard`` documents by hash, so no
    window holds a whole source. ``taken`` counts words with repeats and is at most ``max_repeats * size``.
    """
    sizes = docs.select("doc_id", *keep, "source", word_count("text").alias("size"))
    sizes = materialise(sizes.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))), "sizes")
    targets = source_targets(sizes, weights, max_repeats)
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    quotas = sainte_lague(targets, "target", F.lit(int(total / block_words + 0.5)), [F.col("rank")])
    shards = F.ceil(F.col("n_docs") / docs_per_shard)
    quotas = materialise(quotas.select("source", "source_size", "target", "blocks", shards.cast("long").alias("shards")), "quotas")
    key = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    placed = sizes.join(quotas, sizes["source"].eqNullSafe(quotas["source"])).drop(quotas["source"]).withColumn("shard", key % F.col("shards"))
    cells = placed.groupBy("source", "blocks", "shard").agg(F.sum("size").alias("shard_size"))
    cells = cells.withColumnRenamed("blocks", "source_blocks")
    cells = sainte_lague(cells, "shard_size", F.col("source_blocks"), [F.col("shard")], by=["source"])
    words = F.least(F.col("blocks") * block_words, F.col("shard_size") * max_repeats)
    cells = cells.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", words.alias("words"))
    rows = placed.drop("blocks").join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    stream = Window.partitionBy("source", "shard").orderBy("_order", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(stream), F.lit(0))
    rows = rows.withColumn("_start", start)
    full = F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0)
    rest = F.when(F.col("shard_size") > 0, F.col("words") % F.col("shard_size")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(rest - F.col("_start"), F.col("size")))
    return rows.select("doc_id", *keep, "size", "source", "source_size", "target", (F.col("size") * full + part).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each time that a document is read, whole or in part.

    The reading that a quota ends inside a document keeps its first words, joined by single spaces. Rows equal in
    doc_id and text share what they take evenly.
    """
    marked = docs.withColumn("_text", F.xxhash64("text"))
    takes = mixture(marked, keep=["_text"], **how).groupBy("doc_id", "_text").agg(F.sum("taken").alias("_sum"), F.count("*").alias("_n"), F.first("size").alias("_size"))
    takes = takes.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), F.expr("_sum div _n").alias("_taken"), "_size").filter("_taken > 0")
    rows = marked.join(takes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")))
    rows = rows.withColumn("_left", F.explode(F.sequence(F.col("_taken"), F.lit(1), -F.col("_size"))))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    head = F.array_join(F.slice(words, 1, F.col("_left").cast("int")), " ")
    text = F.when(F.col("_left") >= F.col("_size"), F.col("text")).otherwise(head)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
