"""Searching a vector table in shards: an index row per shard, blocks of queries against every shard, merged results.

Shards hold about ``rows_per_shard`` vectors by hash of their id, blocks about ``queries_per_block`` queries, whatever
the size of the table, so a task's memory does not grow with it. Each pair of a shard and a block is a group of its
own. Only the best few results of a pair leave its task.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        return dict(f)


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def matrix(vectors: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of numbers; shorter vectors count as zero in the components they lack."""
    lists = vectors.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(dtype)
    out = np.zeros((len(lengths), width), dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def same_width(a: np.ndarray, width: int) -> np.ndarray:
    """``a`` with exactly ``width`` columns: cut or filled with zeros."""
    out = np.zeros((len(a), width), a.dtype)
    out[:, : min(width, a.shape[1])] = a[:, :width]
    return out


def search(
    vectors: DataFrame,
    is_query: Column,
    build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    find: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    score: str,
    rows_per_shard: int = 8192,
    queries_per_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best vectors of other ids for each query of ``vectors`` (vec_id, vec).

    ``build(ids, vectors)`` makes a shard's index, ids ascending; ``find(index, query ids, query vectors, k)`` gives
    (query places, vec_ids, scores) with the query's own id left out. An id with several rows is one query (its
    smallest vector) and several candidates.
    """
    rows = materialise(vectors.filter("vec_id is not null"), "vectors")
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n, q = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // rows_per_shard)), max(1, -(-q // queries_per_block))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def indexed(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table.column("vec_id").to_numpy()
        return pa.table({"shard": table.column("shard").slice(0, 1), "index": pa.array([packed(**build(ids, matrix(table.column("vec"))))], pa.binary())})

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = materialise(placed.groupBy("shard").applyInArrow(indexed, "shard int, index binary"), "index")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], right.schema.field("vec_id").type), "vec_id": pa.array([], right.schema.field("vec_id").type), "score": pa.array([], pa.int64() if score == "long" else pa.float64())})
        ids = right.column("vec_id").to_numpy()
        at, found, scores = find(unpacked(left.column("index")[0].as_py()), ids, matrix(right.column("vec")), k)
        return pa.table({"query_id": ids[at], "vec_id": found, "score": scores})

    each = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = each.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(searched, f"query_id {kind}, vec_id {kind}, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
