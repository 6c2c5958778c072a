"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are integers. A component's impact is its value without the lowest ``SHIFT`` bits; a posting segment lists
the vectors that have an impact in a dimension. A query turns a segment into a contribution (an upper bound, since the
low bits may be anything) and processes segments from the largest contribution in size to the smallest. After each
round, a vector's score is at most its accumulator plus what the unprocessed segments of each dimension can add at
most. The k-th best exact score of some promising vectors is a floor; processing stops once few vectors can reach it,
and these are all scored exactly. Nothing is left out without that proof.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows without an id;
shorter vectors are zero in the components they lack; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import shards

SHIFT = 2
ROUNDS = (0.15, 0.3, 0.5, 0.75, 1.0)


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Segments by dimension and impact: offsets into one flat array of postings; the vectors, for exact scores."""
    values = vectors.astype(np.int64)
    n, width = values.shape
    impacts = values >> SHIFT
    low = int(impacts.min(initial=0))
    levels = int(impacts.max(initial=0)) - low + 1
    keys = (np.arange(width) * levels + impacts - low).ravel()
    order = np.argsort(keys, kind="stable")
    counts = np.bincount(keys, minlength=width * levels)
    used = np.flatnonzero(counts)
    return {
        "ids": ids,
        "values": values.astype(np.int32) if values.size == 0 or np.abs(values).max() < 1 << 30 else values,
        "postings": (order // max(1, width)).astype(np.int32),
        "offsets": np.concatenate([[0], np.cumsum(counts[used])]),
        "dims": used // levels,
        "impacts": used % levels + low,
    }


def find_one(index: dict[str, np.ndarray], query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the ``k`` best vectors, ``own`` left out."""
    values, postings, offsets, dims = index["values"], index["postings"], index["offsets"], index["dims"]
    n = len(values)
    lowest = index["impacts"] << SHIFT
    q = query[dims]
    bound = np.where(q >= 0, q * (lowest + (1 << SHIFT) - 1), q * lowest)  # of a vector of the segment
    order = np.argsort(-np.abs(bound), kind="stable")
    sizes = np.diff(offsets)
    done = np.cumsum(sizes[order])
    # What the segments from each place of the order on can still add: per dimension its largest bound, at least 0.
    acc, floor, at = np.zeros(n), None, 0
    possible = np.arange(n)
    for share in ROUNDS:
        upto = len(order) if share == 1 else int(np.searchsorted(done, share * done[-1], "right"))
        part = order[at:upto]
        at = upto
        if len(part):
            lengths = sizes[part]
            inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            acc += np.bincount(postings[np.repeat(offsets[part], lengths) + inside], np.repeat(bound[part], lengths).astype(float), n)
        left = np.zeros(len(query))
        rest = order[at:]
        np.maximum.at(left, dims[rest], bound[rest])
        most = left.sum()
        if floor is None:
            some = np.argpartition(-acc, min(4 * k + len(own), n - 1))[: 4 * k + len(own)] if n > 4 * k + len(own) else np.arange(n)
            some = np.setdiff1d(some, own)
            if len(some) >= k:
                floor = np.sort(values[some].astype(np.int64) @ query)[-k]
        if floor is not None:
            possible = np.flatnonzero(acc + most >= floor)
            if len(possible) <= 16 * k:
                break
    possible = np.setdiff1d(possible, own)
    scores = values[possible].astype(np.int64) @ query
    best = np.lexsort((index["ids"][possible], -scores))[:k]
    return possible[best], scores[best]


def find(index: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int):
    width = index["values"].shape[1]
    queries = shards.same_width(queries.astype(np.int64), width)
    at, found, scores = [], [], []
    firsts, lasts = np.searchsorted(index["ids"], ids, "left"), np.searchsorted(index["ids"], ids, "right")
    for i, query in enumerate(queries):
        places, score = find_one(index, query, np.arange(firsts[i], lasts[i]), k)
        at.append(np.full(len(places), i))
        found.append(index["ids"][places])
        scores.append(score)
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, **how) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` (vec_id, embedding): components become floor(scale * x)."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(shards.finite(F.col("embedding"))).select("vec_id", whole.alias("vec"))
    return shards.search(rows, is_query, build, find, k, "long", **how)
