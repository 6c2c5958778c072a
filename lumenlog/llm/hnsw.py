"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

A shard's graph is a few flat arrays: for each layer a fixed number of neighbour places for each node, -1 where there
are fewer. Points are inserted, and queries searched, in lock-step batches: each step expands the best unexpanded
candidate of every search at once, so the work is array work. Every row is indexed, none is sampled; equal vectors of
a shard are one node with several members, so a very common vector cannot crowd out its neighbourhood.

Nearness is the inner product. For building, vectors get one more component that makes all norms equal, which turns
inner products into distances; queries have zero there.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an
id; ties go to the smaller vec_id; shorter vectors are zero in the components they lack.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import shards

#: Neighbours of a node in the upper layers, and twice as many in the lowest.
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 128
BATCH = 256


def beam(links: np.ndarray, points: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of up to ``ef`` near points per query, best first, -1 where there are fewer."""
    b, width = len(queries), links.shape[1]
    rows = np.arange(b)
    seen = np.zeros((b, len(points)), bool)
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    fresh = np.zeros((b, ef), bool)
    ids[:, 0], fresh[:, 0], seen[rows, entry] = entry, True, True
    sims[:, 0] = np.einsum("ij,ij->i", points[entry], queries)
    active = rows
    while len(active):
        open_sims = np.where(fresh[active], sims[active], -np.inf)
        best = open_sims.argmax(axis=1)
        going = open_sims[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        fresh[active, best] = False
        near = links[ids[active, best]]
        new = (near >= 0) & ~seen[active[:, None], near]
        safe = np.where(new, near, 0)
        r, c = np.nonzero(new)
        seen[active[r], near[r, c]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        got = points[safe[r, c]]
        found[r, c] = np.einsum("ij,ij->i", got, queries[active[r]])
        # Keep the best ef of the old list and the new points.
        all_sims = np.concatenate([sims[active], found], axis=1)
        keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, near, -1)], axis=1), keep, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], new], axis=1), keep, 1)
        ids[active] = np.where(sims[active] == -np.inf, -1, ids[active])
        fresh[active] &= sims[active] > -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def spread(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Neighbours among candidates (best first): those nearer to the point than to any chosen one, then the nearest."""
    b, c = ids.shape
    there = ids >= 0
    vectors = points[np.where(there, ids, 0)]
    among = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros((b, c), bool)
    for j in range(c):
        blocked = (chosen & (among[:, j, :] > sims[:, j, None])).any(axis=1)
        chosen[:, j] = there[:, j] & ~blocked & (chosen.sum(axis=1) < most)
    # Free places go to the nearest of the others.
    rank = np.where(chosen, 0, np.where(there, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(np.where(there, ids, -1), order, 1)


def link(links: np.ndarray, points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Give ``nodes`` their neighbours in one layer, and the neighbours the way back."""
    width = links.shape[1]
    chosen = spread(points, ids, sims, min(width, LINKS))
    links[nodes] = -1
    links[nodes, : chosen.shape[1]] = chosen
    r, c = np.nonzero(chosen >= 0)
    to, source = chosen[r, c], nodes[r]
    order = np.lexsort((source, to))
    to, source = to[order], source[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(targets), int(counts.max(initial=0))), -1, np.int64)
    extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(first, counts)] = source
    own = links[targets]
    extra[(extra[:, :, None] == own[:, None, :]).any(axis=2)] = -1
    cand = np.concatenate([own, extra], axis=1)
    total = (cand >= 0).sum(axis=1)
    fits = total <= width
    packed_rows = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)
    links[targets[fits]] = packed_rows[fits][:, :width] if packed_rows.shape[1] >= width else np.pad(packed_rows[fits], ((0, 0), (0, width - packed_rows.shape[1])), constant_values=-1)
    over = np.flatnonzero(~fits)
    for at in range(0, len(over), 1024):
        some = over[at : at + 1024]
        many = cand[some]
        near = np.einsum("ijk,ik->ij", points[np.where(many >= 0, many, 0)], points[targets[some]])
        near[many < 0] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : width + 16]
        links[targets[some]] = spread(points, np.take_along_axis(many, best, 1), np.take_along_axis(near, best, 1), width)


def descend(layers: list[np.ndarray], points: np.ndarray, queries: np.ndarray, entry: int, top: int, down_to: int) -> np.ndarray:
    """The nearest point that a greedy walk finds in each layer from ``top`` to above ``down_to``."""
    at = np.full(len(queries), entry)
    for layer in range(top, down_to, -1):
        at = beam(layers[layer], points, queries, at, 1)[0][:, 0]
    return at


def build_graph(points: np.ndarray, levels: np.ndarray, ef: int = EF_BUILD) -> tuple[list[np.ndarray], int]:
    """Neighbour arrays of every layer, and the entry point."""
    n, tops = len(points), int(levels.max(initial=0))
    layers = [np.full((n, LINKS * (2 if layer == 0 else 1)), -1, np.int64) for layer in range(tops + 1)]
    entry = int(levels.argmax())
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    at = 1
    while at < n:
        size = min(BATCH, max(1, at // 2))
        new = order[at : at + size]
        at += size
        q = points[new]
        between = q @ q.T
        np.fill_diagonal(between, -np.inf)
        start = np.full(len(new), entry)
        for layer in range(tops, -1, -1):
            low = levels[new] < layer
            if low.any():
                start[low] = beam(layers[layer], points, q[low], start[low], 1)[0][:, 0]
            mine = np.flatnonzero(~low)
            if not len(mine):
                continue
            ids, sims = beam(layers[layer], points, q[mine], start[mine], ef)
            start[mine] = ids[:, 0]
            # Points of the same batch see each other too.
            ids = np.concatenate([ids, np.broadcast_to(new[mine], (len(mine), len(mine)))], axis=1)
            sims = np.concatenate([sims, between[np.ix_(mine, mine)]], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            link(layers[layer], points, new[mine], np.where(sims == -np.inf, -1, ids), sims)
    return layers, entry


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    nodes, member_of = np.unique(vectors, axis=0, return_inverse=True)
    # Random insertion order and levels, the same in every run.
    random = np.random.default_rng(len(nodes))
    shuffle = random.permutation(len(nodes))
    nodes, member_of = nodes[shuffle], np.argsort(shuffle)[member_of.ravel()]
    levels = np.floor(-np.log(1 - random.random(len(nodes))) / np.log(LINKS)).astype(int)
    norms = (nodes * nodes).sum(axis=1)
    lift = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
    points = np.column_stack([nodes, lift]).astype(np.float32)
    layers, entry = build_graph(points, levels)
    order = np.lexsort((ids, member_of))
    flat = {f"layer{i}": x.astype(np.int32) for i, x in enumerate(layers)}
    return flat | {
        "entry": np.array([entry]),
        "nodes": nodes,
        "points": points,
        "members": ids[order],
        "offsets": np.concatenate([[0], np.cumsum(np.bincount(member_of, minlength=len(nodes)))]),
    }


def find(index: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF_SEARCH):
    layers = [index[f"layer{i}"] for i in range(sum(x.startswith("layer") for x in index))]
    points, nodes, offsets, members = index["points"], index["nodes"], index["offsets"], index["members"]
    queries = shards.same_width(queries, nodes.shape[1])
    flat = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
    at, found, scores = [], [], []
    ef = max(ef, k + 1)
    for b in range(0, len(queries), 1024):
        q = flat[b : b + 1024]
        start = descend(layers, points, q, int(index["entry"][0]), len(layers) - 1, 0)
        near, _ = beam(layers[0], points, q, start, ef)
        for i, row in enumerate(near, b):
            row = row[row >= 0]
            exact = nodes[row] @ queries[i]
            # The k + 1 smallest ids of a node are enough: its other members come behind them.
            some = [members[offsets[r] : offsets[r + 1]] for r in row]
            some = [m[m != ids[i]][:k] for m in some]
            ids_of = np.concatenate(some) if some else members[:0]
            score = np.repeat(exact, [len(m) for m in some])
            best = np.lexsort((ids_of, -score))[:k]
            at.append(np.full(len(best), i))
            found.append(ids_of[best])
            scores.append(score[best])
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` (vec_id, embedding) found for each query."""
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(shards.finite(F.col("embedding")) & some).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return shards.search(rows, is_query, build, find, k, "double", **how)
