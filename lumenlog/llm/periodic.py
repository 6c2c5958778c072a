"""Runs of consecutive words that repeat with a period, by a suffix automaton with link-cut access.

A text is first cut to the stretches in which every four consecutive words stand at least twice in it: a run of the
lengths asked for lies inside one of them, since its words repeat a period later, and so do its neighbours. The cut
loses nothing and leaves little of ordinary prose.

For a stretch the suffix automaton is built; its states, linked to the longest suffix with other occurrences, form a
tree. Then the words are appended one by one: the path from the new prefix's state to the root holds every suffix of
the prefix, and *access* recolours it with the prefix's end. Link-cut trees keep equally coloured path segments as
splay trees, so an access meets O(log n) segments on average. A segment with colour ``j`` and longest string ``l`` says
that the last ``l`` words stand at ``j`` for the last time before: with ``d = now - j <= l`` they end in a square of
period ``d``, which is never a multiple of a shorter period, and the stretch from ``now - l - d + 1`` on has that
period. Reports with one start and period are one run, whose end is the last of them.

Memory is some 500 bytes for each word of the longest repetitive stretch of a text, and nothing for other words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenlog.llm.arrow import mapped, with_columns

#: Words of the pieces that must repeat in a text for a place to be looked at.
PIECE = 4


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, state of each prefix) of the suffix automaton; state 1 is the root, 0 means none."""
    follow: list[dict[int, int]] = [{}, {}]
    link, length, ends = [0, 0], [0, 0], []
    last = 1
    for n, c in enumerate(words, 1):
        new = len(link)
        follow.append({})
        link.append(1)
        length.append(n)
        p = last
        while p and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        ends.append(new)
    return link, length, ends


class Paths:
    """A rooted tree cut into paths of one colour each, every path a splay tree ordered by depth (link-cut trees)."""

    def __init__(self, parent: list[int]):
        self.up = list(parent)  # parent in the splay tree, or the tree's parent of a path's top
        self.left = [0] * len(parent)
        self.right = [0] * len(parent)
        self.colour = [0] * len(parent)  # holds for the splay tree's root

    def rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            left[p] = b = right[x]
            right[x] = p
        else:
            right[p] = b = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        self.colour[x] = self.colour[p]  # matters where p was the root
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; the colour comes along."""
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self.rotate(p if (left[p] == x) == (left[g] == p) else x)
            self.rotate(x)

    def access(self, x: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``x`` to the root; gives (node, old colour) of each segment, the deepest node of it."""
        below = 0
        while x:
            self.splay(x)
            old = self.colour[x]
            if old:
                yield x, old
            if cut := self.right[x]:
                self.colour[cut] = old
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """Last word of each maximal stretch with a period at least twice in it, by (start, smallest period)."""
    link, length, ends = automaton(words)
    paths = Paths(link)
    out = {}
    for now, state in enumerate(ends, 1):
        for node, before in paths.access(state, now):
            d, n = now - before, length[node]
            if d <= n:
                out[now - n - d, d] = now - 1
    return out


def stretches(words: list[bytes], shortest: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the maximal stretches in which every piece of ``PIECE`` words stands twice in the text.

    Hashes stand for words; equal hashes of different words only lengthen a stretch.
    """
    n = len(words) - PIECE + 1
    if n < 2:
        return
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for i in range(1, PIECE):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n + 2, np.int8)
    twice[1 + order[1:][same]] = 1
    twice[1 + order[:-1][same]] = 1
    edges = np.flatnonzero(np.diff(twice))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a + PIECE - 1 >= shortest:
            yield a, b + PIECE - 1


def runs_of(words: list[bytes], shortest: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``shortest`` words and ``times`` periods, by start and period."""
    out = []
    for a, b in stretches(words, shortest):
        numbers: dict[bytes, int] = {}
        part = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        out += [(a + s, e - s + 1, d) for (s, d), e in squares(part).items() if e - s + 1 >= max(shortest, times * d)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside runs, and the first period of each run where no other run drops it."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, shortest: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` array<struct<start, length, period>> and ``collapsed`` of column ``text``.

    A run is a stretch of words with smallest period ``period`` and at least ``shortest`` words and ``times`` periods
    that neither neighbour extends; runs are listed by start, then period. ``collapsed`` joins by one space the words
    that no run holds after its first period. ``shortest`` is at least 5 and ``times`` at least 4: below, a run need
    not hold each piece of four words twice.

    Defined cases: a null text counts as empty (no words, no runs, an empty ``collapsed``); repeated rows are rows of
    the result; columns of the names above are replaced, others stay as they are, nulls in them included.
    """
    if times < 4 or shortest < PIECE + 1:
        raise ValueError("runs have at least four periods and five words")

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        counts, found, texts = [], [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode().split()
            runs = runs_of(words, shortest, times)
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": d} for s, n, d in runs])
            texts.append(b" ".join(collapse(words, runs)).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return {"n_words": pa.array(counts, pa.int64()), "runs": pa.array(found, kind), "collapsed": pa.array(texts, pa.string())}

    return mapped(docs, lambda b: with_columns(b, add(b)), "text", 512, n_words="long", runs="array<struct<start:long,length:long,period:long>>", collapsed="string")
