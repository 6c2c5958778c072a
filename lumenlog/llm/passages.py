"""Near-duplicate passages by compact windows.

Tokens are word shingles. For each of several hash functions, the Cartesian tree of the token hashes cuts a text into
compact windows (first, anchor, last): every run of at least ``min`` tokens inside a window that holds the anchor has
the anchor as its minimum. Two texts whose windows have the same anchor token share a min-hash signature there, so
such windows are brought together by anchor. For each pair of texts, the windows' intervals are joined; where those of
enough hash functions overlap, the two passages are verified token by token.

A passage may stand in a third of all texts. So windows of one anchor are linked to the first of them (in the order of
text hash and place) and never to each other; a task first does so among its own texts, and only one window of an
anchor and task is shuffled. The key of an anchor takes in two tokens on either side, which keeps short common lines
in different surroundings apart. Windows that share no passage with their first one are compared again by longer keys.
Verified passages all point to an earlier text, so one occurrence is always left.

Defined cases: a null text is empty; texts with fewer than ``min_words`` words have no passages; equal texts are one
text here and repeat as a whole; the owner of a passage is the smallest doc_id with that text (null if there is none);
repeated rows are documents of their own; other columns pass through ``drop_repeats`` and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise
from lumenlog.llm.arrow import mapped, slices, with_columns
from lumenlog.llm.bpe import Kept
from lumenlog.llm.texts import word_count

#: Beyond so many distinct texts, texts are filtered by a shuffled join and no longer by a broadcast one (16 bytes each).
BROADCAST_TEXTS = 2_000_000
#: Functions whose windows must overlap.
ENOUGH = 2
#: The same token counts as equal for its first occurrences in a text, eight at a time: a text of one word stays cheap.
OCCURRENCES = 8
#: A token with more pairs of places in two texts is paired in its order only, and the runs found so are lengthened.
PAIRS = 64

_WORDS = Kept(lambda w: xxhash.xxh64_intdigest(w, 7), 1 << 19)


@dataclass(frozen=True)
class Passages:
    """What counts as a passage: ``min_words`` words, shingles of ``width`` words, Jaccard from ``similarity`` on."""

    min_words: int = 50
    width: int = 5
    similarity: float = 0.8
    functions: int = 5

    @property
    def least(self) -> int:
        return self.min_words - self.width + 1


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None, width: int) -> np.ndarray:
    """Hashes of all shingles of ``width`` lower-cased words."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x100000001B3) + h[i : i + n]
    return mix(out, 0)


def occurrences(t: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each token stood in its own text before."""
    key = mix(t + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + np.uint64(1)))
    count = np.empty(len(t), np.int64)
    count[order] = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    return count


def compact_windows(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, anchor, last) of all nodes of the texts' Cartesian trees that span at least ``least`` tokens.

    All nodes of a level are found in one pass: the place is part of the value, so a minimum is its own place.
    """
    value = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    found = [[], [], []]
    keep = ends - starts >= least
    a, b = starts[keep], ends[keep]
    while len(a):
        bounds = np.empty(2 * len(a), np.int64)
        bounds[::2], bounds[1::2] = a, b
        if bounds[-1] == len(value):
            bounds = bounds[:-1]
        c = (np.minimum.reduceat(value, bounds)[::2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for x, y in zip(found, (a, c, b - 1)):
            x.append(y)
        a, b = np.stack([a, c + 1], 1).ravel(), np.stack([c, b], 1).ravel()
        keep = b - a >= least
        a, b = a[keep], b[keep]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def windows_of(texts: list[str | None], marks: np.ndarray, how: Passages) -> dict[str, np.ndarray]:
    """Windows of some texts (``marks``: their hashes), each linked to the first of the same anchor among them.

    Columns: key, t, c, l, r (text and places of the window) and ht, hc, hl, hr of the first one, which is the window
    itself where ``first`` is true.
    """
    per = [tokens(x, how.width) for x in texts]
    sizes = np.array([len(x) for x in per], np.int64)
    t = np.concatenate(per) if per else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(per)), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    numbered = t + (occurrences(t, of) // OCCURRENCES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    # The key of an anchor: the token and those two places away, or nothing beyond the ends of the text.
    i = np.arange(len(t))
    before = np.where(i - 2 >= starts[of], t[np.maximum(i - 2, 0)], 0) if len(t) else t
    behind = np.where(i + 2 < ends[of], t[np.minimum(i + 2, len(t) - 1)], 0) if len(t) else t
    around = mix(t ^ mix(before.astype(np.uint64), 2) ^ mix(behind.astype(np.uint64), 3), 4)
    cols = [[] for _ in range(5)]
    for j in range(how.functions):
        a, c, b = compact_windows(mix(numbered, 10 + j), starts, ends, how.least)
        key = mix(around[c], 20 + j) & np.uint64(0xFFFFFFFFFFFFFFF8) | np.uint64(j & 7)
        doc = of[c]
        for x, y in zip(cols, (key.view(np.int64), marks[doc], c - starts[doc], a - starts[doc], b - starts[doc])):
            x.append(y)
    key, m, c, a, b = (np.concatenate(x) for x in cols)
    order = np.lexsort((c, m, key))
    key, m, c, a, b = key[order], m[order], c[order], a[order], b[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (m[1:] == m[:-1]) & (c[1:] == c[:-1])  # equal texts
    key, m, c, a, b = key[~same], m[~same], c[~same], a[~same], b[~same]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return {"key": key, "t": m, "c": c, "l": a, "r": b, "ht": m[first], "hc": c[first], "hl": a[first], "hr": b[first], "first": new}


WINDOW = "key long, t long, c int, l int, r int, ht long, hc int, hl int, hr int, first boolean"


def windows(texts: DataFrame, how: Passages) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", 1024, 4 << 20):
            cols = windows_of(batch.column("text").to_pylist(), batch.column("_t").to_numpy(), how)
            # Windows that follow another text's; those of the same text are no link.
            use = cols["first"] | (cols["ht"] != cols["t"])
            kinds = {"key": np.int64, "t": np.int64, "ht": np.int64, "first": bool}
            yield pa.RecordBatch.from_pydict({k: pa.array(v[use].astype(kinds.get(k, np.int32))) for k, v in cols.items()})

    return texts.select("text", "_t").mapInArrow(run, WINDOW)


def links(texts: DataFrame, how: Passages) -> DataFrame:
    """(key, t, c, l, r, ht, hc, hl, hr, j): the windows that have the anchor of another text's, linked to a first one."""
    rows = windows(texts, how)
    # Windows that have their link already spread over all tasks; the firsts meet by key.
    deal = F.when(F.col("first"), F.col("key")).otherwise(F.xxhash64("key", "t", "c"))
    group = Window.partitionBy("_deal").orderBy("t", "c")
    hub = F.first(F.struct("t", "c", "l", "r")).over(group)
    rows = rows.withColumn("_deal", deal).withColumn("_hub", hub)
    for old, new in (("ht", "t"), ("hc", "c"), ("hl", "l"), ("hr", "r")):
        rows = rows.withColumn(f"_{old}", F.when(F.col("first"), F.col(f"_hub.{new}")).otherwise(F.col(old)))
    return rows.filter("_ht <> t").select("key", "t", "c", "l", "r", *[F.col(f"_{x}").alias(x) for x in ("ht", "hc", "hl", "hr")], F.col("key").bitwiseAND(F.lit(7)).alias("j"))


def candidates(pairs: DataFrame, enough: int) -> DataFrame:
    """(t, ht, l, r, hl, hr): regions of tokens of two texts where linked windows of ``enough`` functions overlap."""
    # Intervals of a pair of texts that overlap form an island.
    ordered = Window.partitionBy("ht", "t").orderBy("l", "c")
    reach = F.max("r").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.coalesce(reach, F.lit(-1)) < F.col("l")).cast("int")
    pairs = pairs.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(ordered))
    islands = pairs.groupBy("ht", "t", "_island").agg(
        F.count_distinct("j").alias("_functions"),
        *[F.min(c).alias(c) for c in ("l", "hl")],
        *[F.max(c).alias(c) for c in ("r", "hr")],
    )
    return islands.filter(F.col("_functions") >= enough).select("ht", "t", "l", "r", "hl", "hr")


def offsets(size: int, least: int) -> list[int]:
    """How far before a place runs of ``size`` tokens start, so that every run of ``least`` with the place holds one."""
    return sorted({min(x, size - 1) for x in range(0, size + least, least - size + 1)})


def run_keys(t: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` tokens."""
    out = np.zeros(max(len(t) - size + 1, 0), np.uint64)
    for i in range(size if len(out) else 0):
        out = out * np.uint64(0x9FB21C651E98DF25) + t[i : i + len(out)]
    return mix(out, 5).view(np.int64)


def runs(members: DataFrame, sizes: Sequence[int], how: Passages) -> DataFrame:
    """(key, t, c, size): runs of each number of tokens around the places of each text (t, text, places)."""
    back = {size: np.array(offsets(size, how.least)) for size in sizes}

    def run(batches):
        for batch in slices(batches, "text", 256):
            out = [[], [], [], []]
            for r in batch.to_pylist():
                found, places = tokens(r["text"], how.width), np.array(r["places"], np.int64)[:, None]
                for size in sizes:
                    key = run_keys(found, size)
                    c = np.unique(places - back[size])
                    c = c[(c >= 0) & (c < len(key))]
                    for x, y in zip(out, (key[c], np.full(len(c), r["t"], np.int64), c.astype(np.int32), np.full(len(c), size, np.int32))):
                        x.append(y)
            cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "t", "c", "size"])

    return members.mapInArrow(run, "key long, t long, c int, size int")


def run_links(rows: DataFrame, spans: DataFrame, size: int, how: Passages) -> DataFrame:
    """(t, c, l, r, ht, hl, hr, j): each run that lies in no span of its text, linked to the first equal one of all texts.

    ``rows`` has the runs of ``size`` tokens, ``spans`` (t, spans) the texts' passages so far.
    """
    hubs = rows.groupBy("key").agg(F.min(F.struct("t", "c")).alias("_hub"), F.max("t").alias("_other"))
    hubs = hubs.filter(F.col("_other") != F.col("_hub.t")).select("key", F.col("_hub.t").alias("ht"), F.col("_hub.c").alias("hl"))
    linked = rows.select("key", "t", "c").join(hubs, "key").filter("ht <> t").drop("key")
    end = F.col("c") + F.lit(size + how.width - 1)
    held = F.exists("spans", lambda x: (x["start"] <= F.col("c")) & (x["end"] >= end))
    linked = linked.join(spans, "t", "left").filter(~F.coalesce(held, F.lit(False)))
    far = F.lit(size - 1)
    return linked.select("t", "c", F.col("c").alias("l"), (F.col("c") + far).alias("r"), "ht", "hl", (F.col("hl") + far).alias("hr"), F.lit(0).alias("j"))


def shared_runs(t: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, first in h) of the maximal runs of tokens that stand in the same order in both."""
    values, in_t, n_t = np.unique(t, return_inverse=True, return_counts=True)
    at = np.searchsorted(values, h)
    known = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == h) if len(values) else np.zeros(len(h), bool)
    places = np.flatnonzero(known)
    n_h = np.bincount(at[places], minlength=len(values))
    order_t = np.argsort(in_t, kind="stable")
    order_h = places[np.argsort(at[places], kind="stable")]
    starts_t, starts_h = np.cumsum(n_t) - n_t, np.cumsum(n_h) - n_h
    # All pairs of places of a token; of one with very many, the k-th place here with the k-th there.
    full = n_t * n_h <= PAIRS
    counts = np.where(full, n_t * n_h, np.minimum(n_t, n_h))
    token = np.repeat(np.arange(len(values)), counts)
    k = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
    wide = np.where(full, np.maximum(n_h, 1), 1)[token]
    i = order_t[starts_t[token] + k // wide] if len(token) else token
    j = order_h[starts_h[token] + np.where(full[token], k % wide, k)] if len(token) else token
    order = np.lexsort((i, j - i))
    i, shift = i[order], (j - i)[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(shift) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    runs = zip(i[first].tolist(), i[last].tolist(), shift[first].tolist()) if len(i) else ()
    if full.all():
        return [(a, b, a + d) for a, b, d in runs]
    # Pairs were left out: runs go on as far as both texts agree.
    found = set()
    for a, b, d in sorted(runs):
        if any(x <= a and b <= y and e == d for x, y, e in list(found)[-1:]):
            continue
        back, ahead = min(a, a + d), min(len(t) - b, len(h) - b - d) - 1
        same = np.flatnonzero(t[a - back : a][::-1] != h[a + d - back : a + d][::-1]) if back else ()
        a -= int(same[0]) if len(same) else back
        same = np.flatnonzero(t[b + 1 : b + 1 + ahead] != h[b + d + 1 : b + d + 1 + ahead]) if ahead > 0 else ()
        b += int(same[0]) if len(same) else max(ahead, 0)
        found.add((a, b, d))
    return [(a, b, a + d) for a, b, d in found]


def chains_of(runs: list[tuple[int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Runs that follow each other in both texts with at most ``gap`` tokens in between."""
    done, going = [], []
    for a, b, x in sorted(runs, key=lambda r: (r[0], -r[1])):
        done += [c for c in going if a - c[-1][1] - 1 > gap]
        going = [c for c in going if a - c[-1][1] - 1 <= gap]
        fits = []
        for c in going:
            a0, b0, x0 = c[-1]
            y0 = x0 + b0 - a0
            if a > b0 and 0 <= x - y0 - 1 <= gap:
                fits.append((abs(x - a - x0 + a0), -(b0 - c[0][0]), c))
        if fits:
            min(fits, key=lambda f: f[:2])[2].append((a, b, x))
        else:
            going.append([(a, b, x)])
    return done + going


def verified(t: np.ndarray, h: np.ndarray, how: Passages) -> list[tuple[int, int, int, int, float]]:
    """(first, last, first, last, Jaccard) of the passages of ``t`` that stand in ``h``, as token places.

    Runs of shared tokens are joined over gaps of up to two changed words where they follow each other in ``h`` too. A
    joined run counts if the token sets of both sides are similar enough; if not, the longest part of it that is, and
    so on with what is left before and behind that part. A place of ``t`` that one passage covers is not named again.
    """

    def check(part: list[tuple[int, int, int]]):
        a, b, lo, hi = part[0][0], part[-1][1], part[0][2], part[-1][2] + part[-1][1] - part[-1][0]
        if min(b - a, hi - lo) + 1 < how.least:
            return None
        ours, theirs = set(t[a : b + 1].tolist()), set(h[lo : hi + 1].tolist())
        both = len(ours & theirs)
        score = both / (len(ours) + len(theirs) - both)
        return (a, b, lo, hi, score) if score >= how.similarity else None

    def parts(chain: list[tuple[int, int, int]]):
        """The longest parts of a chain that pass, by places without repeats first of all."""
        todo = [(0, len(chain))]
        a, b, x = (np.array(c) for c in zip(*chain))
        n = np.cumsum(b - a + 1)
        while todo:
            i, j = todo.pop()
            if i >= j or b[j - 1] - a[i] + 1 < how.least:
                continue
            got = check(chain[i:j])
            if got is None:
                own = b[None, i:j] - a[i:j, None] + 1
                its = (x + b - a)[None, i:j] - x[i:j, None] + 1
                both = n[None, i:j] - (n - (b - a + 1))[i:j, None]
                # Repeated tokens count once in the sets, so parts somewhat below are looked at too.
                may = (np.minimum(own, its) >= how.least) & (both >= (how.similarity - 0.1) * (own + its - both)) & np.triu(np.ones(own.shape, bool))
                for f, l in sorted(zip(*(z.tolist() for z in np.nonzero(may))), key=lambda z: -own[z]):
                    got = check(chain[i + f : i + l + 1])
                    if got:
                        todo += [(i, i + f), (i + l + 1, j)]
                        break
            if got:
                yield got

    out = []
    chains = [c for c in chains_of(shared_runs(t, h), 2 * how.width) if c[-1][1] - c[0][0] + 1 >= how.least]
    for x in sorted((x for c in chains for x in parts(c)), key=lambda x: (x[0] - x[1], -x[4], x)):
        if not any(a <= x[0] and x[1] <= b for a, b, *_ in out):
            out.append(x)
    return sorted(out)


def few(df: DataFrame, most: int = BROADCAST_TEXTS) -> DataFrame:
    """``df`` marked for broadcast while it has at most ``most`` rows; beyond, the planner shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, _t, _n words), texts (_t, _owner, _copies), and (text, _t) of the owners' rows.

    Only the ids of the copies are compared with the documents, so texts are not shuffled while copies are few.
    """
    hashed = F.xxhash64("text").alias("_t")
    rows = materialise(docs.select("doc_id", hashed, word_count("text").alias("_n")), "rows")
    owners = materialise(rows.groupBy("_t").agg(F.min("doc_id").alias("_owner"), F.count("*").alias("_copies")), "owners")
    copies = rows.join(owners.filter("_copies > 1"), "_t").filter(~F.col("doc_id").eqNullSafe(F.col("_owner")))
    copies = materialise(copies.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_c")).distinct(), "copies")
    texts = docs.select("doc_id", "text", hashed)
    texts = texts.join(few(copies), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_c")), "left_anti")
    return rows, owners, texts.select("text", "_t")


def compared(found: DataFrame, texts: DataFrame, how: Passages) -> DataFrame:
    """(t, start, end, ht, h_start, h_end, similarity): what of the candidates is verified; texts are (_t, text)."""
    # An island may end inside a passage that a neighbouring window goes on with: one passage more on each side.
    wide = {c: F.greatest(F.col(c) - how.least, F.lit(0)) for c in ("l", "hl")} | {c: F.col(c) + how.least + 1 for c in ("r", "hr")}
    found = found.withColumns(wide)
    mine = found.join(texts, found["t"] == texts["_t"]).select("t", "ht", "l", "r", "hl", "hr", "text")
    names = ["t", "ht", "l", "hl", "hr"]

    def sliced(batches):
        """The tokens of a candidate's own region in place of its text."""
        kept = Kept(lambda x: tokens(x, how.width), 64)
        for batch in slices(batches, "text", 256):
            places = zip(batch.column("text").to_pylist(), batch.column("l").to_pylist(), batch.column("r").to_pylist())
            parts = [kept[text][l:r].tobytes() for text, l, r in places]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(parts, pa.binary())], [*names, "part"])

    mine = mine.mapInArrow(sliced, ", ".join(f"{c} {mine.schema[c].dataType.simpleString()}" for c in names) + ", part binary")
    other = texts.select(F.col("_t").alias("_h"), F.col("text").alias("h_text"))
    both = mine.join(other, F.col("ht") == F.col("_h")).drop("_h")
    none = ("t", "start", "end", "ht", "h_start", "h_end", "similarity")

    def run(batches):
        hubs = Kept(lambda x: tokens(x, how.width), 64)
        for batch in slices(batches, "h_text", 256):
            out = {k: [] for k in none}
            for r in batch.to_pylist():
                for a, b, x, y, score in verified(np.frombuffer(r["part"], np.uint64), hubs[r["h_text"]][r["hl"] : r["hr"]], how):
                    for k, v in zip(none, (r["t"], r["l"] + a, r["l"] + b + how.width, r["ht"], r["hl"] + x, r["hl"] + y + how.width, score)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.float64() if k == "similarity" else pa.int64()) for k in none], list(none))

    return both.mapInArrow(run, "t long, start long, end long, ht long, h_start long, h_end long, similarity double").distinct()


def passages(texts: DataFrame, how: Passages = Passages()) -> DataFrame:
    """(t, start, end, ht, h_start, h_end, similarity): verified passages between texts, as word places, ends excluded.

    Texts (text, _t) are named by their hash; each passage of ``t`` points to an equal or similar one of ``ht`` < ``t``.

    A window that shares no passage with its first one may share one with others of its anchor. All windows of such
    anchors go on with runs of more and more tokens around the anchor as keys, the last as long as a passage, and each
    run that no passage covers so far is compared with the first equal one of all texts. So an exact repeat is found
    whatever else has its anchors: at the last length the first one always holds the passage.
    """
    pairs = materialise(links(texts, how), "links")
    found = materialise(candidates(pairs, ENOUGH), "candidates")
    needed = materialise(found.select(F.col("t").alias("_t")).union(found.select("ht")).distinct(), "needed")
    chosen = texts.join(few(needed), "_t", "left_semi").groupBy("_t").agg(F.max("text").alias("text"))
    done = materialise(compared(found, materialise(chosen, "texts"), how), "verified")

    spans = done.select(F.col("t").alias("_t"), "start", "end")
    covers = (F.col("t") == F.col("_t")) & (F.col("c") >= F.col("start")) & (F.col("c") <= F.col("end") - how.width)
    keys = pairs.join(spans, covers, "left_anti").select("key").distinct()
    places = pairs.join(keys, "key", "left_semi")
    places = places.select("t", "c").union(places.select("ht", "hc")).groupBy("t").agg(F.collect_set("c").alias("places"))
    places = materialise(places, "places")
    own = texts.join(few(places.select(F.col("t").alias("_t"))), "_t", "left_semi").groupBy("_t").agg(F.max("text").alias("text"))
    own = materialise(own.join(places, F.col("_t") == F.col("t")).select("_t", "text", "places"), "unverified")
    sizes = sorted({how.least // 3 + 1, how.least * 5 // 6, how.least})
    every = materialise(runs(own.withColumnRenamed("_t", "t"), sizes, how), "runs")
    for size in sizes:
        spans = done.groupBy("t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        found = materialise(candidates(run_links(every.filter(F.col("size") == size), spans, size, how), 1), "candidates")
        more = materialise(compared(found, own.select("_t", "text"), how), "verified")
        done = done.union(more).distinct()
    return done


def repeats(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """(doc_id, start, end, owner_doc_id, owner_start, owner_end, similarity) of every repeated passage of ``docs``.

    A document whose whole text is an earlier document's has one row for all of it, to the smallest doc_id with that
    text; that document stands for its copies in all other rows.
    """
    rows, owners, texts = distinct_texts(docs)
    found = materialise(passages(texts, how), "passages")
    named = rows.join(owners, "_t")
    whole = named.filter((F.col("_n") >= how.min_words) & (F.col("_copies") > 1) & ~F.col("doc_id").eqNullSafe(F.col("_owner")))
    zero, n = F.lit(0).cast("long"), F.col("_n")
    whole = whole.select("doc_id", zero.alias("start"), n.alias("end"), F.col("_owner").alias("owner_doc_id"), zero.alias("owner_start"), n.alias("owner_end"), F.lit(1.0).alias("similarity"))
    mine = owners.select(F.col("_t").alias("_m"), F.col("_owner").alias("doc_id"))
    hubs = owners.select(F.col("_t").alias("_h"), F.col("_owner").alias("owner_doc_id"))
    part = found.join(mine, F.col("t") == F.col("_m")).join(hubs, F.col("ht") == F.col("_h"))
    return whole.union(part.select("doc_id", "start", "end", "owner_doc_id", F.col("h_start").alias("owner_start"), F.col("h_end").alias("owner_end"), "similarity"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; what is left keeps its own spaces."""
    import re

    bounds = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(a, at), min(b, len(bounds))
        if a < b:
            if a > at:
                out.append(text[bounds[at][0] : bounds[a][0]])
            at = b
    if at < len(bounds):
        out.append(text[bounds[at][0] :] if out or at else text)
    return "".join(out)


def drop_repeats(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """``docs`` without repeated passages; of texts that are equal as a whole all keep what is left of the text.

    Documents of which no word is left go; the others keep their columns, ``n_chars`` follows the text.
    """
    found = passages(distinct_texts(docs)[2], how)
    spans = materialise(found.groupBy(F.col("t").alias("_s")).agg(F.collect_set(F.struct("start", "end")).alias("_spans")), "spans")
    marked = docs.withColumn("_t", F.xxhash64("text"))
    marked = marked.join(few(spans, BROADCAST_TEXTS // 8), F.col("_t") == F.col("_s"), "left").drop("_t", "_s")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            x if s is None else cut(x, [(y["start"], y["end"]) for y in s])
            for x, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())
        ]
        return with_columns(batch, {"text": pa.array(texts, pa.string())})

    out = mapped(marked, run, "text", text="string").filter(F.col("_spans").isNull() | (F.trim("text") != "")).drop("_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
