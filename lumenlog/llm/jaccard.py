"""Jaccard join of documents' word n-grams by vertical partitioning.

The global order of n-grams is that of a 64-bit hash. It is cut into fragments, so a document's set falls into pieces,
and two sets overlap by the sum of what their pieces share. Fragments are used twice.

*Candidates.* Linked sets of sizes a and b differ in at most ``d = (a + b)(100 - t) / (100 + t)`` n-grams for a
threshold of t percent. Cut into d + 1 fragments, at least one piece is the same in both. Sets of like size (a *slot*)
are cut alike, and a document has a row per piece: the key of slot, fragment and what the piece holds. Sets that share
no key are not linked. Keys are those of some nine n-grams, so even very frequent n-grams make no frequent key.

*Counting.* A candidate pair is cut into pieces again, shuffled by fragment; each piece counts its overlap and lists
its differences, and counts are summed for each pair.

A group of near copies shares keys without end, so pairs are not listed within a key:

1. every member of a key is counted against one hub, the member that shares most keys;
2. two members y and z that are not linked with their hub alike differ from it in sets Dy and Dz, and are linked only
   if these have enough in common, for ``|y ^ z| = |Dy ^ Dz|``. What a group shares has vanished from these sets. They
   are joined on the prefixes of a rarest-first order that must have an n-gram in common, between different
   components only, and counted as in 1.

Every linked pair of different components meets in 1 or 2, so components are complete.

Defined cases: documents of equal sets are linked; one without words (or null) has an empty set, is linked with nothing
and has its own id as component. A component's id is its smallest id that is not null (null if there is none). Repeated
rows are rows of the result, other columns are not read. Ids must be of an orderable type. Hash values stand for
n-grams: a pair's count would be wrong if two of its n-grams had the same 64 bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise
from lumenlog.llm.arrow import slices
from lumenlog.llm.graph import connected_components

#: Copies of short lists are sent to every task while they have at most so many rows of 16 bytes; beyond, rows are shuffled.
BROADCAST_ROWS = 1_000_000
#: N-grams of the hub in each fragment that overlaps are counted in.
COUNTED = 256
#: Bits of a key that hold its slot.
SLOTS = 0x3FF
#: Fixed value: ASCII capitals and what they become.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Grams:
    """Hashed n-gram sets of texts; hashes of words are kept for the next texts."""

    def __init__(self, width: int):
        self.width = width
        self.words = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Ascending distinct hashes of all ``width`` words in a row (of all words if they are fewer)."""
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > 500_000:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        some = min(self.width, len(words))
        out = np.full(len(words) - some + 1, some, np.uint64)
        for i in range(some):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
        return np.unique(out)


class Threshold:
    """Linked: ``100 * intersection >= percent * union``; all bounds in whole numbers."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent from 50 to 100")
        self.t = percent
        self.firsts = [1]  # smallest size of each class; three steps of the largest ratio of linked sizes make a class
        if percent == 100:
            self.firsts.append(1 << 40)
        while self.firsts[-1] < 1 << 40:
            top = self.firsts[-1]
            for _ in range(3):
                top = max(top, top * 100 // percent)
            self.firsts.append(top + 1)

    def differences(self, total):
        """Most differences of linked sets that have ``total`` members together."""
        return total * (100 - self.t) // (100 + self.t)

    def slots(self, n: int) -> list[tuple[int, int]]:
        """(slot, fragments) in which a set of ``n`` looks for others: those of its class, and above a near border."""
        own = bisect_right(self.firsts, n) - 1
        out = [own] + [own + 1] * (n * 100 // self.t >= self.firsts[own + 1])
        return [(s, f) for s in out if (f := self.differences(2 * (self.firsts[s + 1] - 1)) + 1) > 1]

    def least_shared(self, n: str, slot: str) -> Column:
        """Fragments of a slot that a set of ``n`` has in common with a linked one at least."""
        fragments = F.array(*[F.lit(self.differences(2 * (b - 1)) + 1) for b in self.firsts[1:]])
        last = F.array(*[F.lit(b - 1) for b in self.firsts[1:]])
        largest = F.least(F.expr(f"{n} * 100 div {self.t}"), F.get(last, slot))
        most = F.floor((F.col(n) + largest) * (100 - self.t) / (100 + self.t))
        return F.get(fragments, slot) - most

    def linked(self, a: str, b: str, common: str) -> Column:
        return F.expr(f"{100 + self.t} * {common} >= {self.t} * ({a} + {b})")


def cut(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Places that cut ascending hashes into equal ranges of the order: ``fragments + 1`` ends."""
    at = (grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
    return np.searchsorted(at, np.arange(fragments + 1, dtype=np.uint64))


def keys(grams: np.ndarray, how: Threshold) -> np.ndarray:
    """A key for every fragment of the set's slots; its low bits are the slot."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams), dtype=np.uint64)])
    out = [np.zeros(0, np.uint64)]
    for slot, fragments in how.slots(len(grams)):
        ends = cut(grams, fragments)
        name = mixed(np.arange(fragments, dtype=np.uint64) + np.uint64(slot << 32))
        key = mixed((run[ends[1:]] - run[ends[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + name)
        out.append(key & ~np.uint64(SLOTS) | np.uint64(slot))
    return np.concatenate(out)


def sets(docs: DataFrame, width: int, how: Threshold) -> DataFrame:
    """(doc_id, row, text_hash, digest, n, keys) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, row = Grams(width), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            grams = [read(x) for x in batch.column("text").to_pylist()]
            found = [keys(g, how) if len(g) else g for g in grams]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.arange(row, row + len(grams)), pa.int64()),
                    batch.column("text_hash"),
                    pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in grams], pa.binary()),
                    pa.array([len(g) for g in grams], pa.int64()),
                    lists(found),
                ],
                ["doc_id", "row", "text_hash", "digest", "n", "keys"],
            )
            row += len(grams)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, row long, text_hash long, digest binary, n long, keys array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, ddl)


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast while its counted rows are within the bound; beyond, the planner shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def grams_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, n, grams) of the sets ``wanted`` (sid, text_hash, id), read again from the text of that id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Grams(width)
        for batch in slices(batches, "text"):
            grams = [read(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([len(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], ["sid", "n", "grams"])

    texts = docs.select("text", F.xxhash64("text").alias("_h"), F.col("doc_id").alias("_id"))
    picked = texts.join(few(wanted), (F.col("_h") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("id"))).select("sid", "text")
    return picked.mapInArrow(run, "sid long, n long, grams binary")


def pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per fragment of each row's ``grams``; fragments hold some ``COUNTED`` n-grams of a set of size ``hub_n``."""
    for batch in slices(batches, "grams", 256):
        where, number, parts = [], [], []
        for i, (data, n) in enumerate(zip(batch.column("grams").to_pylist(), batch.column("hub_n").to_pylist())):
            grams = np.frombuffer(data, np.uint64)
            ends = cut(grams, n // COUNTED + 1).tolist()
            where += [i] * (len(ends) - 1)
            number += range(len(ends) - 1)
            parts += [grams[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        kept = batch.select(names).take(pa.array(where, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int32()), pa.array(parts, pa.binary())], [*names, "piece", "part"])


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of two pieces, and the n-grams that only the set (extra) or only the hub (missing) has."""
    names = ["sid", "hub", "n", "hub_n", "piece"]
    for batch in batches:
        common, extra, missing = [], [], []
        for a, b in zip(batch.column("part").to_pylist(), batch.column("hub_part").to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            extra.append(np.setdiff1d(a, b, assume_unique=True))
            missing.append(np.setdiff1d(b, a, assume_unique=True))
            common.append(len(a) - len(extra[-1]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(common, pa.int64()), lists(extra), lists(missing)], [*names, "common", "extra", "missing"])


def counted(pairs: DataFrame, grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlaps of ``pairs`` (sid, hub) by fragments: a stored row per fragment, and (sid, hub, n, hub_n, common)."""
    hubs = grams.select(F.col("sid").alias("hub"), F.col("n").alias("hub_n"), "grams")
    sized = pairs.join(hubs.drop("grams"), "hub").join(grams, "sid")
    left = sized.mapInArrow(lambda b: pieces(b, ["sid", "hub", "n", "hub_n"]), "sid long, hub long, n long, hub_n long, piece int, part binary")
    used = hubs.join(pairs.select("hub").distinct(), "hub", "left_semi")
    right = used.mapInArrow(lambda b: pieces(b, ["hub"]), "hub long, piece int, part binary").withColumnRenamed("part", "hub_part")
    by_piece = left.join(right, ["hub", "piece"]).select("sid", "hub", "n", "hub_n", "piece", "part", "hub_part")
    ddl = "sid long, hub long, n long, hub_n long, piece int, common long, extra array<long>, missing array<long>"
    by_piece = materialise(by_piece.mapInArrow(partial, ddl), "pieces")
    return by_piece, by_piece.groupBy("sid", "hub", "n", "hub_n").agg(F.sum("common").alias("common"))


def labelled(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: the component of ``column`` by ``labels`` (node, component), or itself without a link."""
    to = labels.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_to", column)).drop("_node", "_to")


def apart_from_hub(by_piece: DataFrame, totals: DataFrame, components: DataFrame, how: Threshold) -> DataFrame:
    """(sid, hub): pairs that may be linked though they share only a hub, each between different components.

    ``totals`` has (sid, hub, n, hub_n, common). A family is a hub and the sets counted against it; a member is outside
    if its component is not the hub's. Of a linked pair of different components one is outside, hence not linked with
    the hub. If members differ from the hub in sets D, the pair has at least ``o`` differences in common, with
    ``o >= |D| - n (100 - t) / t`` for either, and ``2 o > |D| + (100 - t)(hub_n - n) / (100 + t)`` for the partner of
    one outside. In any order of the hub's differences, its first ``|D| - o + 1`` meet those of the other one. The order
    is: n-grams that the hub lacks, which few members share, then those that the hub has, each by hash.
    """
    t = how.t
    members = labelled(labelled(totals, "sid", components, "one"), "hub", components, "hub_one")
    members = members.select("sid", "hub", "n", "one", F.expr("n + hub_n - 2 * common").alias("size"), F.expr("one <> hub_one").alias("outside"), (F.col("hub_n") - F.col("n")).alias("longer"))
    members = materialise(members, "members")
    open_hubs = members.groupBy("hub").agg(F.count("*").alias("_m"), F.max("outside").alias("_o")).filter("_m > 1 and _o").select("hub")
    far = f"size - (n * {100 - t}) div {t}"
    both = f"({100 + t} * size + {100 - t} * longer) div {2 * (100 + t)} + 1"
    prefix = F.expr(f"size - greatest(1, {far}, if(outside, 1, {both})) + 1")
    members = members.join(open_hubs, "hub").withColumn("prefix", prefix)
    pieces_of = by_piece.select("sid", "hub", "piece", "extra", "missing").join(members, ["sid", "hub"])
    pair = Window.partitionBy("sid", "hub")
    before = pair.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    extra, missing = F.size("extra"), F.size("missing")
    pieces_of = pieces_of.withColumns(
        {
            "_extra": F.col("prefix") - F.coalesce(F.sum(extra).over(before), F.lit(0)),
            "_missing": F.col("prefix") - F.sum(extra).over(pair) - F.coalesce(F.sum(missing).over(before), F.lit(0)),
        }
    )
    cut_to = lambda part, most: F.slice(part, 1, F.greatest(F.lit(0), F.least(F.size(part), F.col(most))).cast("int"))
    grams = F.concat(cut_to("extra", "_extra"), cut_to("missing", "_missing"))
    rows = materialise(pieces_of.select("hub", F.explode(grams).alias("gram"), "sid", "n", "size", "one", "outside"), "prefixes")
    per = rows.groupBy("hub", "gram", "one").agg(F.count("*").alias("m")).groupBy("hub", "gram")
    mixed_groups = per.agg(F.count("*").alias("_c"), F.max(F.struct("m", "one"))["one"].alias("main")).filter("_c > 1").drop("_c")
    rows = materialise(rows.join(mixed_groups, ["hub", "gram"]), "meeting")
    other = rows.select("hub", "gram", *[F.col(c).alias(f"other_{c}") for c in ("sid", "n", "size", "one", "outside")])
    met = rows.filter("one <> main").join(other, ["hub", "gram"]).filter("one <> other_one and (outside or other_outside)")
    met = met.filter(f"least(n, other_n) * 100 >= greatest(n, other_n) * {t}")
    met = met.filter(f"abs(size - other_size) * {100 + t} <= (n + other_n) * {100 - t}")
    return met.select(F.least("sid", "other_sid").alias("sid"), F.greatest("sid", "other_sid").alias("hub")).distinct()


def sharing(spread: DataFrame, distinct: DataFrame, how: Threshold) -> DataFrame:
    """(key, sid, holders): keys that several sets hold, of the sets that share enough fragments of a slot."""
    common = spread.groupBy("key").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = materialise(spread.join(common, "key").withColumn("slot", F.col("key").bitwiseAND(F.lit(SLOTS)).cast("int")), "shared")
    per = shared.groupBy("sid", "slot").agg(F.count("*").alias("fragments")).join(distinct.select("sid", "n"), "sid")
    enough = per.filter(F.col("fragments") >= how.least_shared("n", "slot")).select("sid", "slot")
    return shared.join(enough, ["sid", "slot"]).select("key", "sid", "holders")


def components(docs: DataFrame, spread: DataFrame, distinct: DataFrame, width: int, how: Threshold) -> DataFrame:
    """(node, component) of the linked ones among ``distinct`` (sid, text_hash, id, n), by the smallest sid.

    ``spread`` has their keys, a row (key, sid) for each.
    """
    shared = materialise(sharing(spread, distinct, how), "sharing")
    central = shared.groupBy("sid").agg(F.sum("holders").alias("weight"))
    held = materialise(shared.join(central, "sid"), "held")
    hubs = held.groupBy("key").agg(F.max(F.struct("weight", (-F.col("sid")).alias("low")))["low"].alias("low")).select("key", (-F.col("low")).alias("hub"))
    pairs = materialise(held.select("key", "sid").join(hubs, "key").filter("sid <> hub").select("sid", "hub").distinct(), "pairs")
    wanted = pairs.select(F.col("sid").alias("_sid")).union(pairs.select("hub")).distinct()
    wanted = materialise(distinct.select("sid", "text_hash", "id").join(wanted, F.col("sid") == F.col("_sid")).drop("_sid"), "wanted")
    grams = materialise(grams_of(docs, wanted, width), "grams")
    if grams.count() > wanted.count():  # the same row several times
        grams = materialise(grams.dropDuplicates(["sid"]), "grams")
    by_piece, totals = counted(pairs, grams)
    totals = materialise(totals, "totals")
    link = how.linked("n", "hub_n", "common")
    first = totals.filter(link).select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    one = materialise(connected_components(first), "components")
    more = materialise(apart_from_hub(by_piece, totals, one, how), "pairs")
    second = counted(more, grams)[1].filter(link).select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    return connected_components(one.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    how = Threshold(percent)
    rows = materialise(sets(docs, width, how), "sets")
    filled = rows.filter("n > 0")
    first = F.min_by(F.struct("row", "text_hash", F.col("doc_id").alias("id"), "n"), "row").alias("s")
    distinct = filled.groupBy("digest").agg(first, F.min("doc_id").alias("low")).select("digest", F.col("s.row").alias("sid"), "s.text_hash", "s.id", "s.n", "low")
    distinct = materialise(distinct, "distinct")
    owner = distinct.select(F.col("digest").alias("_digest"), "sid")
    copies = materialise(filled.select("row", "digest").join(owner, F.col("digest") == F.col("_digest")).filter("row <> sid").select("row"), "copies")
    spread = filled.select("row", "keys").join(few(copies), "row", "left_anti").select(F.explode("keys").alias("key"), F.col("row").alias("sid"))
    found = components(docs, spread, distinct, width, how)
    named = materialise(labelled(distinct.select("digest", "sid", "low"), "sid", found, "component"), "named")
    ids = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_digest = named.join(ids, "component").select(F.col("digest").alias("_digest"), "component_id")
    linked = filled.select("doc_id", "n", "digest").join(by_digest, F.col("digest") == F.col("_digest"))
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
