"""Language-model scores by online logistic context mixing.

A text is its lower-cased words, each ended by one separator, written in bits: every byte is a walk down a binary code
tree made from the corpus' byte counts. Each bit is predicted in several hashed contexts (the bytes before it in its
word, and the whole word so far) from how often it was 0 or 1 there in the training documents. The predictions'
log odds are mixed by weights; which weights, a gate decides by how well the word context is known. The gated weights
are fitted on all training words, each without one occurrence of its own. ``LEANS`` makes further mixes of them:
sharper, flatter, for the short and for the long contexts. Under each the bits of a word multiply to its probability.

Four more chances of a word refine that: its share of the corpus, its share of what followed the word before in the
corpus (exact counts of all words and pairs of words, so what is gathered grows with the corpus; a training document
does not count for itself), and both shares within the text so far. All are averaged by shares of the document's own,
gated by how often the corpus knows the word before; after every ``SEGMENT`` words the shares move to what did well.
Every chance is a distribution over words and uses only what stands before, so the average is one too. A score adds
what all words cost.

Bit contexts do not reach over words, so they are counted once for each distinct word, with its frequency, and worked
out once for each distinct word of a block. Pairs of words travel as packed, sorted 56-bit hashes, a piece for each
block and hash range, to where ranges are summed; the counts return in the same order. The bit tables have fixed sizes
(some 15 MB), whatever the corpus.

Defined cases: a null text has no words; without training documents all counts are zero; null ids are held in; repeated
rows are documents of their own; a text without words has no bits per byte (null); other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm import blocks
from lumenlog.llm.quality import fold
from lumenlog.llm.texts import WORD

#: Bits of the table sizes: contexts of two, three and five bytes, and the word so far.
TABLES = (19, 20, 21, 22)
#: Weights that the fit starts from, by gate: how often the word so far was seen (never, once or twice, up to 15
#: times, more), inside a word and in its first byte.
WEIGHTS = np.array(
    [(0.36, 0.42, 0.40, 0.42), (0.25, 0.41, 0.44, 0.55), (0.13, 0.36, 0.46, 0.46), (0.03, 0.12, 0.41, 0.49)] + [(0.25, 0.25, 0.25, 0.25)] * 4,
    np.float32,
)
#: What the fitted weights of the four contexts are multiplied by in each mix.
LEANS = np.array([(1, 1, 1, 1), (1.3, 1.3, 1.3, 1.3), (0.7, 0.7, 0.7, 0.7), (1.5, 1.2, 0.8, 0.5), (0.5, 0.8, 1.2, 1.4)], np.float32)
#: Documents read side by side, and words whose bits are held at once: few enough for a processor's caches.
TOGETHER = 128
CHUNK = 1 << 12
SEGMENT = 32
#: From how many training occurrences of the word before each gate of the shares begins.
KNOWN = np.array([1, 4, 32])
#: What the mixes, the text's words and pairs, the corpus' words and pairs start with, in words that each got right.
SHARES = np.array([2.0] + [0.5] * (len(LEANS) - 1) + [1.0, 1.0, 6.0, 6.0])
#: Pairs of words in a hash range, counted once for each block.
RANGE = 1 << 21
#: What an unseen bit counts for on either side.
PRIOR = 0.4
PART = 1 << 16


def code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by symbol, nodes, bits): the path of each byte value down the tree of least mean length."""
    heap = [(int(c), s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    groups = {s: [s] for s in range(len(counts))}
    node = 0
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, part in ((0, x), (1, y)):
            for s in groups[part]:
                paths[s].append((node, bit))
        new = len(counts) + node
        groups[new] = groups.pop(x) + groups.pop(y)
        heapq.heappush(heap, (a + b, new, new))
        node += 1
    paths = [p[::-1] for p in paths]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    flat = [x for p in paths for x in p]
    return offsets, np.array([n for n, _ in flat], np.uint32), np.array([b for _, b in flat], np.int8)


def small(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 32, then eight steps for each doubling."""
    n = np.asarray(n, float)
    return np.where(n <= 32, n, np.minimum(255, 32 + np.floor(8 * np.log2(np.maximum(n, 32) / 32)))).astype(np.uint16)


LARGE = np.where(np.arange(256) <= 32, np.arange(256), 32 * 2.0 ** ((np.arange(256) - 32 + 0.5) / 8))
ZEROS, ONES = LARGE[np.arange(1 << 16) & 255], LARGE[np.arange(1 << 16) >> 8]


#: Log odds of a pair of counts before anything is known about how well counts predict.
PLAIN = np.log((ONES + PRIOR) / (ZEROS + PRIOR)).astype(np.float32)
CONFIDENCE = sum((ZEROS + ONES > n).astype(np.int8) for n in (0, 2, 15))
#: The pair without the one occurrence that is being predicted, by its bit. Beyond the exact counts one is no change;
#: a step there would give the bit away.
LOW, HIGH = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
LESS = np.stack([np.arange(1 << 16) - ((LOW > 0) & (LOW <= 32)), np.arange(1 << 16) - 256 * ((HIGH > 0) & (HIGH <= 32))])


@dataclass
class Walks:
    """The bits of some words in a row: places in each table, the bit, whether it is in a word's first byte."""

    places: list[np.ndarray]
    bits: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # of each word, and the end


def walks(words: list[bytes], tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Walks:
    offsets, nodes, bits = tree
    text = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    n = len(text)
    size = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    p1 = np.full(n, 32, np.uint32)
    p1[1:] = text[:-1]
    back = [p1]
    for i in range(2, 6):  # the bytes before; at the start of a word there are only spaces
        p = np.full(n, 32, np.uint32)
        p[i:] = text[:-i]
        back.append(np.where(back[-1] == 32, np.uint32(32), p))
    # Hash of the word so far: differences of a running sum over powers of an odd number.
    base, inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    up = np.cumprod(np.full(n, base)) if n else np.zeros(0, np.uint64)
    down = np.cumprod(np.full(n, inverse)) if n else up
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text + np.uint64(1)) * up)])
    at = np.repeat(starts, size)
    prefix = (run[np.arange(n)] - run[at]) * down[at]
    prefix = ((prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    two = back[0] << np.uint32(8) | back[1]
    three = two * np.uint32(0x9E3779B1) ^ back[2] * np.uint32(0x85EBCA77)
    five = three * np.uint32(0x9E3779B1) ^ (back[3] << np.uint32(8) | back[4]) * np.uint32(0xC2B2AE3D)
    lengths = np.diff(offsets)[text]
    which = np.repeat(np.arange(n, dtype=np.int32), lengths)
    inside = np.arange(len(which)) + np.repeat(offsets[text] - np.cumsum(lengths) + lengths, lengths)
    node = nodes[inside]
    places = []
    spread = node * np.uint32(0xC2B2AE3D)
    for context, width in zip((two, three, five, prefix), TABLES):
        h = (context[which] ^ spread) * np.uint32(0x27D4EB2F)
        places.append(((h ^ h >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - width)).astype(np.int32))
    total = np.concatenate([[0], np.cumsum(lengths)])
    return Walks(places, bits[inside], (which == at[which]), total[np.concatenate([starts, [n]])])


def standing(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how often each key stands before its place, how often anywhere, which of the distinct keys it is).

    Keys are not negative. With the place in their low bits they are sorted as plain numbers, several times as fast.
    """
    n = len(key)
    bits = max(n - 1, 1).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 64:
        merged = np.sort(key << bits | np.arange(n))
        order, ordered = merged & (1 << bits) - 1, merged >> bits
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    before, total, number = (np.empty(n, np.int64) for _ in range(3))
    before[order] = np.arange(n) - np.repeat(first, size)
    total[order] = np.repeat(size, size)
    number[order] = np.repeat(np.arange(len(first)), size)
    return before, total, number


def repeated(sequence: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place in its document; of its document's words, how often each stands before it and anywhere; of pairs, alike)."""
    doc = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(sequence)) - np.repeat(np.cumsum(per) - per, per)
    words, all_words, number = standing(doc * (int(sequence.max(initial=0)) + 1) + sequence)
    # Numbers of the distinct words of each document, so a pair is one number too and no two pairs share it.
    pairs, all_pairs, _ = standing(np.roll(number, 1) * (int(number.max(initial=0)) + 1) + number)
    return place, words, all_words, pairs, all_pairs


def history(sequence: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each word among the words before it in its text, and among those that followed the same word before."""
    place, words, _, pairs, _ = repeated(sequence, per)
    contexts = np.roll(words, 1)
    return words / np.maximum(place, 1), np.where((place > 0) & (contexts > 0), pairs / np.maximum(contexts, 1), 0)


def pairs_of(words: list[bytes], sequence: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 56-bit hashes of neighbouring words, ascending; places of words with one before; which pair each is)."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    at = np.flatnonzero(np.arange(len(sequence)) != np.repeat(np.cumsum(per) - per, per))
    left, right = h[sequence[at - 1]], h[sequence[at]]
    k = (left ^ left >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + right
    k = (k ^ k >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    found, which = np.unique(k >> np.uint64(8), return_inverse=True)
    return found, at, which


def cuts(found: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins in ascending hashes, and the end."""
    first = -(-(np.arange(ranges + 1, dtype=object) << 56) // ranges)
    return np.searchsorted(found, np.array(first, np.uint64))


def pack_hashes(found: np.ndarray) -> bytes:
    steps = np.diff(found, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pair_counts(table: DataFrame, ranges: int) -> DataFrame:
    """(block, place, data): for each block and hash range, the corpus' training counts of the block's pairs."""

    def emit(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                sequence, per = blocks.numbers(row, "terms"), blocks.numbers(row, "per")
                found, at, which = pairs_of([w.encode() for w in row.column("words")[0].as_py()], sequence, per)
                learn = np.repeat(~np.array(row.column("held_out")[0].as_py(), bool), per)
                taught = np.bincount(which, learn[at], len(found))
                edges = cuts(found, ranges)
                some = np.flatnonzero(np.diff(edges))
                parts = [slice(edges[r], edges[r + 1]) for r in some]
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array(some),
                        "block": pa.array([batch.column("block")[i].as_py()] * len(some), pa.int64()),
                        "hashes": pa.array([pack_hashes(found[p]) for p in parts], pa.binary()),
                        "taught": pa.array([blocks.pack(taught[p]) for p in parts], pa.binary()),
                    }
                )

    def add(of: pa.Table) -> pa.Table:
        hashes = [unpack_hashes(x.as_py()) for x in of.column("hashes")]
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, np.concatenate([blocks.unpack(x.as_py()) for x in of.column("taught")]))
        total = np.minimum(total, (1 << 32) - 1)[which]
        edges = np.cumsum([0] + [len(h) for h in hashes])
        data = [blocks.pack(total[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.Table.from_pydict({"block": of.column("block"), "place": of.column("range"), "data": pa.array(data, pa.binary())})

    pieces = table.select("block", "words", "terms", "per", "held_out").mapInArrow(emit, "range long, block long, hashes binary, taught binary")
    return pieces.groupBy("range").applyInArrow(add, "block long, place long, data binary")


@dataclass
class Model:
    """Code tree, count tables, log odds by pair of counts for each table, weights, chances of empty and last."""

    tree: tuple[np.ndarray, np.ndarray, np.ndarray]
    tables: list[np.ndarray]
    odds: np.ndarray
    weights: np.ndarray = field(default_factory=WEIGHTS.copy)
    empty: float = 0.5
    end: float = 0.5
    n_words: int = 0

    def pairs(self, w: Walks, others: bool = False) -> list[np.ndarray]:
        """The pair of counts that each bit finds in each table, if asked for without its own occurrence."""
        found = [t[p] for t, p in zip(self.tables, w.places)]
        return [LESS[w.bits, p] if others else p for p in found]

    def signals(self, w: Walks, others: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of each context for the bit that came, gate of each bit)."""
        pairs = self.pairs(w, others)
        sign = (2 * w.bits - 1).astype(np.float32)
        signs = np.stack([o[p] * sign for o, p in zip(self.odds, pairs)], 1)
        gate = CONFIDENCE[pairs[-1]] + 4 * w.first.astype(np.int8)
        return signs, gate

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word under each of the mixes."""
        out = np.zeros((len(words), len(LEANS)))
        for i in range(0, len(words), CHUNK):
            w = walks(words[i : i + CHUNK], self.tree)
            of = self.pairs(w)
            sign = (2 * w.bits - 1).astype(np.float32)
            gate = CONFIDENCE[of[-1]] + 4 * w.first.astype(np.int8)
            pulls = [odds[p] * sign * weight[gate] for odds, p, weight in zip(self.odds, of, np.ascontiguousarray(self.weights.T))]
            for mix, lean in enumerate(LEANS):  # one row of bits at a time: sums along rows are the fast ones
                z = pulls[0] * lean[0]
                for pull, times in zip(pulls[1:], lean[1:]):
                    z += pull * times
                np.clip(z, -30, 30, out=z)
                wrong = np.exp(np.negative(z, out=z), out=z)
                out[i : i + CHUNK, mix] = -np.add.reduceat(np.log1p(wrong, out=wrong), w.starts[:-1], dtype=np.float64)
        return out

    def shared(self, sequence: np.ndarray, per: np.ndarray, learn: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chances of each word by the text's words and pairs so far, the corpus' words and pairs; gate of the shares)."""
        place, words, all_words, so_far, all_pairs = repeated(sequence, per)
        contexts = np.roll(words, 1)
        taught = np.repeat(learn, per)
        other = count[sequence] - np.where(taught, all_words, 0)
        rest = np.maximum(np.repeat(self.n_words - np.where(learn, per, 0), per), 1)
        before = np.where(place > 0, np.roll(other, 1), 0)
        both = pairs - np.where(taught, all_pairs, 0)
        inside = (place > 0) & (contexts > 0)
        chances = np.stack(
            [
                words / np.maximum(place, 1),
                np.where(inside, so_far / np.maximum(contexts, 1), 0),
                other / rest,
                np.where(before > 0, both / np.maximum(before, 1), 0),
            ],
            1,
        )
        return chances, np.searchsorted(KNOWN, before, side="right")

    def scores(self, words: list[bytes], sequence: np.ndarray, per: np.ndarray, learn: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Log10 probability of each document: ``per`` words each of ``sequence``, places in ``words``.

        ``count`` has the training occurrences of each of ``words``, ``pairs`` those of each word of ``sequence``
        with the word before it; ``learn`` says which documents are among them.
        """
        spelled = self.spelled(words)
        # Words too long for a probability of their own in a float are held relative to their best mix.
        best = spelled.max(axis=1, initial=-np.inf)
        offset = np.where(best < -600, best, 0.0)
        spelled = np.exp(spelled - offset[:, None])
        ends = np.cumsum(per)
        begins = ends - per
        chances, gate = np.empty((len(sequence), 4)), np.empty(len(sequence), np.int64)
        for i in range(0, len(per), 256):
            a, b = int(begins[i]), int(ends[min(i + 256, len(per)) - 1])
            chances[a:b], gate[a:b] = self.shared(sequence[a:b], per[i : i + 256], learn[i : i + 256], count, pairs[a:b])
        gates = len(KNOWN) + 1
        order = np.argsort(-per, kind="stable")
        cost = np.zeros(len(per))
        for i in range(0, len(per), TOGETHER):
            docs = order[i : i + TOGETHER]
            shares = np.tile(SHARES, (len(docs) * gates, 1))
            for at in range(0, int(per[docs].max(initial=0)), SEGMENT):
                docs = docs[per[docs] > at]
                n = np.minimum(per[docs] - at, SEGMENT)
                lead = np.cumsum(n) - n
                where = np.repeat(begins[docs] + at - lead, n) + np.arange(n.sum())
                tokens = sequence[where]
                row = np.repeat(np.arange(len(docs)) * gates, n) + gate[where]
                each = np.concatenate([spelled[tokens], chances[where]], 1)
                far = offset[tokens]
                if far.any():
                    known = (far < 0) & each[:, len(LEANS) :].any(axis=1)
                    each[known, : len(LEANS)] = 0
                    far[known] = 0
                mine = shares[: len(docs) * gates]
                each *= (mine / mine.sum(axis=1, keepdims=True))[row]
                total = each.sum(axis=1)
                cost[docs] -= np.add.reduceat(np.log(total) + far, lead)
                each /= total[:, None]
                for e in range(each.shape[1]):
                    mine[:, e] += np.bincount(row, each[:, e], len(mine))
        some = per > 0
        cost += np.where(some, -np.log1p(-self.empty) - np.maximum(per - 1, 0) * np.log1p(-self.end) - np.log(self.end), -np.log(self.empty))
        return -cost / np.log(10)


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Words:
    """Lower-cased words of texts as numbers."""

    def __init__(self):
        self.numbers = Numbers()

    @property
    def vocabulary(self) -> list[str]:
        return [w.decode() for w in self.numbers]

    def terms(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, text.encode().lower().split()), np.int32)


def word_batches(batches):
    """(words as bytes, counts) in parts small enough for the bit arrays."""
    for batch in batches:
        words, counts = batch.column("word").cast(pa.binary()).to_pylist(), batch.column("c").to_numpy().astype(float)
        for i in range(0, len(words), CHUNK):
            yield words[i : i + CHUNK], counts[i : i + CHUNK]


def byte_counts(words: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(256)
        for some, counts in word_batches(batches):
            text = np.frombuffer(b" ".join([*some, b""]), np.uint8)
            total += np.bincount(text, np.repeat(counts, [len(w) + 1 for w in some]), 256)
        yield pa.RecordBatch.from_pydict({"byte": pa.array(range(256)), "n": total.astype(np.int64)})

    out = np.zeros(256, np.int64)
    for r in words.mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def count_tables(words: DataFrame, tree) -> list[np.ndarray]:
    """Zeros and ones at every place of every table, each pair in two bytes.

    A task adds up its words in arrays of fixed size; parts of these arrays meet in sorted partitions and are added as
    they stream by. What reaches the driver are the finished tables.
    """
    edges = np.concatenate([[0], np.cumsum([2 << w for w in TABLES])])

    def count(batches):
        total = np.zeros(edges[-1], np.float64)
        any_word = False
        for some, counts in word_batches(batches):
            any_word = True
            w = walks(some, tree)
            weight = np.repeat(counts, np.diff(w.starts))
            for t, place in enumerate(w.places):
                np.add.at(total, edges[t] + 2 * place.astype(np.int64) + w.bits, weight)
        for i in range(0, edges[-1] if any_word else 0, PART):
            part = total[i : i + PART]
            if part.any():
                data = np.concatenate([part % (1 << 32), part // (1 << 32)]).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"part": pa.array([i // PART]), "data": pa.array([blocks.pack(data)], pa.binary())})

    def add(batches):
        now, total = None, None

        def done():
            pairs = total.reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"part": pa.array([now]), "data": pa.array([(small(pairs[:, 0]) | small(pairs[:, 1]) << 8).astype("<u2").tobytes()], pa.binary())})

        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                if part != now:
                    if now is not None:
                        yield done()
                    now, total = part, np.zeros(PART)
                low, high = blocks.unpack(data.as_py()).astype(np.float64).reshape(2, -1)
                total += low + high * (1 << 32)
        if now is not None:
            yield done()

    kind = "part long, data binary"
    pieces = words.mapInArrow(count, kind).repartition("part").sortWithinPartitions("part").mapInArrow(add, kind)
    flat = np.zeros(edges[-1] // 2, np.uint16)
    for r in pieces.collect():
        flat[r.part * PART // 2 : (r.part + 1) * PART // 2] = np.frombuffer(r.data, "<u2")
    return [flat[a // 2 : b // 2] for a, b in zip(edges, edges[1:])]


def summed(words: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all tasks of the arrays that ``add(total, words, counts)`` fills."""

    def run(batches):
        total = np.zeros(size)
        for some, counts in word_batches(batches):
            add(total, some, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at), "x": pa.array(total[at])})

    out = np.zeros(size)
    for r in words.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r.i] = r.x
    return out


def fit_odds(words: DataFrame, model: Model) -> np.ndarray:
    """For each table, log odds of a one after a pair of counts, as all words bear out, each without itself."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def add(total, some, counts):
        w = walks(some, shared.value.tree)
        weight = np.repeat(counts, np.diff(w.starts))
        for t, pair in enumerate(shared.value.pairs(w, others=True)):
            np.add.at(total, (t << 17) + pair.astype(np.int64) * 2 + w.bits, weight)

    seen = summed(words, len(TABLES) << 17, add).reshape(len(TABLES), -1, 2)
    prior = 1 / (1 + np.exp(-PLAIN.astype(float)))
    ones, zeros = seen[:, :, 1] + 2 * prior, seen[:, :, 0] + 2 * (1 - prior)
    return np.log(ones / zeros).astype(np.float32)


def fit_weights(words: DataFrame, model: Model, rounds: int = 2) -> np.ndarray:
    """Gated weights by Newton steps on all training words, each bit predicted without its own occurrence.

    A step needs, for each gate, the sums of the gradient and of the curvature; they merge over tasks.
    """
    k, gates = len(TABLES), len(WEIGHTS)
    wide = k + k * k
    weights = model.weights.astype(float)
    shared = words.sparkSession.sparkContext.broadcast(model)
    for _ in range(rounds):

        def add(total, some, counts, weights=weights.astype(np.float32)):
            w = walks(some, shared.value.tree)
            signs, gate = shared.value.signals(w, others=True)
            wrong = 0.5 - 0.5 * np.tanh(0.5 * np.einsum("ij,ij->i", signs, weights[gate]))
            weight = np.repeat(counts, np.diff(w.starts))
            sums = total.reshape(gates, wide)
            for g in range(gates):
                of = np.flatnonzero(gate == g)
                s, e, c = signs[of], wrong[of], weight[of]
                sums[g, :k] += (c * e) @ s
                sums[g, k:] += (s.T @ (s * (c * e * (1 - e))[:, None])).ravel()

        seen = summed(words, gates * wide, add).reshape(gates, wide)
        for g in range(gates):
            bend = seen[g, k:].reshape(k, k)
            pull = 1.0 + 1e-6 * np.trace(bend)
            move = np.linalg.solve(bend + pull * np.eye(k), seen[g, :k] - pull * (weights[g] - WEIGHTS[g]))
            weights[g] = np.clip(weights[g] + np.clip(move, -0.3, 0.3), -1, 2)
    return weights.astype(np.float32)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    Learns from the documents outside fold 1; ``score`` is the model's log10 probability of the text.
    """
    spark = docs.sparkSession
    picked = docs.select("doc_id", "text", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"))
    picked = picked.withColumn("_learns", ~F.col("held_out")).withColumn("blank", ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    table = blocks.build(picked, Words, ["doc_id", "held_out", "blank"], "_learns", ordered=True)
    same = Window.partitionBy("word")
    # The finer order first: the sum then needs no sort of its own.
    values = blocks.terms(table).withColumn("_one", F.row_number().over(same.orderBy("block")) == 1).withColumn("c", F.sum("taught").over(same))
    values = blocks.stored(values.select("word", "block", "place", "c", "_one"), "words")
    words = values.filter("_one and c > 0").select("word", "c")
    learned = table.select(F.explode(F.arrays_zip("held_out", "blank")).alias("d")).filter("not d.held_out").agg(F.count("*").alias("docs"), F.count_if("d.blank").alias("empty")).first()
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_words, distinct = total.n or 0, total.v
    train = n_words + learned.docs
    kinds = distinct + (learned.docs > 0)
    tree = code_tree(byte_counts(words) + 1)
    model = Model(tree, count_tables(words, tree), np.stack([PLAIN] * len(TABLES)))
    model.odds = fit_odds(words, model)
    model.weights = fit_weights(words, model)
    model.n_words = n_words
    model.empty = (learned.empty + 0.5) / (learned.docs + 1)
    model.end = min(0.5, (learned.docs - learned.empty + 0.5) / (n_words + 1))
    shared = spark.sparkContext.broadcast(model)
    below, ends = train + 0.5 * (kinds + 1), learned.docs
    ranges = 1 + n_words // RANGE
    counted = values.select("block", "place", "c", F.lit(None).cast("binary").alias("data"))
    counted = counted.unionByName(pair_counts(table, ranges).withColumn("c", F.lit(None).cast("long")))

    def run(of: pa.Table, block: pa.Table) -> pa.Table:
        of = of.sort_by("place")
        count = of.filter(pc.is_valid(of["c"])).column("c").to_numpy().astype(np.int64)
        both = of.filter(pc.is_valid(of["data"])).column("data").to_pylist()
        sequence, per = blocks.numbers(block, "terms"), blocks.numbers(block, "per")
        stops = np.cumsum(per)
        starts = stops - per
        cost = np.log10((count + 0.5) / below)[sequence]
        base = np.full(len(per), np.log10((ends + 0.5) / below))
        some = np.flatnonzero(per)
        if len(some):
            base[some] += np.add.reduceat(cost, starts[some])
        known = np.concatenate([[0], np.cumsum(count[sequence] > 0)])
        words = [w.encode() for w in block.column("words")[0].as_py()]
        _, at, which = pairs_of(words, sequence, per)
        pairs = np.zeros(len(sequence), np.int64)
        if len(at):
            pairs[at] = np.concatenate([blocks.unpack(x) for x in both]).astype(np.int64)[which]
        learn = ~np.array(block.column("held_out")[0].as_py(), bool)
        score = shared.value.scores(words, sequence, per, learn, count, pairs)
        size = np.concatenate([[0], np.cumsum(np.array([len(w) + 1 for w in words], np.int64)[sequence])])
        size = size[stops] - size[starts]
        cols = blocks.carried(block, ["doc_id", "held_out"])
        cols |= {"n_tokens": pa.array(per + 1), "n_known": pa.array(known[stops] - known[starts] + (ends > 0)), "train_tokens": pa.array(np.full(len(per), train))}
        return pa.Table.from_pydict(cols | {"base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / np.maximum(size, 1), mask=size == 0)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.joined(table, counted, run, ["doc_id", "held_out"], ddl, "words")
