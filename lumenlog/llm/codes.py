"""Codes of vectors: each part's nearest entry of a codebook in whole numbers, found with LAESA pivots.

A vector's components become whole numbers and are cut into equal parts. A part position has a codebook, whose entries
are refined in rounds: every part goes to its nearest entry, and an entry becomes the floor of its parts' mean.

LAESA: a few pivots per part position, spread over the first codebook, stay fixed. Distances of all parts to the pivots
are computed once and stored with the vectors. In a round only the entries' distances to the pivots are new; by the
triangle inequality the largest difference of the two is a lower bound of a part's distance to an entry. Entries are
tried in the order of their bounds, by exact whole numbers, until the next bound is beyond the best distance found.

What the driver holds is codebooks: ``parts * entries`` rows of whole numbers, whatever the size of the table. A task
adds up its parts by entry and emits those sums, which Spark adds by (part, entry, component).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise
from lumenlog.llm.arrow import schema_with, slices, with_columns
from lumenlog.llm.shards import finite, matrix, same_width

#: Entries that are tried at a time, after the one with the least bound.
STEP = 12
#: Share and amount by which rounding may raise a bound, both far above what double precision needs.
SLACK = 1e-9


@dataclass(frozen=True)
class Codes:
    """``coded`` (the columns of the vectors, and code, error) and the final codebooks, an array (entries, width) per part."""

    coded: DataFrame
    codebooks: list[np.ndarray]

    def text(self) -> str:
        """All entries' components by part, entry and place, comma-joined."""
        return ",".join(str(x) for book in self.codebooks for x in book.ravel().tolist())


def whole(vectors: np.ndarray, scale: float, most: int) -> np.ndarray:
    """Floors of the scaled components, held within ``most`` either way."""
    return np.clip(np.floor(vectors * scale), -most, most).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row to every pivot."""
    out = np.empty((len(x), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(axis=1).astype(np.float64))
    return out


def spread_pivots(book: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: each next one is the farthest from those before it (the first is entry 0)."""
    chosen = [0]
    nearest = distances(book, book[:1])[:, 0]
    while len(chosen) < min(count, len(book)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, distances(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, book_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row: least distance, then least entry.

    Bounds order the entries of a row; it is done when its next bound exceeds its best distance.
    """
    bound = np.zeros((len(x), len(book)))
    for i in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, i, None] - book_to_pivots[None, :, i]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) * (1 - SLACK) - SLACK
    best = np.full(len(x), np.iinfo(np.int64).max)
    entry = np.zeros(len(x), np.int64)
    rows, at = np.arange(len(x)), 0
    while len(rows) and at < len(book):
        tried = order[rows, at : at + (STEP if at else 1)]
        exact = ((x[rows, None, :] - book[tried]) ** 2).sum(axis=2)
        least = exact.min(axis=1)
        first = np.where(exact == least[:, None], tried, len(book)).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < entry[rows]))
        best[rows] = np.where(better, least, best[rows])
        entry[rows] = np.where(better, first, entry[rows])
        at += tried.shape[1]
        if at < len(book):
            rows = rows[bound[rows, at] <= np.sqrt(best[rows].astype(np.float64))]
    return entry, best


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, pivots: int = 8) -> Codes:
    """Codes of ``vectors`` (vec_id, embedding): columns ``code`` and ``error`` are put to the rows that take part.

    ``code`` has two hex digits for each part, ``error`` sums the squared distances. A codebook starts as that part of
    the ``entries`` (256 at most) smallest vec_ids; an entry without parts stays as it is.

    Defined cases: a vector that is null or holds null or non-finite components is left out. Vectors shorter than the
    longest one, and lengths that are no multiple of ``parts``, are filled with zeros. Components are held within
    ``sqrt(2^60 / length)`` after scaling (1e8 for 64 components), so that sums of squares are exact in 64 bits. A null
    vec_id comes after all others; rows of equal vec_id are ordered by their components. Repeated rows count and are
    coded each. Other columns stay, unless their names are code or error. An empty table has empty codebooks.
    """
    kept = vectors.filter(finite(F.col("embedding")))
    length = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-length // parts)
    most = int((2**60 / max(1, parts * width)) ** 0.5)
    lowest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    start = whole(same_width(matrix(lowest.column("embedding")), parts * width), scale, most)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    if not len(start):
        return Codes(kept.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books)
    fixed = [spread_pivots(b, pivots) for b in books]
    rows = max(16, min(1024, (1 << 21) // max(1, STEP * width)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=rows):
            x = whole(same_width(matrix(pa.chunked_array([batch.column("embedding")])), parts * width), scale, most)
            to = np.concatenate([distances(x[:, p * width : (p + 1) * width], fixed[p]) for p in range(parts)], axis=1)
            yield with_columns(batch, {"_x": pa.array([r.tobytes() for r in x], pa.binary()), "_to": pa.array([r.tobytes() for r in to], pa.binary())})

    table = materialise(kept.mapInArrow(measured, schema_with(kept, _x="binary", _to="binary")), "measured")

    def assigned(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: (the rows' components, entries, squared distances)."""
        x = np.frombuffer(b"".join(batch.column("_x").to_pylist()), np.int64).reshape(batch.num_rows, -1)
        to = np.frombuffer(b"".join(batch.column("_to").to_pylist()), np.float64).reshape(batch.num_rows, -1)
        at = 0
        for p, book in enumerate(books):
            mine = x[:, p * width : (p + 1) * width]
            n = len(fixed[p])
            yield mine, *nearest_entries(mine, to[:, at : at + n], book, distances(book, fixed[p]))
            at += n

    def summed(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((parts, len(start)), np.int64)
            sums = np.zeros((parts, len(start), width), np.int64)
            for batch in slices(batches, rows=rows):
                for p, (x, entry, _) in enumerate(assigned(batch, books)):
                    counts[p] += np.bincount(entry, minlength=len(start))
                    np.add.at(sums[p], entry, x)
            where, which = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array(where, pa.int32()), "entry": pa.array(which, pa.int32()), "n": counts[where, which], "total": pa.array(list(sums[where, which]), pa.list_(pa.int64()))})

        by_task = table.select("_x", "_to").mapInArrow(run, "part int, entry int, n long, total array<long>")
        by_place = by_task.select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
        return by_place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    for _ in range(rounds if width else 0):
        got = summed(books).toArrow()  # at most parts * entries * width rows
        part, entry, place, n, total = (got.column(c).to_numpy() for c in ("part", "entry", "place", "n", "total"))
        books = [b.copy() for b in books]
        for p, book in enumerate(books):
            own = part == p
            book[entry[own], place[own]] = total[own] // n[own]

    final = books

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=rows):
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, (_, entry, squared) in enumerate(assigned(batch, final)):
                codes[:, p] = entry
                error += squared
            out = with_columns(batch, {"code": pa.array([r.tobytes().hex() for r in codes], pa.string()), "error": pa.array(error)})
            yield out.drop_columns(["_x", "_to"])

    plain = table.drop("_x", "_to")
    return Codes(table.mapInArrow(coded, schema_with(plain, code="string", error="long")), final)


def with_label_error(coded: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """``coded`` (stored) with ``label_error``: ``error`` summed over the rows of the same ``label``, nulls together.

    Sums are aggregated first. They are broadcast while they are at most ``bound`` rows (counted); beyond, labels are
    shuffled, where a frequent one is a skewed join that Spark splits.
    """
    sums = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_sums")
    sums = F.broadcast(sums) if sums.count() <= bound else sums
    return coded.drop("label_error").join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
