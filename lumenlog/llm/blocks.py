"""Term frequencies of documents in blocks, for sums over terms whose values come from the whole corpus.

A row per (document, term) would be the largest table of the job. Instead a task turns some thousand documents into
one block: its distinct terms once, and the frequencies of all its documents as packed arrays. Only a row for each
term of a block is shuffled to where the term's value is found, and back to the block, where the documents' sums are
a sparse product. A frequent term has a row per block and not per document, so no term is hot. A block's size is
bounded by documents and bytes (a single longer text makes a block of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.storage import shared_dir
from lumenlog.llm.arrow import slices


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers as byte planes under zstandard: small numbers cost little more than a byte."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, as small as possible, and read again."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Block:
    """Documents gathered in a task. ``terms(text)`` gives a text's terms as numbers, ``vocabulary`` maps term to number."""

    def __init__(self, reader):
        self.reader, self.ids, self.lengths, self.learn, self.carried, self.size = reader, [], [], [], [], 0

    def add(self, text: str | None, learn: bool, carried: tuple) -> None:
        ids = self.reader.terms(text or "")
        self.ids.append(ids)
        self.lengths.append(len(ids))
        self.learn.append(learn)
        self.carried.append(carried)
        self.size += len(text or "")

    def row(self, number: int, carry: list[pa.Field], ordered: bool) -> dict:
        lengths = np.array(self.lengths, np.int64)
        ids = np.concatenate(self.ids).astype(np.int64)
        words = list(self.reader.vocabulary)
        n = max(1, len(words))
        taught = np.bincount(ids, np.repeat(np.array(self.learn, float), lengths), n).astype(np.int64)
        order = np.argsort(-np.bincount(ids, minlength=n), kind="stable")  # frequent terms get small numbers
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        if ordered:
            steps, counts, per = place[ids], ids[:0], lengths
        else:
            keys, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + place[ids], return_counts=True)
            rows, terms = keys // n, keys % n
            steps = np.diff(terms, prepend=0)
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            steps[first] = terms[first]
            per = np.bincount(rows, minlength=len(lengths))
        return {
            "block": number,
            "words": [words[i] for i in order[: len(words)]],
            "taught": taught[order][: len(words)],
            "terms": pack(steps),
            "counts": pack(counts),
            "per": pack(per),
        } | {f.name: pa.array([c[i] for c in self.carried], f.type.value_type) for i, f in enumerate(carry)}


def build(docs: DataFrame, reader: Callable[[], object], carry: Sequence[str], learn: str | None = None, rows: int = 4096, size: int = 16 << 20, ordered: bool = False) -> DataFrame:
    """A row per block: (block, words, taught, terms, counts, per, and an array for each column of ``carry``).

    ``taught`` counts each word in the rows where ``learn`` is true (all rows by default). With ``ordered``, ``terms``
    holds the documents' terms in their order instead of frequencies. The result is stored.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carry}
    ddl = "block long, words array<string>, taught array<long>, terms binary, counts binary, per binary, " + ", ".join(f"{c} array<{k}>" for c, k in kinds.items())
    picked = docs.select("text", *carry, (F.coalesce(F.col(learn), F.lit(False)) if learn else F.lit(True)).alias("_learn"))

    def run(batches):
        number, now, carried = TaskContext.get().partitionId() << 32, None, None

        def done():
            row = now.row(number, carried, ordered)
            cols = {k: pa.array([v], pa.list_(pa.string()) if k == "words" else pa.list_(pa.int64()) if k == "taught" else None) for k, v in row.items() if k not in kinds}
            for f in carried:
                v = row[f.name]
                cols[f.name] = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            return pa.RecordBatch.from_pydict(cols)

        for batch in slices(batches, "text"):
            carried = [pa.field(c, pa.list_(batch.schema.field(c).type)) for c in kinds]
            columns = [batch.column(c).to_pylist() for c in kinds]
            for text, teach, *values in zip(batch.column("text").to_pylist(), batch.column("_learn").to_pylist(), *columns):
                if now is not None and (len(now.ids) >= rows or now.size + len(text or "") > size):
                    yield done()
                    now, number = None, number + 1
                if now is None:
                    now = Block(reader())
                now.add(text, teach, tuple(values))
        if now is not None:
            yield done()

    return stored(picked.mapInArrow(run, ddl), "blocks")


def terms(blocks: DataFrame) -> DataFrame:
    """(word, block, place, taught): a row per distinct term of each block."""
    both = F.arrays_zip("words", "taught")
    return blocks.select("block", F.posexplode(both).alias("place", "_e")).select(F.col("_e.words").alias("word"), "block", "place", F.col("_e.taught").alias("taught"))


def carried(block: pa.Table, names: Sequence[str]) -> dict[str, pa.Array]:
    """The carried columns of a block's one row, a value per document."""
    out = {}
    for c in names:
        lists = block.column(c).combine_chunks()
        out[c] = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[1].as_py() - lists.offsets[0].as_py())
    return out


def numbers(block: pa.Table, name: str) -> np.ndarray:
    return unpack(block.column(name)[0].as_py()).astype(np.int64)


def sums(blocks: DataFrame, values: DataFrame, names: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The carried columns of every document with the sums of frequency times value for the long columns ``names``.

    ``values`` has (block, place) and those columns.
    """
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in carry}

    def run(of: pa.Table, block: pa.Table) -> pa.Table:
        place = of.column("place").to_numpy()
        per, counts, steps = (numbers(block, c) for c in ("per", "counts", "terms"))
        ends = np.cumsum(per)
        starts = ends - per
        run_on = np.cumsum(steps)
        before = np.concatenate([[0], run_on])[starts]
        which = run_on - np.repeat(before, per)
        cols = carried(block, list(kinds))
        for c in names:
            value = np.zeros(len(place), np.int64)
            value[place] = of.column(c).to_numpy()
            total = np.concatenate([[0], np.cumsum(counts * value[which])])
            cols[c] = pa.array(total[ends] - total[starts])
        return pa.Table.from_pydict(cols)

    return joined(blocks, values.select("block", "place", *names), run, carry, ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"{c} long" for c in names]))


def joined(blocks: DataFrame, values: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], carry: Sequence[str], ddl: str, *more: str) -> DataFrame:
    """``run(values of the block's terms, block row)`` for each block; ``more`` names further block columns it needs."""
    right = blocks.select("block", "terms", "counts", "per", *more, *carry).groupBy("block")
    return values.groupBy("block").cogroup(right).applyInArrow(run, ddl)
