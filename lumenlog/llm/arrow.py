"""Arrow batches in and out of tasks in small slices, so that a task holds a few documents at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from weakref import WeakValueDictionary

import pyarrow as pa


class Kept(dict):
    """Results of a function, kept until there are ``most`` of them or a task has read its input."""

    alive: WeakValueDictionary = WeakValueDictionary()

    def __init__(self, fn, most: int):
        self.fn, self.most = fn, most
        Kept.alive[id(self)] = self

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.fn(key)
        return found


def give_back() -> None:
    """Empty all caches and hand freed memory to the system: a Python worker lives on beside those of later stages."""
    for kept in list(Kept.alive.values()):
        kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to at most ``rows`` rows and, where ``text`` is named, about ``size`` bytes of it (one row at least)."""
    for batch in batches:
        at = 0
        sizes = None
        if text is not None and batch.num_rows:
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if sizes is not None:
                total = sizes[at : at + n].cumsum()
                n = max(1, int((total <= size).sum()))
            yield batch.slice(at, n)
            at += n
    give_back()


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns put in the place of those of the same name, or behind."""
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names + list(new))


def schema_with(df, **new: str) -> str:
    """DDL of ``df`` with columns put in the place of those of the same name, or behind."""
    old = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new]
    return ", ".join(old + [f"{k} {v}" for k, v in new.items()])


def mapped(df, fn: Callable[[pa.RecordBatch], pa.RecordBatch], by: str | None = None, rows: int = 512, /, **new: str):
    """``df`` with the columns that ``fn`` adds to each slice (``by`` and ``rows`` as for ``slices``)."""

    def run(batches):
        for part in slices(batches, by, rows):
            yield fn(part)

    return df.mapInArrow(run, schema_with(df, **new))
