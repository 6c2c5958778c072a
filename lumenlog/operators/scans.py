"""Order-dependent scans as composable maps over bounded chunks.

A left-to-right scan whose state is small (an offset, a symbol, a clamp) is split by chunk.  For
sequences longer than one chunk, each chunk is reduced to the map "entry state -> exit state"; maps
are composed in groups of ``FAN`` chunks and again over those groups.  Every chunk is then replayed
from its entry state.  No task holds more than one chunk of rows or ``FAN`` maps, and short
sequences are replayed many at a time in one sorted pass per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.functions.seq import CHUNK, POS, SIZE, SeqSpec, null_safe_join, with_chunk

FAN = 1024
STOP = -1


def map_cells(
    df: DataFrame,
    cells: Sequence[str],
    fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: T.StructType,
    order: Sequence[str | Column] = (POS,),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Apply ``fn(rows, starts)`` to whole cells in the given order, many cells per call.

    ``drop`` names columns that are only sorted by.

    Rows are hash-partitioned and sorted by Spark; ``starts`` are the first rows of the cells.  Only
    a cell cut by a batch border is carried over, so memory is one batch plus one cell.
    """
    cells = list(cells)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            starts = first_rows(pdf)
            cut = int(starts[-1]) if len(starts) else 0
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield fn(pdf.iloc[:cut].reset_index(drop=True), starts[:-1])
        if rest is not None and len(rest):
            yield fn(rest, first_rows(rest))

    def first_rows(pdf: pd.DataFrame) -> np.ndarray:
        if not len(pdf):
            return np.array([], dtype=np.int64)
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for c in cells:
            col = pdf[c]
            a, b = col.iloc[1:].reset_index(drop=True), col.iloc[:-1].reset_index(drop=True)
            new[1:] |= ((a != b) & ~(a.isna() & b.isna())).to_numpy(dtype=bool)
        return np.flatnonzero(new)

    return df.repartition(*cells).sortWithinPartitions(*cells, *order).drop(*drop).mapInPandas(batches, schema)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def chunk_entries(
    maps: DataFrame,
    spec: SeqSpec,
    compose: Callable[[np.ndarray, np.ndarray], np.ndarray],
    apply: Callable[[np.ndarray, int], int],
    start: int,
    skip: Callable[[int], int] = lambda state: state,
    skip_map: Callable[[np.ndarray], np.ndarray] = lambda m: m,
) -> DataFrame:
    """Entry state of every chunk from one map per chunk: (keys, _chunk, _map) -> (keys, _chunk, _entry).

    ``skip``/``skip_map`` say what happens to the state across chunks that have no rows.
    """
    keys = list(spec.keys)
    maps = maps.withColumn("_block", F.expr(f"{CHUNK} div {FAN}"))
    key_fields = _fields(maps, keys)
    long = lambda n: T.StructField(n, T.LongType())
    block_schema = T.StructType(
        [*key_fields, long("_block"), long("_first"), long("_last"), T.StructField("_map", T.ArrayType(T.LongType()))]
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        chunks, arrays = pdf[CHUNK].to_numpy(), pdf["_map"].to_numpy()
        total = np.asarray(arrays[0], dtype=np.int64)
        for i in range(1, len(chunks)):
            if chunks[i] != chunks[i - 1] + 1:
                total = skip_map(total)
            total = compose(total, np.asarray(arrays[i], dtype=np.int64))
        out = pdf.iloc[:1][[*keys, "_block"]].copy()
        out["_first"], out["_last"], out["_map"] = chunks[0], chunks[-1], [total.tolist()]
        return out

    blocks = maps.groupBy(*keys, "_block").applyInPandas(fold, block_schema)
    top_schema = T.StructType([*key_fields, long("_block"), long("_state")])

    def resolve_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        state, previous, states = start, None, []
        for first, last, m in zip(pdf["_first"], pdf["_last"], pdf["_map"]):
            if previous is not None and first != previous + 1:
                state = skip(state)
            states.append(state)
            state = apply(np.asarray(m, dtype=np.int64), state)
            previous = last
        out = pdf[[*keys, "_block"]].copy()
        out["_state"] = states
        return out

    grouped = blocks.groupBy(*keys) if keys else blocks.withColumn("_all", F.lit(0)).groupBy("_all")
    tops = grouped.applyInPandas(resolve_blocks, top_schema)
    out_schema = T.StructType([*key_fields, long(CHUNK), long("_entry")])

    def resolve_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        state, previous, states = int(pdf["_state"].iloc[0]), None, []
        for chunk, m in zip(pdf[CHUNK], pdf["_map"]):
            if previous is not None and chunk != previous + 1:
                state = skip(state)
            states.append(state)
            state = apply(np.asarray(m, dtype=np.int64), state)
            previous = chunk
        out = pdf[[*keys, CHUNK]].copy()
        out["_entry"] = states
        return out

    joined = null_safe_join(maps, tops, [*keys, "_block"])
    return joined.groupBy(*keys, "_block").applyInPandas(resolve_chunks, out_schema)


def scan(
    rows: DataFrame,
    spec: SeqSpec,
    to_map: Callable[[pd.DataFrame], np.ndarray],
    replay: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    out_schema: T.StructType,
    start: int = 0,
    **composition,
) -> DataFrame:
    """Run a scan over ``rows`` (keys, _pos, _n and inputs): ``to_map`` sees one chunk, ``replay``
    sees sorted chunks with their first rows and entry states."""
    keys = list(spec.keys)
    cells = [*keys, CHUNK]
    rows = with_chunk(rows, spec)
    map_schema = T.StructType(
        [*_fields(rows, keys), T.StructField(CHUNK, T.LongType()), T.StructField("_map", T.ArrayType(T.LongType()))]
    )

    def maps_of(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = pdf.iloc[starts][cells].copy()
        ends = [*starts[1:], len(pdf)]
        out["_map"] = [np.asarray(to_map(pdf.iloc[a:b])).tolist() for a, b in zip(starts, ends)]
        return out

    long_rows = rows.filter(F.col(SIZE) > spec.chunk_rows)
    entries = chunk_entries(map_cells(long_rows, cells, maps_of, map_schema), spec, start=start, **composition)
    started = null_safe_join(rows, entries, cells, "left").fillna(start, ["_entry"])

    def replayed(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return replay(pdf, starts, pdf["_entry"].to_numpy(dtype=np.int64)[starts])

    return map_cells(started, cells, replayed, out_schema)


def _compose_offsets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.where(first < 0, STOP, second[np.clip(first, 0, None)])


def follow_jumps(df: DataFrame, spec: SeqSpec, reach: int) -> DataFrame:
    """Rows visited when starting at the first row and jumping to the first row at or after ``_next``.

    ``_next`` is a position at most ``reach`` ahead, or NULL to stop.  Drops ``_next``.
    """
    size = spec.chunk_rows
    if reach > size:
        raise ValueError(f"reach {reach} exceeds chunk_rows={size}")
    keys = list(spec.keys)
    slim = df.select(*keys, POS, SIZE, F.coalesce(F.col("_next"), F.lit(STOP)).alias("_next"))

    def to_map(pdf: pd.DataFrame) -> np.ndarray:
        pos, nxt = pdf[POS].to_numpy(dtype=np.int64), pdf["_next"].to_numpy(dtype=np.int64)
        begin = int(pdf[CHUNK].iloc[0]) * size
        end, to = begin + size, np.searchsorted(pos, nxt)
        exits = np.zeros(len(pos) + 1, dtype=np.int64)
        for i in range(len(pos) - 1, -1, -1):
            exits[i] = STOP if nxt[i] < 0 else nxt[i] - end if nxt[i] >= end else exits[to[i]]
        return exits[np.searchsorted(pos, begin + np.arange(reach + 1))]

    def replay(pdf: pd.DataFrame, starts: np.ndarray, entry: np.ndarray) -> pd.DataFrame:
        all_pos, all_next, chunks = (pdf[c].to_numpy(dtype=np.int64) for c in (POS, "_next", CHUNK))
        keep = []
        for a, b, e in zip(starts, [*starts[1:], len(pdf)], entry):
            pos, nxt = all_pos[a:b], all_next[a:b]
            i = len(pos) if e < 0 else int(np.searchsorted(pos, chunks[a] * size + e))
            while i < len(pos):
                keep.append(a + i)
                i = len(pos) if nxt[i] < 0 else int(np.searchsorted(pos, nxt[i]))
        return pdf.iloc[keep][[*keys, POS]]

    schema = T.StructType([*_fields(slim, keys), T.StructField(POS, T.LongType())])
    visited = scan(
        slim, spec, to_map, replay, schema,
        compose=_compose_offsets,
        apply=lambda m, s: STOP if s < 0 else int(m[s]),
        skip=lambda s: min(s, 0),
        skip_map=lambda m: np.minimum(m, 0),
    )
    return null_safe_join(df.drop("_next"), visited, [*keys, POS])


def greedy_spacing(df: DataFrame, spec: SeqSpec, min_distance: int) -> DataFrame:
    """Keep the first row, then each row at least ``min_distance`` positions after the last kept one."""
    return follow_jumps(df.withColumn("_next", F.col(POS) + min_distance), spec, min_distance)
