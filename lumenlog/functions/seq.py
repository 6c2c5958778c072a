"""Ordered sequences that stay distributed, whatever share of the rows one key holds.

A sequence is ordered by ``(ts, tiebreak)`` inside ``keys`` (``keys=()`` is one global
sequence).  ``index_sequence`` range-partitions the log once and gives every row its position
``_pos`` in its sequence and the sequence length ``_n``.  Operators then work on *chunks* of
``chunk_rows`` consecutive positions:

* bounded frames (lag, lead, rolling) read a few copied rows of the neighbouring chunk
  (``with_halo``), so a window never spans a whole sequence;
* running frames combine a chunk-local window with totals of the earlier chunks
  (``running``);
* per-sequence statistics are joined back on ``(keys, chunk)`` (``attach``).

So a window group holds at most ``chunk_rows`` rows plus the halo, also for a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise

POS, SIZE, CHUNK, HALO = "_pos", "_n", "_chunk", "_halo"


@dataclass(frozen=True)
class SeqSpec:
    """Column roles of an event log. ``tiebreak`` must make ``(keys, ts)`` order total."""

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    event: str = "event"
    tiebreak: str = "event_id"
    chunk_rows: int = 1 << 17

    def by(self, *more: str) -> SeqSpec:
        """The same log with extra partition columns, e.g. a segment id."""
        return replace(self, keys=(*self.keys, *more))

    @property
    def order(self) -> list[str]:
        return [self.ts, self.tiebreak]

    @property
    def cells(self) -> list[str]:
        return [*self.keys, CHUNK]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.cells).orderBy(POS)

    def rows(self, start: int, end: int = 0) -> WindowSpec:
        return self.window.rowsBetween(start, end)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys; keeps the left copy of the key columns."""
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    cond = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{c}" for c in on])


def index_sequence(df: DataFrame, spec: SeqSpec) -> DataFrame:
    """Add ``_pos`` (0-based) and ``_n`` per sequence without a window over a whole sequence.

    One range exchange on (keys, ts, tiebreak) splits hot keys over many partitions; the sorted
    rows are stored, and positions follow from per-partition run lengths (one row per key and
    partition).
    """
    order = [*spec.keys, *spec.order]
    drop = [c for c in (POS, SIZE, CHUNK) if c in df.columns]
    ranged = (
        df.drop(*drop)
        .repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    stored = materialise(ranged, "ranged")
    stored = stored.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    keys = list(spec.keys)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_len"))
    runs = runs.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_len").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_len").over(Window.partitionBy(*keys)).alias(SIZE),
    )
    out = null_safe_join(stored, runs, [*keys, "_part"])
    out = out.withColumn(POS, F.col("_row") + F.col("_shift"))
    return materialise(out.drop("_mid", "_part", "_row", "_shift"), "indexed")


def with_chunk(df: DataFrame, spec: SeqSpec) -> DataFrame:
    return df.withColumn(CHUNK, F.expr(f"{POS} div {spec.chunk_rows}"))


def with_halo(df: DataFrame, spec: SeqSpec, before: int = 1, after: int = 0) -> DataFrame:
    """Copy the last ``before`` / first ``after`` rows of a chunk into its neighbours."""
    size = spec.chunk_rows
    if max(before, after) > size:
        raise ValueError(f"frame of {max(before, after)} rows exceeds chunk_rows={size}")
    chunk = F.expr(f"{POS} div {size}")
    offset = F.col(POS) - chunk * size
    targets = [chunk]
    if before:
        targets.append(F.when((offset >= size - before) & ((chunk + 1) * size < F.col(SIZE)), chunk + 1))
    if after:
        targets.append(F.when((offset < after) & (chunk > 0), chunk - 1))
    copies = F.array_compact(F.array(*targets))
    return df.withColumn(CHUNK, F.explode(copies)).withColumn(
        HALO, F.col(CHUNK) != F.expr(f"{POS} div {size}")
    )


def over_rows(
    df: DataFrame,
    spec: SeqSpec,
    *steps: Callable[[SeqSpec], Mapping[str, Column]],
    before: int = 1,
    after: int = 0,
) -> DataFrame:
    """Apply window column ``steps`` in turn over chunks with a halo; drop the halo rows.

    ``before``/``after`` must cover the steps together (a lag inside a frame of w rows needs w).
    """
    out = with_halo(df, spec, before, after)
    for step in steps:
        out = out.withColumns(dict(step(spec)))
    return out.filter(~F.col(HALO)).drop(HALO, CHUNK)


_COMBINE = {
    "sum": lambda local, prior: F.coalesce(local, F.lit(0)) + F.coalesce(prior, F.lit(0)),
    "max": lambda local, prior: F.greatest(local, prior),
    "min": lambda local, prior: F.least(local, prior),
    "last": lambda local, prior: F.coalesce(local, prior),
}
_LOCAL = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def running(
    df: DataFrame,
    spec: SeqSpec,
    cols: Mapping[str, tuple[str, Column]],
    by: Sequence[str] = (),
    backward: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` from the first row of a sequence to the current one.

    ``by`` adds partition columns below the keys (e.g. the event type), ``backward`` runs from the
    last row to the current one, ``exclusive`` leaves the current row out.  Totals per chunk are
    combined over the small chunk table and joined back on (keys, by, chunk).
    """
    sign = -1 if backward else 1
    cells = [*spec.keys, *by, CHUNK]
    base = with_chunk(df, spec).withColumns({f"__{n}": c for n, (_, c) in cols.items()})
    totals = base.groupBy(*cells).agg(
        *[
            (F.max_by(F.col(f"__{n}"), F.when(F.col(f"__{n}").isNotNull(), sign * F.col(POS)))
             if kind == "last" else _LOCAL[kind](F.col(f"__{n}"))).alias(f"__t_{n}")
            for n, (kind, _) in cols.items()
        ]
    )
    earlier = (
        Window.partitionBy(*spec.keys, *by).orderBy(sign * F.col(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    )
    prior = totals.select(
        *cells, *[_LOCAL[kind](F.col(f"__t_{n}")).over(earlier).alias(f"__p_{n}") for n, (kind, _) in cols.items()]
    )
    local = Window.partitionBy(*cells).orderBy(sign * F.col(POS))
    local = local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = null_safe_join(base, prior, cells)
    out = out.withColumns(
        {
            n: _COMBINE[kind](_LOCAL[kind](F.col(f"__{n}")).over(local), F.col(f"__p_{n}"))
            for n, (kind, _) in cols.items()
        }
    )
    return out.drop(CHUNK, *[f"__{n}" for n in cols], *[f"__p_{n}" for n in cols])


def attach(df: DataFrame, stats: DataFrame, spec: SeqSpec, by: Sequence[str] = ()) -> DataFrame:
    """Join one row of statistics per sequence (and ``by`` value) back to the rows.

    Without keys and ``by`` the single row becomes a scalar subquery.  Otherwise the statistics
    are first matched to the distinct (keys, by, chunk) cells and the rows join on the cell, so a
    hot sequence or value is spread over its chunks.
    """
    on = [*spec.keys, *by]
    names = [c for c in stats.columns if c not in on and c != SIZE]
    if not on:
        return attach_row(df, stats.select(*names))
    stats = stats.select(*[c for c in stats.columns if c in on or c in names or c == SIZE])
    if not by and SIZE in stats.columns:
        last = F.expr(f"({SIZE} - 1) div {spec.chunk_rows}")
        cells = stats.select(*on, *names, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias(CHUNK))
    else:
        cells = with_chunk(df, spec).select(*on, CHUNK).distinct()
        cells = null_safe_join(cells, stats.select(*on, *names), on)
    return null_safe_join(with_chunk(df, spec), cells, [*on, CHUNK], "left").drop(CHUNK)


def totals_by(df: DataFrame, spec: SeqSpec, by: Sequence[str], **sums: Column) -> DataFrame:
    """Add sums per (keys, by) to every row: partial sums per chunk, then one join on the cell."""
    on = [*spec.keys, *by]
    cells = with_chunk(df, spec).groupBy(*on, CHUNK).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*on)
    cells = cells.select(*on, CHUNK, *[F.sum(n).over(whole).alias(n) for n in sums])
    return null_safe_join(with_chunk(df, spec), cells, [*on, CHUNK]).drop(CHUNK)


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group as a mergeable aggregate (a large group of copies never meets in one task)."""
    rest = [c for c in df.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*by).agg(first).select(*by, *[F.col("_first")[c].alias(c) for c in rest])


def run_bounds(df: DataFrame, spec: SeqSpec, is_start: Column, prefix: str = "run") -> DataFrame:
    """First position, size and 0-based number of the run of rows each row belongs to."""
    flagged = df.withColumn("__s", is_start)
    out = running(
        flagged,
        spec,
        {
            f"{prefix}_start": ("max", F.when(F.col("__s"), F.col(POS))),
            f"{prefix}_id": ("sum", F.col("__s").cast("long")),
        },
    )
    nxt = {"__next": ("min", F.when(F.col("__s"), F.col(POS)))}
    out = running(out, spec, nxt, backward=True, exclusive=True)
    size = F.coalesce(F.col("__next"), F.col(SIZE)) - F.col(f"{prefix}_start")
    return out.withColumn(f"{prefix}_size", size).withColumn(
        f"{prefix}_id", F.col(f"{prefix}_id") - 1
    ).drop("__s", "__next")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row through a scalar subquery."""
    packed = row.select(F.struct(*row.columns).alias("_row")).scalar()
    out = df.withColumn("__row", packed)
    return out.select(*df.columns, *[F.col("__row")[c].alias(c) for c in row.columns])


def sequence_stats(df: DataFrame, spec: SeqSpec, *aggs: Column) -> DataFrame:
    """One row per sequence with its length, ready for ``attach``."""
    return df.groupBy(*spec.keys).agg(F.max(SIZE).alias(SIZE), *aggs)


def seconds(a: Column, b: Column) -> Column:
    """``a - b`` in seconds for two TIMESTAMP columns."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def gap(spec: SeqSpec) -> dict[str, Column]:
    """Window step: seconds since the previous event (NULL for the first)."""
    return {"gap": seconds(F.col(spec.ts), F.lag(spec.ts).over(spec.window))}


def with_gap(df: DataFrame, spec: SeqSpec) -> DataFrame:
    return over_rows(df, spec, gap, before=1)
