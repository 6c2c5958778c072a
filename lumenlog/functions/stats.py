"""Exact statistics as mergeable aggregates: percentiles, modes, guarded correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.seq import SIZE, SeqSpec, attach, null_safe_join

SKETCH_ACCURACY = 100_000
BRACKET_ROWS = 1_000_000  # rows that a bracket may hold before it is narrowed again


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL when either side is constant (ANSI-safe)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percentile_values(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> dict[str, float | None]:
    """Exact linear-interpolated percentiles of whole columns, ``{name: (column, p)}``, as numbers.

    Two scans for any number of columns, run when this is called.  The first sketches every column, which brackets each
    wanted rank; the second counts what lies below each bracket and the distinct values inside.  While a bracket may
    hold more than ``BRACKET_ROWS`` rows it is narrowed by a further sketch of its inside, so the last sort stays
    small however long the column is.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    value = {c: F.col(c).cast("double") for c in columns}
    probes = {c: sorted({q for k, p in wanted.values() if k == c for q in _around(p)}) for c in columns}
    sketches = [x for c in columns for x in (F.count(c), F.percentile_approx(value[c], _lits(probes[c]), SKETCH_ACCURACY))]
    row = df.agg(*sketches).first()
    found: dict[str, float | None] = {}
    open_ranks: dict[str, list] = {}
    for name, (c, p) in wanted.items():
        n, quantiles = row[2 * columns.index(c)], row[2 * columns.index(c) + 1]
        if not n:
            found[name] = None
            continue
        lo, hi = (quantiles[probes[c].index(q)] for q in _around(p))
        width = 4.0 / SKETCH_ACCURACY
        open_ranks[name] = [c, (n - 1) * p, lo if p > width else None, hi if p < 1 - width else None, 2 * width * n]
    while open_ranks and max(x[4] for x in open_ranks.values()) > BRACKET_ROWS:
        open_ranks = _narrowed(df, value, open_ranks)
    if not open_ranks:
        return {name: found[name] for name in wanted}
    counts = _zones(df.select(*[value[c].alias(f"_v{i}") for i, c in enumerate(columns)]), [], {
        name: (F.col(f"_v{columns.index(c)}"), None if lo is None else F.lit(lo), None if hi is None else F.lit(hi))
        for name, (c, _, lo, hi, _) in open_ranks.items()
    })
    ranks = F.element_at(_lits([x[1] for x in open_ranks.values()]), F.col("_i") + 1)
    for r in _at_ranks(counts.withColumn("_rank", ranks), []).collect():
        found[list(open_ranks)[r["_i"]]] = r["_p"]
    return {name: found[name] for name in wanted}


def exact_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ps: Mapping[str, float],
    spec: SeqSpec | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles per group, exact for groups of any size.

    A mergeable quantile sketch brackets each wanted rank; a second pass counts the values below the
    bracket and the distinct values inside, so no task ever buffers a large group.  With ``spec`` (``by`` being its
    keys) the bracket is joined per chunk; otherwise ``by`` has few groups and the planner
    broadcasts the bracket table by its size.  Without groups the work runs at once (``percentile_values``)
    and the result is one row of constants.
    """
    by = list(by)
    if not by:
        values = percentile_values(df, {n: (value, p) for n, p in ps.items()})
        return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in values.items()])
    width = 4.0 / SKETCH_ACCURACY
    rows = df.filter(F.col(value).isNotNull())
    probes = [q for p in ps.values() for q in _around(p)]
    size_col = [F.max(SIZE).alias(SIZE)] if spec is not None else []
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("_cnt"),
        F.percentile_approx(F.col(value).cast("double"), _lits(probes), SKETCH_ACCURACY).alias("_q"),
        *size_col,
    )
    joined = attach(rows, sketch, spec) if spec is not None else null_safe_join(rows.select(*by, value), sketch, by)
    joined = joined.select(*by, F.col(value).cast("double").alias("_v"), "_cnt", "_q")
    zones = {
        n: (F.col("_v"), F.col("_q")[2 * i] if p > width else None, F.col("_q")[2 * i + 1] if p < 1 - width else None)
        for i, (n, p) in enumerate(ps.items())
    }
    counts = _zones(joined, [*by, "_cnt"], zones)
    counts = counts.withColumn("_rank", (F.col("_cnt") - 1) * F.element_at(_lits(list(ps.values())), F.col("_i") + 1))
    cell = _at_ranks(counts, by)
    return cell.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(n) for i, n in enumerate(ps)])


def _lits(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _around(p: float) -> tuple[float, float]:
    width = 4.0 / SKETCH_ACCURACY
    return max(p - width, 0.0), min(p + width, 1.0)


def _zones(df: DataFrame, by: Sequence[str], brackets: Mapping[str, tuple]) -> DataFrame:
    """Row counts per (by, bracket number ``_i``): all below as one (the largest value), each value inside, all above.

    ``brackets`` gives (value, low or None, high or None); None is open. Rows outside are counted by one aggregate; only
    the few rows inside a bracket become rows of their own.
    """
    outer, inside = [], []
    zone = "struct<_i:int,_zone:int,_k:double,_c:bigint,_x:double>"
    for i, (v, lo, hi) in enumerate(brackets.values()):
        below = v < lo if lo is not None else F.lit(False)
        above = v > hi if hi is not None else F.lit(False)
        for number, there, edge in ((-1, below, F.max), (1, above, F.min)):
            cell = F.struct(F.lit(i), F.lit(number), F.lit(None).cast("double"), F.count_if(there), edge(F.when(there, v)).cast("double"))
            outer.append(cell.cast(zone))
        within = v.isNotNull() & ~F.coalesce(below | above, F.lit(False))
        inside.append(F.when(within, F.struct(F.lit(i).alias("_i"), v.cast("double").alias("_k"))))
    counted = df.groupBy(*by).agg(F.array(*outer).alias("_b")).select(*by, F.explode("_b").alias("_b")).select(*by, "_b.*").filter("_c > 0")
    rows = df.select(*by, F.explode(F.filter(F.array(*inside), lambda c: c.isNotNull())).alias("_b")).select(*by, "_b._i", "_b._k")
    values = rows.groupBy(*by, "_i", "_k").agg(F.count("*").alias("_c"))
    return counted.unionByName(values.select(*by, "_i", F.lit(0).alias("_zone"), "_k", "_c", F.col("_k").alias("_x")))


def _at_ranks(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _i, _p): the interpolated value at ``_rank`` among the counted zones.

    The value next to a bracket is known too; a rank further out would mean a wrong sketch and is an error.
    """
    w = Window.partitionBy(*by, "_i").orderBy("_zone", "_k").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.sum("_c").over(w))
    start = F.when(F.col("_zone") < 0, F.col("_end") - 1).otherwise(F.col("_end") - F.col("_c"))
    end = F.when(F.col("_zone") > 0, start + 1).otherwise(F.col("_end"))
    ranked = ranked.withColumns({"_start": start, "_end": end})
    at = lambda r: F.max(F.when((F.col("_start") <= r) & (r < F.col("_end")), F.col("_x")))
    low = F.floor(F.col("_rank"))
    cell = ranked.groupBy(*by, "_i").agg(at(low).alias("_a"), at(F.ceil(F.col("_rank"))).alias("_z"), F.max(F.col("_rank") - low).alias("_f"))
    interp = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")
    lost = F.raise_error(F.lit("percentile rank outside its bracket")).cast("double")
    return cell.select(*by, "_i", F.coalesce(interp, lost).alias("_p"))


def _narrowed(df: DataFrame, value: Mapping[str, Column], ranks: dict[str, list]) -> dict[str, list]:
    """Tighter brackets: rows below and inside are counted, then the inside is sketched around the wanted rank."""

    def inside(x) -> Column:
        v = value[x[0]]
        return (v >= x[2] if x[2] is not None else F.lit(True)) & (v <= x[3] if x[3] is not None else F.lit(True)) & v.isNotNull()

    none = F.lit(False)
    row = df.agg(*[c for x in ranks.values() for c in (F.count_if(value[x[0]] < x[2] if x[2] is not None else none), F.count_if(inside(x)))]).first()
    shares = [((x[1] - row[2 * i]) / max(row[2 * i + 1] - 1, 1), row[2 * i + 1]) for i, x in enumerate(ranks.values())]
    row = df.agg(*[F.percentile_approx(F.when(inside(x), value[x[0]]), _lits(_around(min(max(p, 0.0), 1.0))), SKETCH_ACCURACY) for x, (p, _) in zip(ranks.values(), shares)]).first()
    width, out = 4.0 / SKETCH_ACCURACY, {}
    for i, ((name, x), (p, n)) in enumerate(zip(ranks.items(), shares)):
        lo, hi = row[i][0] if p > width else x[2], row[i][1] if p < 1 - width else x[3]
        # A bracket that does not shrink lies between values with many repeats: few distinct ones, which are counted.
        done = lo == hi or (lo, hi) == (x[2], x[3])
        out[name] = [x[0], x[1], lo, hi, 0 if done else 2 * width * n]
    return out


def attach_percentiles(df: DataFrame, spec: SeqSpec, value: str, ps: Mapping[str, float]) -> DataFrame:
    """Per-sequence percentiles of ``value`` joined to the rows of an indexed log."""
    table = exact_percentiles(df, spec.keys, value, ps, spec)
    if spec.keys:
        sizes = df.groupBy(*spec.keys).agg(F.max(SIZE).alias(SIZE))
        table = null_safe_join(sizes, table, spec.keys, "left")
    return attach(df, table, spec)


def mode_by(df: DataFrame, by: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most common non-null value, smallest on ties; counts are combined before the pick."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_c"), F.col(value).alias("v")))["v"].alias(name))


def moments(v: Column, prefix: str = "") -> list[Column]:
    return [
        F.avg(v).alias(f"{prefix}mean"),
        F.stddev_pop(v).alias(f"{prefix}std"),
        F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"),
    ]
