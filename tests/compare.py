"""Run registered queries next to their DuckDB oracle and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        return repr(float(value))
    return str(value)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(canon(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def compare(name, spark, sf_dir, con, queries, oracles):
    """Return (ok, message, spark seconds, duckdb seconds)."""
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = df.toPandas()
    t1 = time.time()
    if name not in oracles:
        return len(got) > 0 and not got.isna().all(axis=None), f"rows={len(got)}", t1 - t0, 0.0
    want = con.sql(oracles[name]).df()
    t2 = time.time()
    gc, gr = rows(got)
    wc, wr = rows(want)
    if gc != wc:
        return False, f"columns {gc} != {wc}", t1 - t0, t2 - t1
    for c in gc:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and not got[c].isna().any() and not want[c].isna().any() and {a, b} != {"O"}:
            return False, f"dtype of {c}: {got[c].dtype} vs {want[c].dtype}", t1 - t0, t2 - t1
    if len(gr) != len(wr):
        return False, f"rows {len(gr)} != {len(wr)}", t1 - t0, t2 - t1
    diff = [(a, b) for a, b in zip(gr, wr) if a != b]
    if diff:
        return False, f"{len(diff)} of {len(gr)} rows differ\n   {gc}\n   spark {diff[0][0]}\n   duck  {diff[0][1]}", t1 - t0, t2 - t1
    return True, f"rows={len(gr)}", t1 - t0, t2 - t1


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    prefixes = sys.argv[1:]
    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not prefixes or any(n.startswith(p) for p in prefixes)]
    bad = 0
    for n in names:
        try:
            ok, msg, ts, td = compare(n, spark, sf, con, queries, oracles)
        except Exception as exc:
            ok, msg, ts, td = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {'' if n in oracles else '(rows only) '}{ts:.2f}s/{td:.2f}s {msg if not ok or n not in oracles else msg}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
