import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    from lumenlog.functions.session import configure

    s = configure(session())
    yield s
    s.stop()


@pytest.fixture(scope="session")
def log(spark):
    """Build an indexed log from (key, seconds, event[, value]) tuples with tiny chunks."""
    from pyspark.sql import functions as F

    from lumenlog.functions.seq import SeqSpec, index_sequence

    def make(rows, keys=("k",), chunk_rows=4, parts=1):
        data = [(r[0], i, float(r[1]), r[2], float(r[3]) if len(r) > 3 else 0.0) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, "k string, event_id long, s double, event string, value double")
        df = df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).repartition(parts)
        spec = SeqSpec(keys=keys, chunk_rows=chunk_rows)
        return index_sequence(df, spec), spec

    return make
