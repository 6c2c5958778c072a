"""Streams in several micro-batches, rows out of order, late rows and repeated batches, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.seq import SeqSpec
from lumenlog.streaming import events as st
from lumenlog.streaming.ordered import OrderedStream
from lumenlog.streaming.tables import VersionedTable

SCHEMA = "k string, event_id long, s long, event string"


def files(spark, path, batches):
    """A file per batch of (key, id, second, event), in that order."""
    for rows in batches:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000))
        df.coalesce(1).write.mode("append").parquet(path)
    return st.read_event_stream(spark, path, df.schema)


def shuffled(n, seed, jitter=50, parts=5, keys="aab"):
    """Rows about ten seconds apart that arrive up to ``jitter`` seconds late, cut into batches."""
    r = random.Random(seed)
    rows = [(r.choice(keys), i, 10 * i + r.randrange(8), r.choice("xyz")) for i in range(n)]
    arrived = sorted(rows, key=lambda x: x[2] + r.randrange(jitter))
    step = -(-n // parts)
    return [arrived[i : i + step] for i in range(0, n, step)]


def expected(rows, keyed=True, idle=None):
    """(id, previous event, gap, number) in the order of time."""
    last, out = {}, []
    for k, i, s, e in sorted(rows, key=lambda x: (x[2], x[1])):
        before = last.get(k if keyed else 0)
        if before is None or (idle is not None and s - before[0] > idle):
            before = (s, None, -1)
        out.append((i, before[1], float(s - before[0]), before[2] + 1))
        last[k if keyed else 0] = (s, e, before[2] + 1)
    return sorted(out)


def found(df):
    return sorted((r.event_id, r.prev_event, r.time_since_previous, r.event_sequence) for r in df.collect())


@pytest.mark.parametrize("keys", [("k",), ()])
def test_ordered_stream_equals_batch(spark, tmp_path, keys):
    batches = shuffled(90, 1)
    source = files(spark, str(tmp_path / "in"), batches)
    stream = OrderedStream(source, SeqSpec(keys, chunk_rows=4), str(tmp_path / "state"), "1 minute")
    stream.run(str(tmp_path / "cp"))
    rows = [x for b in batches for x in b]
    assert stream.late.all().count() == 0
    assert stream.clock.all().filter("version >= 0").count() == len(batches)
    assert found(stream.rows()) == expected(rows, bool(keys))
    early = found(stream.rows(complete=False))
    assert 0 < len(early) < 90 and set(early) < set(expected(rows, bool(keys)))
    more = [("a", 1000 + i, 900 + 10 * i, "x") for i in range(30)]  # the stream goes on after it was read as complete
    files(spark, str(tmp_path / "in"), [more])
    stream.run(str(tmp_path / "cp"))
    assert found(stream.rows()) == expected(rows + more, bool(keys))


def test_late_rows_null_keys_and_repeated_batches(spark, tmp_path):
    batches = [[("a", 0, 0, "x"), ("a", 1, 100, "y"), (None, 2, 95, "x")], [("a", 3, 20, "late"), ("a", 4, 95, "z"), (None, 5, 300, "y")], [("a", 6, 400, "x"), ("b", 7, 239, "late"), ("b", 8, 240, "x")]]
    source = files(spark, str(tmp_path / "in"), batches)
    stream = OrderedStream(source, SeqSpec(("k",), chunk_rows=4), str(tmp_path / "state"), "60 seconds")
    stream.run(str(tmp_path / "cp"))
    rows = [x for b in batches for x in b if x[3] != "late"]
    assert sorted(r.event_id for r in stream.late.all().collect()) == [3, 7]
    assert found(stream.rows()) == expected(rows)
    again = spark.createDataFrame(batches[-1], SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000))
    stream.process(again, 2)  # as after a failure between its writes
    assert found(stream.rows()) == expected(rows)
    timeless = again.withColumn("ts", F.lit(None).cast("timestamp"))
    stream.process(timeless, 3)
    stream.process(timeless.filter("false"), 4)
    assert found(stream.rows()) == expected(rows) and stream.late.all().count() == 5


def test_idle_sequences_start_anew(spark, tmp_path):
    batches = [[("a", i, s, "xyz"[i % 3]) for i, s in enumerate([0, 10, 500, 510])], [("a", 9, 2000, "x"), ("a", 10, 2050, "y"), ("a", 11, 2151, "y")], [("b", 12, 9000, "x")]]
    source = files(spark, str(tmp_path / "in"), batches)
    stream = OrderedStream(source, SeqSpec(("k",), chunk_rows=2), str(tmp_path / "state"), "1 second", idle="100 seconds", then=lambda df: df.drop("s"))
    stream.run(str(tmp_path / "cp"))
    assert "s" not in stream.rows().columns
    assert found(stream.rows()) == expected([x for b in batches for x in b], idle=100)


def test_versions_of_a_table(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long").schema
    table = VersionedTable(spark, str(tmp_path / "t"), schema, ["k"], full_every=3)
    make = lambda rows: spark.createDataFrame(rows, schema)
    now = {}
    for v in range(8):
        rows = {("a", "b", None, "c")[(v * 3 + j) % 4]: v for j in range(2)}
        assert {r.k: r.n for r in table.before(v).collect()} == now
        table.write(make(list(rows.items())), v)
        table.write(make(list(rows.items())), v)
        now |= rows
    assert {r.k: r.n for r in table.latest().collect()} == now
    assert table.at(6).count() == 4 and table.at(7).count() == 2
    one = VersionedTable(spark, str(tmp_path / "one"), schema, [])
    assert one.before(0).collect() == []
    one.write(make([("x", 1)]), 0)
    one.write(make([]), 1)
    assert [tuple(r) for r in one.before(2).collect()] == [("x", 1)]


def plain_sessions(rows, gap, least):
    out, by = [], {}
    for k, i, s, e in sorted(rows, key=lambda x: x[2]):
        by.setdefault(k, []).append((s, e))
    for k, seen in by.items():
        cut = [0] + [i for i in range(1, len(seen)) if seen[i][0] - seen[i - 1][0] > gap] + [len(seen)]
        for a, b in zip(cut, cut[1:]):
            if b - a >= least:
                kinds = [e for _, e in seen[a:b]]
                out.append((k, b - a, len(set(kinds)), seen[a][0], seen[b - 1][0], min(kinds, key=lambda e: (-kinds.count(e), e))))
    return sorted(out)


def test_sessions_are_all_closed(spark, tmp_path):
    batches = shuffled(120, 4, keys="abcd")
    batches[4].append(("a", 999, 0, "late"))
    source = files(spark, str(tmp_path / "in"), batches)
    sessions = st.session_statistics(st.with_closing(source, str(tmp_path / "marks")), SeqSpec(("k",)), "45 seconds", 2, "60 seconds")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    st.write_stream(sessions, out, cp).awaitTermination()
    closed = spark.read.parquet(out).count()
    st.close_stream(source, str(tmp_path / "marks"))
    got = st.collect_stream(sessions, out, cp, [])
    assert 0 < closed < got.count()
    epoch = got.withColumns({c: F.unix_seconds(c) - 1_000_000_000 for c in ("segment_start", "segment_end")})
    rows = sorted((r.k, r.event_count, r.unique_events, r.segment_start, r.segment_end, r.most_common_event) for r in epoch.collect())
    assert rows == plain_sessions([x for b in batches for x in b if x[3] != "late"], 45, 2)


def test_upserted_windows(spark, tmp_path):
    batches = shuffled(120, 7, keys="ab")
    batches[4].append(("a", 999, 0, "late"))
    source = files(spark, str(tmp_path / "in"), batches)
    counts = st.window_counts(source, SeqSpec(("k",)), "100 seconds", None, "60 seconds")
    got = st.upsert_stream(counts, ["k", "window_start", "event"], str(tmp_path / "out"), str(tmp_path / "cp"))
    want = {}
    for k, _, s, e in [x for b in batches for x in b if x[3] != "late"]:
        want[k, s // 100, e] = want.get((k, s // 100, e), 0) + 1
    rows = got.withColumn("w", ((F.unix_seconds("window_start") - 1_000_000_000) / 100).cast("long")).collect()
    assert {(r.k, r.w, r.event): r["count"] for r in rows} == want and len(rows) == len(want)
