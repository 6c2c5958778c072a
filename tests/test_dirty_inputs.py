"""NULL keys, one-sided keys, unknown types, types without a common successor, incomplete references, large ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.functions.seq import SeqSpec, index_sequence
from lumenlog.operators import clean, correlate, frames, segments, sequence_features, similarity

SPEC = SeqSpec(keys=("user_id",), chunk_rows=256)


@pytest.fixture(scope="module")
def events(spark):
    def make(rows):
        data = [(u, i, float(i), e, float(i)) for i, (u, e) in enumerate(rows)]
        df = spark.createDataFrame(data, "user_id long, event_id long, s double, event string, value double")
        return index_sequence(df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))), SPEC)

    return make


def test_null_keys(events):
    log = events([(u, e) for e in "abab" * 10 for u in (None, 1)])
    seen = {}
    for r in sequence_features.transition_history(log, SPEC).orderBy("event_id").collect():
        seen.setdefault(r.user_id, []).append(r.unique_transitions_seen)
    assert seen[None] == seen[1] and seen[1][:4] == [0, 1, 2, 2]
    parts = segments.adaptive_segments(log, SPEC)
    assert parts.filter("user_id is null").count() == parts.filter("user_id = 1").count() > 0
    same = {r.user_id: r for r in similarity.compare_sequences(log, log, SPEC).collect()}
    assert all(np.isclose(same[u].event_overlap, 1) and np.isclose(same[u].cosine_similarity, 1) for u in (None, 1))


def test_edit_distance_of_any_types_and_keys(events):
    one = events([(1, "x"), (1, "zzz"), (2, "x"), (None, "x"), (None, "y")])
    two = events([(1, "x"), (3, "x"), (3, "y"), (None, "y")])
    got = {r.user_id: r.edit_distance for r in similarity.edit_distance(one, two, SPEC, ["x", "y"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2, None: 1}
    assert got == {r.user_id: r.edit_distance for r in similarity.edit_distance(one, two, SPEC).collect()}


def test_types_without_a_common_successor(events):
    got = correlate.event_correlations(events([(1, e) for e in "ababababab"]), SPEC).collect()
    assert [(r.event1, r.event2, round(r.correlation, 6)) for r in got] == [("a", "b", -1.0), ("b", "a", -1.0)]


def test_incomplete_references(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 4.0)], "frame_id long, y int, x int, value double")
    flat = pixels.filter("x = 0")
    assert frames.auto_calibrate(pixels, flat=flat).count() == 2
    response = frames.pixel_response(flat, pixels)
    assert response.count() == 2
    assert frames.apply_pixel_response(pixels, response.filter("x = 0")).count() == 2


def test_imputation_keeps_whole_numbers(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1, None, 1.5), (2, None, 4, None), (3, 3, 7, 2.5)], "id long, a int, b int, c double")
    out = clean.impute_median(df, ["id", "a", "b", "c"])
    assert [str(t) for _, t in out.dtypes] == ["bigint", "int", "double", "double"]
    assert sorted(map(tuple, out.collect())) == [(2, 2, 4.0, 2.0), (3, 3, 7.0, 2.5), (big, 1, 5.5, 1.5)]
