"""Small cases of the findings of round 3."""

import duckdb
import numpy as np
import pytest

from strandline.operators import fractal, geometry, simplify
from strandline.plans.registry import r6


def test_mean_is_summed_along_the_line(spark):
    """1e16 + 1 - 1e16 is 0 along the line; sums of shuffled parts give 1 or other figures."""
    rows = [(1, 1, 1e16, 34.0), (1, 2, 1.0, 34.0), (1, 3, -1e16, 34.0), (1, 4, 3.0, 34.0)]
    df = spark.createDataFrame(rows[::-1], "line_id BIGINT, seq INT, lat DOUBLE, lon DOUBLE").repartition(4)
    got = geometry.line_reference(df).first()
    assert (got.ref_lat, got.points, got.lo_seq, got.hi_seq, got.closed) == (0.75, 4, 1, 4, False)


def test_rounding_as_sql(spark):
    """Halves of the scaled value go away from zero."""
    values = [k / 2000 + e for k in range(-9001, 9001, 2) for e in (0.0, 39474.0)]
    sql = duckdb.connect().execute("SELECT round(v, 3) + 0.0e0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    df = spark.createDataFrame(list(enumerate(values)), "n INT, v DOUBLE").repartition(2)
    assert [r.v for r in df.select("n", r6("v", digits=3)).orderBy("n").collect()] == [x for (x,) in sql]


def test_open_line_that_meets_its_start_is_no_ring(line):
    """without rings all lines keep their last vertex and are open."""
    df = line({1: [(0, 0), (0, 1), (1, 1), (1, 0), (0.4, 0.2), (0, 0)]})
    whole = {r.line_id: r for r in simplify.simplify_to_budget(df, 5)[1].collect()}
    kept, record = simplify.simplify_to_budget(df, 5, rings=False)
    got = record.first()
    assert whole[1].closed and not got.closed
    assert got.applied and got.simplified_count == kept.count() <= 5


def test_intervals_that_cross_batches(spark, line):
    """intervals come in batches of a few rows and are finished whole."""
    rng = np.random.default_rng(5)
    df = line({k: list(zip(rng.random(40), rng.random(40))) for k in range(9)})
    want = {(r.line_id, r.seq): r.significance for r in simplify.significance(df).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.line_id, r.seq): r.significance for r in simplify.significance(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == pytest.approx(want) and len(got) == 360


def test_boxes_of_whole_lines_and_of_stretches(spark, line):
    """Short lines are counted in one task and give a row per scale; stretches give the same boxes."""
    rng = np.random.default_rng(6)
    df = line({k: list(zip(43 + rng.random(30 + k).cumsum() / 50, 34 + rng.random(30 + k))) for k in range(8)})
    got = {(r.line_id, r.scale_factor): r.boxes for r in fractal.box_coverage(df).collect()}
    assert len(got) == 8 * len(fractal.SCALE_FACTORS)
    for stretch in (7, 33):
        assert {(r.line_id, r.scale_factor): r.boxes for r in fractal.box_coverage(df, stretch=stretch).collect()} == got
