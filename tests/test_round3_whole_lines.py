"""Short lines come whole to one task."""

import numpy as np
import pytest

from strandline.operators import crossings, repair


def some_lines():
    rng = np.random.default_rng(8)
    out = {}
    for k in range(40):
        n = int(rng.integers(2, 60)) if k % 4 < 3 else 1 + k // 4 % 4
        walk = [43, 34] + np.cumsum(rng.integers(-10, 11, (n, 2)), axis=0) / 100
        out[k] = [walk, rng.integers(0, 4, (n, 2)) / 10.0, rng.random((n, 2)), walk][k % 4].tolist()
    return out


def test_crossings_of_whole_lines_are_those_of_cells(line):
    df = line(some_lines())
    want = sorted(map(tuple, crossings.self_intersections(df, crowded=16).collect()))
    assert sorted(map(tuple, crossings.self_intersections(df).collect())) == want and len(want) > 1000
    counts = sorted(map(tuple, crossings.crossing_counts(df, crowded=16).collect()))
    assert sorted(map(tuple, crossings.crossing_counts(df).collect())) == counts


def test_repair_of_whole_lines_is_that_of_tables(line):
    df = line({k: list(dict.fromkeys(map(tuple, p))) for k, p in some_lines().items()})
    cols = ["line_id", "seq", "lat", "lon", "candidate", "intersections", "long_segments"]
    for long_km in (15.0, 450.0):
        want = sorted(map(tuple, repair._repair_by_tables(df, ["line_id"], long_km).select(*cols).collect()))
        got = repair.repair_order(df, long_km=long_km).select(*cols)
        assert sorted(map(tuple, got.collect())) == want and len({r[4] for r in want}) > 3


def test_orders_of_short_lines_are_no_table(line, monkeypatch):
    """Six orders of every line were written, joined and met in cells."""
    monkeypatch.setattr(repair, "candidate_orders", None)
    monkeypatch.setattr(crossings, "shape_cells", None)
    df = line({1: [(0, 0), (0, 2), (0, 1), (0, 3)], 2: [(0, 0), (1, 1), (0, 1), (1, 0)]})
    assert repair.repair_order(df).count() == 8
    assert sorted(map(tuple, crossings.crossing_counts(df).collect())) == [(1, 1), (2, 1)]


def test_long_and_unfinished_lines_keep_their_way(line, monkeypatch):
    pts = some_lines()
    df = line({1: pts[0], 2: pts[1], 3: [(0, 0), (float("nan"), 1), (1, 1), (0, 1), (1, 0.5)]})
    want = {r.line_id: r.intersections for r in crossings.crossing_counts(df, crowded=32).collect()}
    monkeypatch.setattr(crossings.split_lines, "__defaults__", (crossings.LINE, len(pts[1])))
    short, others = crossings.split_lines(df)
    assert {r.line_id for r in others.select("line_id").collect()} >= {3}
    assert {r.line_id: r.intersections for r in crossings.crossing_counts(df).collect()} == want


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_batches_end_with_a_line(spark, line, rows):
    import pyarrow as pa

    from strandline.lines import map_whole

    def work(batch, first):
        n = np.diff(np.append(first, len(batch)))
        yield pa.RecordBatch.from_arrays([batch.column("line_id").take(pa.array(first)), pa.array(n)], names=["line_id", "n"])

    df = line({k: [(0, i) for i in range(k)] for k in range(1, 12)})
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = map_whole(df, ["line_id"], work, "line_id bigint, n bigint", held_rows=rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(tuple, got)) == [(k, k) for k in range(1, 12)]
