import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.lines import renumber
from strandline.operators import crossings, geometry, quality, repair, simplify
from strandline.operators.fractal import dimension


def test_l1_l14_long_segments(line):
    df = line({1: [(46.48, 30.73), (41.65, 41.63)], 2: [(0, 0), (0, 5), (0, 5.1)]})
    got = {r.line_id: r for r in quality.long_segments(df).collect()}
    assert (got[1].start_index, got[1].end_index) == (1, 2)
    assert (got[2].start_index, got[2].end_index) == (1, 2) and got[2].length_km > 450


def test_l2_bad_latitude(line):
    bad = quality.coordinate_violations(line({1: [(146.48, 30.0), (41.0, 30.0)], 2: [(1, 1), (2, 2)]})).collect()
    assert [(b.line_id, b.seq, b.rule) for b in bad] == [(1, 1, "latitude")]


def test_l3_duplicates(line):
    df = line({1: [(46.48, 30.73), (46.48, 30.73), (41.65, 41.63)]})
    assert quality.duplicate_counts(df).first().removed == 1
    assert [r.seq for r in renumber(quality.drop_duplicate_vertices(df)).orderBy("seq").collect()] == [1, 2]


def test_l4_l5_crossings(line):
    df = line({1: [(0, 0), (1, 1), (1, 0), (0, 1)], 2: [(0, 0), (1, 1), (0, 1), (1, 0)]})
    assert crossings.self_intersections(df.where("line_id = 2")).count() == 1
    fixed = repair.repair_order(df)
    assert crossings.self_intersections(fixed).count() == 0
    assert fixed.groupBy("line_id").count().where("count = 4").count() == 2


def test_l6_l12_landmarks(spark, line):
    marks = quality.default_landmarks(spark)
    df = line({1: [(46.48, 30.73), (46.49, 30.74), (0, 5)], 2: [(0, 0), (0, 1), (0, 2)]})
    rep = quality.repeated_landmarks(df, marks).collect()
    assert [(r.line_id, r.vertices) for r in rep] == [(1, 2)]
    got = {(r.line_id, r.warning_type): r.issues for r in quality.issue_summary(df, marks).collect()}
    assert got == {
        (1, "long_segment"): 1, (1, "duplicate_location"): 1, (2, "long_segment"): 0, (2, "duplicate_location"): 0,
    }


def test_l7_plausibility(spark):
    df = spark.createDataFrame([("black-sea.json", 2104.0), ("other", 2104.0)], "dataset STRING, length_km DOUBLE")
    got = {r.dataset: (r.checked, r.valid) for r in quality.length_plausibility(df, quality.length_reference(spark)).collect()}
    assert got == {"black-sea.json": (True, False), "other": (False, False)}


ZIGZAG = [(0, 0), (0.2, 0.1), (0.4, 0.0), (0.6, 0.1), (0.8, 0.0), (1.0, 0.0)]
RING = [(0, 0), (0, 1), (1, 1), (1, 0), (0.4, 0.2), (0, 0)]


def test_l15_l16_l17_budget(line):
    kept, rec = simplify.simplify_to_budget(line({1: ZIGZAG, 2: [(0, 0), (1, 1)]}), 4)
    r = {x.line_id: x for x in rec.collect()}
    assert r[1].applied and r[1].simplified_count <= 4 and not r[2].applied
    pts = [(x.lat, x.lon) for x in kept.where("line_id = 1").orderBy("seq").collect()]
    assert pts[0] == ZIGZAG[0] and pts[-1] == ZIGZAG[-1] and len(pts) == r[1].simplified_count
    kept, rec = simplify.simplify_to_budget(line({1: RING}), 5)
    pts = [(x.lat, x.lon) for x in kept.orderBy("seq").collect()]
    assert len(pts) <= 5 and pts[0] == pts[-1] and rec.first().closed


def recursive_keep(x, y, tol):
    keep = {0, len(x) - 1}

    def go(i, j):
        if j - i < 2:
            return
        d = []
        for k in range(i + 1, j):
            dx, dy = x[j] - x[i], y[j] - y[i]
            span = dx * dx + dy * dy
            t = 0 if span == 0 else min(max(((x[k] - x[i]) * dx + (y[k] - y[i]) * dy) / span, 0), 1)
            d.append((x[k] - x[i] - t * dx) ** 2 + (y[k] - y[i] - t * dy) ** 2)
        m = int(np.argmax(d))
        if d[m] <= tol * tol:
            return
        keep.add(i + 1 + m)
        go(i, i + 1 + m)
        go(i + 1 + m, j)

    go(0, len(x) - 1)
    return keep


def random_walk(n, seed):
    rng = np.random.default_rng(seed)
    return list(zip(43 + np.cumsum(rng.normal(0, 0.01, n)), 34 + np.cumsum(rng.normal(0, 0.01, n))))


@pytest.mark.parametrize("span", [20_000, 12])
def test_significance_against_recursion(line, span):
    pts = random_walk(120, 3)
    df = line({1: pts, 2: random_walk(9, 4)})
    proj = geometry.project_local(df).where("line_id = 1").orderBy("seq").toPandas()
    scored = simplify.significance(df, local_span=span)
    for tol in (300.0, 1500.0, 6000.0):
        got = {r.seq - 1 for r in simplify.simplify_to_tolerance(scored.where("line_id = 1"), tol).collect()}
        assert got == recursive_keep(proj.x.to_numpy(), proj.y.to_numpy(), tol)


@pytest.mark.parametrize("crowded", [256, 3])
def test_crossings_do_not_depend_on_the_grid(line, crowded):
    pts = random_walk(60, 5)
    pts[30:50] = pts[10:30]  # repeated shapes
    got = crossings.self_intersections(line({1: pts}), crowded=crowded).collect()
    assert len(got) == len(set(got))
    want = crossings.self_intersections(line({1: pts}), crowded=10**9).collect()
    assert set(got) == set(want) and got

    def side(p, q, r):
        return (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])

    brute = set()
    for i in range(59):
        for j in range(i + 2, 59):
            a, b, c, d = pts[i], pts[i + 1], pts[j], pts[j + 1]
            if {a, b} & {c, d}:
                continue
            if side(a, b, c) * side(a, b, d) < -1e-9 and side(c, d, a) * side(c, d, b) < -1e-9:
                brute.add((i + 1, j + 1))
    assert brute <= {(g.first_segment, g.second_segment) for g in got}


def test_dimension_of_a_straight_line(line):
    got = dimension(line({1: [(43 + i * 0.01, 34.0) for i in range(200)]})).first()
    assert got.valid and got.dimension == pytest.approx(1.0, abs=0.06) and got.stable


def test_point_budget(spark):
    df = spark.range(8).select(geometry.point_budget(F.col("id")).alias("t"))
    assert [r.t for r in df.collect()] == [min(3072, 400000 // 4**i + 1) for i in range(8)]


def test_long_lines_walk_in_rounds(line):
    df = line({1: random_walk(45, 11), 2: random_walk(8, 12)})
    cols = ["line_id", "candidate", "seq", "lat", "lon"]
    want = sorted(map(tuple, repair.candidate_orders(df).select(*cols).collect()))
    got = sorted(map(tuple, repair.candidate_orders(df, local_points=10, tile=12).select(*cols).collect()))
    assert got == want


def test_local_span_moves_nothing_on_ties(spark):
    """A walk on a grid, where many offsets are equal."""
    rng = np.random.default_rng(5)
    steps = rng.integers(-1, 2, (160, 2))
    rows = [(1, i + 1, 43.0 + 0.001 * float(a), 34.0 + 0.001 * float(b)) for i, (a, b) in enumerate(np.cumsum(steps, axis=0))]
    lines = spark.createDataFrame(rows, "line_id BIGINT, seq INT, lat DOUBLE, lon DOUBLE")
    whole = {r.seq: r.significance for r in simplify.significance(lines, local_span=20_000).collect()}
    assert {r.seq: r.significance for r in simplify.significance(lines, local_span=25).collect()} == pytest.approx(whole, rel=1e-9)


def test_crossings_of_a_long_segment_among_short_ones(line):
    """Cells stay bounded, and pairs are counted as they are listed."""
    rng = np.random.default_rng(4)
    pts = list(zip(44 + np.cumsum(rng.normal(0, 0.001, 1500)), 34 + np.cumsum(rng.normal(0, 0.001, 1500))))
    pts += [(39.0, 29.0), (49.0, 39.0)] + pts[100:160]
    df = line({1: pts, 2: pts[:3], 3: pts[:1]})
    cells = crossings.shape_cells(crossings._shapes(df, ["line_id"])[1], ["line_id"])
    assert cells.groupBy("line_id", "level", "cx", "cy").count().agg(F.max("count")).first()[0] <= crossings.CROWDED
    listed = crossings.self_intersections(df)
    counted = {r.line_id: r.intersections for r in crossings.crossing_counts(df).collect()}
    assert counted == {r.line_id: r["count"] for r in listed.groupBy("line_id").count().collect()}
    whole = crossings.self_intersections(df, crowded=10**9)
    assert set(listed.collect()) == set(whole.collect())


def test_crossings_of_very_short_segments_that_nearly_touch(line):
    """Short segments touch within a wide tolerance; cells must not part them."""
    rng = np.random.default_rng(8)
    pts = list(zip(44 + np.cumsum(rng.normal(0, 2e-5, 100)), 34 + np.cumsum(rng.normal(0, 2e-5, 100))))
    got = crossings.self_intersections(line({1: pts}), crowded=8)
    assert set(got.collect()) == set(crossings.self_intersections(line({1: pts}), crowded=10**9).collect())
