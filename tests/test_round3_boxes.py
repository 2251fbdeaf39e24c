"""boxes of short lines take one shuffle, and windows of all lines are folded in many tasks."""

import numpy as np

from strandline.operators import fractal


def some_lines():
    rng = np.random.default_rng(17)
    walk = {k: (43 + rng.integers(-10, 11, (1 + 9 * k, 2)).cumsum(axis=0) / 100).tolist() for k in range(8)}
    return walk | {20: [(43, 34)] * 5, 21: [(43, 34), (43, 34.5)], 22: [(43, 34), (43 + 1e-6, 34)]}


def test_boxes_of_whole_lines_are_those_of_parts(line, monkeypatch):
    df = line(some_lines())
    want = fractal._boxes_of_parts(df, ["line_id"], fractal.OFFSETS, fractal.STRETCH)
    want = sorted(map(tuple, want.select("line_id", "scale_factor", "size_m", "boxes").collect()))
    monkeypatch.setattr(fractal, "_boxes_of_parts", None)
    got = fractal.box_coverage(df).select("line_id", "scale_factor", "size_m", "boxes")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 8 * len(fractal.SCALE_FACTORS)


def test_blocks_of_bitmaps(line, monkeypatch):
    """Few boxes held at once give what many give."""
    df = line(some_lines())
    want = sorted(map(tuple, fractal.box_coverage(df).collect()))
    monkeypatch.setattr(fractal, "HELD", 1000)
    assert sorted(map(tuple, fractal.box_coverage(df).collect())) == want


def series(rng, n):
    x = np.log(np.array(fractal.SCALE_FACTORS[:n], dtype=float))
    return x, 1.2 * x + rng.normal(0, rng.choice([0.0, 0.01, 0.3]), n)


def naive(x, y):
    """One line's windows, one by one."""
    best = None
    for a in range(len(x)):
        for b in range(a + 3, len(x)):
            p, q = x[a : b + 1], y[a : b + 1]
            slope, intercept = np.polyfit(p, q, 1)
            tot = ((q - q.mean()) ** 2).sum()
            r2 = 1 - ((q - slope * p - intercept) ** 2).sum() / tot if tot >= 1e-12 else 1.0
            spread = np.ptp(np.diff(q) / np.diff(p))
            new = (r2 >= 0.98 and spread <= 0.18, b - a + 1, r2, slope, spread, a, b)
            if best is None:
                best = new
                continue
            dr = abs(new[2] - best[2])
            if new[0] != best[0]:
                take = new[0]
            elif new[1] != best[1]:
                take = new[1] > best[1]
            elif dr > 1e-9:
                take = new[2] > best[2]
            elif abs(new[3] - best[3]) > 1e-6:
                take = new[3] > best[3]
            else:
                take = new[4] < best[4]
            best = new if take else best
    return best


def test_windows_of_many_lines_at_once(spark):
    rng = np.random.default_rng(22)
    lines = {k: series(rng, int(rng.integers(2, 14))) for k in range(60)}
    rows = [(k, x.tolist(), y.tolist(), len(x)) for k, (x, y) in lines.items()]
    df = spark.createDataFrame(rows, "line_id BIGINT, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, samples INT").coalesce(1)
    best = fractal._best_of(df, ["line_id"])
    assert best.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {r.line_id: r for r in best.collect()}
    assert set(got) == {k for k, (x, _) in lines.items() if len(x) >= 4}
    for k, r in got.items():
        stable, n, r2, slope, spread, a, b = naive(*lines[k])
        assert (r.first_sample, r.last_sample, r.stable, r.samples) == (a, b, stable, len(lines[k][0]))
        np.testing.assert_allclose([r.r_squared, r.slope, r.spread], [r2, slope, spread], rtol=1e-6, atol=1e-9)
