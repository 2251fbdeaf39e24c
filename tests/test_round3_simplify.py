"""short lines are simplified whole, once per query."""

import numpy as np

from strandline.operators import quality, simplify
from strandline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def some_lines():
    rng = np.random.default_rng(12)
    walk = {k: (43 + rng.integers(-10, 11, (1 + 7 * k, 2)).cumsum(axis=0) / 100).tolist() for k in range(9)}
    return walk | {20: [(43, 34)] * 5, 21: rng.integers(0, 2, (60, 2)).tolist()}


def test_whole_lines_score_as_parts(line, monkeypatch):
    df = line(some_lines())
    want = sorted(map(tuple, simplify._score_parts(df, ["line_id"], 20_000).collect()))
    monkeypatch.setattr(simplify, "_score_parts", None)
    assert sorted(map(tuple, simplify._scored(df, ["line_id"]).collect())) == want


def test_intervals_are_split_together():
    """Many intervals at once give what each gives alone."""
    rng = np.random.default_rng(14)
    size = rng.integers(1, 40, 60)
    first = np.cumsum(size) - size
    x, y = rng.integers(0, 30, (2, size.sum())) / 3.0
    chain = np.where(rng.random(60) < 0.5, np.inf, 4.0)
    alone = [simplify.interval_significance(x[a : a + n], y[a : a + n], np.array([0]), np.array([c])) for a, n, c in zip(first, size, chain)]
    assert simplify.interval_significance(x, y, first, chain).tolist() == np.concatenate(alone).tolist()


def test_kept_vertices_are_found_once(spark):
    """Their numbering reads them twice, and each read split all lines again."""
    for name in ("g12_simplify_compare", "s14_coastline_document"):
        assert "MapIn" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_landmarks_are_met_once(spark, monkeypatch):
    """The document's list and its issues each met all vertices with the landmarks."""
    calls, met = [], quality.nearest_landmark
    monkeypatch.setattr(quality, "nearest_landmark", lambda *a, **k: calls.append(1) or met(*a, **k))
    QUERIES["s14_coastline_document"](spark, SF)
    assert len(calls) == 1
