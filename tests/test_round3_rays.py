"""rays of short lines meet the segments of their line in one task."""

import numpy as np
import pytest

from strandline.operators import exposure


def shores(line):
    rng = np.random.default_rng(13)
    out = {}
    for k in range(12):
        pts = ([43, 34] + np.cumsum(rng.integers(-10, 11, (int(rng.integers(1, 40)), 2)), axis=0) / 100).tolist()
        out[k] = pts + pts[:1] if k % 2 else pts
    return line(out)


@pytest.mark.parametrize("probe, fetch", [(25.0, 150_000.0), (500.0, 3_000.0), (25.0, 1.0)])
def test_fetches_of_whole_lines_are_those_of_cells(line, probe, fetch):
    frames = exposure.vertex_frames(shores(line)).cache()
    p = exposure.WaveParams(strength_m=10.0, probe_m=probe, max_fetch_m=fetch, wind_dir_deg=30.0)
    want = {(r.line_id, r.seq, r.ray): (r.dx, r.dy, r.fetch) for r in exposure._fetch_by_cells(frames, p, ["line_id"]).collect()}
    got = {(r.line_id, r.seq, r.ray): (r.dx, r.dy, r.fetch) for r in exposure.ray_fetch(frames, p).collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    some = {(r.line_id, r.seq): r.fetches for r in exposure.with_fetches(frames, p, rows=15).collect()}
    assert all(some[k[:2]][k[2]] == pytest.approx(v[2], rel=1e-12) for k, v in want.items())


def test_sides_from_arrays_are_those_from_rows(line):
    frames = exposure.vertex_frames(shores(line)).cache()
    p = exposure.WaveParams(strength_m=10.0)
    want = exposure.side_scores(frames, exposure.ray_fetch(frames, p), p)
    got = exposure.side_scores(exposure.with_fetches(frames, p), None, p).select(*want.columns)
    rows = [{(r.line_id, r.seq): r for r in df.collect()} for df in (want, got)]
    assert rows[0].keys() == rows[1].keys() and rows[0]
    for k, r in rows[0].items():
        for c in ("left_score", "right_score", "left_mean_fetch", "right_mean_fetch"):
            assert rows[1][k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-12)


def test_rays_of_short_lines_need_no_cells(line, monkeypatch):
    monkeypatch.setattr(exposure, "_fetch_by_cells", None)
    assert exposure.wave_pass(shores(line), exposure.WaveParams(strength_m=10.0))[1].count() > 0
