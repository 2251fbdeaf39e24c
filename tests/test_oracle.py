"""Registered queries against DuckDB at the smallest scale.

A sample by default; all of them with STRANDLINE_ALL=1.
"""

import os
import re

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["g3_line_summary", "g9_simplify_budget", "v6_clip_runs", "v14_self_intersections", "f7_best_window",
          "i2_bilinear_depth", "i5_rock_idw", "w9_moved_shore", "e7_sediment_budget", "t6_series_summary",
          "r8_storm_impact", "s2_geojson", "s7_source_inspection", "s6_step_metrics_csv", "s6_step_metrics_rejects",
          "s4_rejected_profiles", "s18_resampled_raster", "load_rejects", "i4_nearest_points", "f8_dimension",
          "w3_ray_fetch", "r13_step_maps", "r19_storm_histogram"]
NAMES = sorted(set(oracle_sql()) if os.environ.get("STRANDLINE_ALL") else SAMPLE)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_equivalent():
    unlike = re.compile(r"op\d+_|pipeline$")  # tested against brute force in tests/llm
    assert set(oracle_sql()) <= set(queries())
    assert all(unlike.match(name) for name in set(queries()) - set(oracle_sql()))


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(oracle_sql()[name]).df()) is None
