"""Queries of other families on one line that holds all events: chunk borders, crowded cells, bitmaps of one line."""

from __future__ import annotations

from strandline.operators import fractal as f
from strandline.operators import geometry as g
from strandline.operators import quality as q
from strandline.plans import adapters as a
from strandline.plans import fractal_queries, geometry_queries, quality_queries  # noqa: F401  (registers the originals)
from strandline.plans.quality_queries import LONG_KM
from strandline.plans.registry import ORACLES, r6, register
from strandline.plans.sql import CTES

WALKS = CTES["vertices"][1]
ONE_WALK = WALKS.replace("user_id AS line_id", "CAST(1 AS BIGINT) AS line_id").replace("PARTITION BY user_id ", "")


def on_one_line(name: str) -> str:
    """The SQL of a query with the walks of all users joined to one."""
    return ORACLES[name].replace(WALKS, ONE_WALK)


@register("g3_long_line", on_one_line("g3_line_summary"))
def g3(spark, sf):
    return g.line_summary(a.one_line(spark, sf)).select("line_id", "points", "segments", r6("length_km", digits=6), r6("mean_segment_km"))


@register("v10_long_line", on_one_line("v10_duplicate_removal"))
def v10(spark, sf):
    return q.drop_duplicate_vertices(a.one_line(spark, sf)).select("line_id", "seq", "lat", "lon")


@register("v11_long_line", on_one_line("v11_order_score"))
def v11(spark, sf):
    """Crossings of one line counted by copies of shapes, in cells that divide where it is dense."""
    return q.order_score(a.one_line(spark, sf), long_km=LONG_KM).select(
        "line_id", "intersections", "long_segments", r6("max_segment_km"), r6("total_km")
    )


@register("f3_long_line", on_one_line("f3_scale_series"))
def f3(spark, sf):
    """Boxes of one line as bitmaps that many tasks fill."""
    return f.scale_series(a.one_line(spark, sf)).select(
        "line_id", "scale_factor", r6("box_size_m", digits=4), r6("relative_scale"), "mean_boxes", "boxes_covered",
        r6("log_inv_scale"), r6("log_boxes"),
    )
