"""Self-intersections of lines (V14) as a join on cells that divide where they are crowded.

Equal segments share their end points and therefore never count as crossing, so
the join runs on distinct segment shapes, and only crossing shapes are expanded
to the segments that have them, or counted by their copies.  A line's box is one cell;
a cell with too many segments is replaced by its parts, again and again, and each
segment goes to the parts that it passes: a few of at most ``PARTS`` squared, however
long it is.  Only regions that stay crowded are divided on.  Lines of at most ``WHOLE_ROWS``
vertices come whole to one task, which tests the pairs of segments whose boxes meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.functions.cells import sub_cells
from strandline.lines import LINE, WHOLE_ROWS, attach, map_whole, with_neighbours
from strandline.operators import whole
from strandline.session import stored

# Fixed values of the crossing test.
ORIENTATION_EPS = 1e-9
TOUCH_EPS = 1e-9

#: Segments of a cell from which it is divided, its parts along each axis, and the side of a cell (degrees) that stays whole.
CROWDED = 32
PARTS = 8
SMALLEST = 1e-7
SHAPE = ["ax", "ay", "bx", "by"]


def _pt(prefix: str, name: str) -> dict[str, Column]:
    return {"lon": F.col(f"{prefix}{name}x"), "lat": F.col(f"{prefix}{name}y")}


def _same(p, q) -> Column:
    return (F.abs(p["lat"] - q["lat"]) <= TOUCH_EPS) & (F.abs(p["lon"] - q["lon"]) <= TOUCH_EPS)


def _within(a, b, c) -> Column:
    return (
        (b["lon"] <= F.greatest(a["lon"], c["lon"]) + TOUCH_EPS)
        & (b["lon"] >= F.least(a["lon"], c["lon"]) - TOUCH_EPS)
        & (b["lat"] <= F.greatest(a["lat"], c["lat"]) + TOUCH_EPS)
        & (b["lat"] >= F.least(a["lat"], c["lat"]) - TOUCH_EPS)
    )


def crosses(left: str = "l_", right: str = "r_", eps: float = ORIENTATION_EPS) -> Column:
    """Crossing or touching test of two segments with columns ``ax ay bx by``."""
    a, b = _pt(left, "a"), _pt(left, "b")
    c, d = _pt(right, "a"), _pt(right, "b")
    o1, o2 = geo.orientation(a, b, c), geo.orientation(a, b, d)
    o3, o4 = geo.orientation(c, d, a), geo.orientation(c, d, b)
    shared = _same(a, c) | _same(a, d) | _same(b, c) | _same(b, d)
    proper = (o1 * o2 < -eps) & (o3 * o4 < -eps)
    touch = (
        ((F.abs(o1) <= eps) & _within(a, c, b))
        | ((F.abs(o2) <= eps) & _within(a, d, b))
        | ((F.abs(o3) <= eps) & _within(c, a, d))
        | ((F.abs(o4) <= eps) & _within(c, b, d))
    )
    return ~shared & (proper | touch)


def _apart(left: str = "l_", right: str = "r_") -> Column:
    def lo(p, axis):
        return F.least(F.col(f"{p}a{axis}"), F.col(f"{p}b{axis}"))

    def hi(p, axis):
        return F.greatest(F.col(f"{p}a{axis}"), F.col(f"{p}b{axis}"))

    slack = 1e-8
    tests = [lo(left, ax) > hi(right, ax) + slack for ax in "xy"] + [lo(right, ax) > hi(left, ax) + slack for ax in "xy"]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _shapes(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments, and their distinct shapes with a number and the number of copies."""
    nb = with_neighbours(lines.select(*keys, "seq", "lat", "lon"), ["lat", "lon"], keys)
    segs = nb.where(F.col("next").isNotNull()).select(
        *keys,
        F.col("seq").alias("i"),
        F.col("lon").alias("ax"),
        F.col("lat").alias("ay"),
        F.col("next.lon").alias("bx"),
        F.col("next.lat").alias("by"),
    )
    segs = stored(segs, "segments")
    return segs, segs.groupBy(*keys, *SHAPE).agg(F.min("i").alias("shape"), F.count("*").alias("copies"))


def shape_cells(shapes: DataFrame, keys: Sequence[str], crowded: int = CROWDED) -> DataFrame:
    """Every shape with the cells that it passes, none with more than ``crowded`` shapes (but for the smallest)."""
    keys = list(keys)
    low_x, low_y = F.min(F.least("ax", "bx")), F.min(F.least("ay", "by"))
    side = F.greatest(F.max(F.greatest("ax", "bx")) - low_x, F.max(F.greatest("ay", "by")) - low_y, F.lit(SMALLEST))
    boxes = shapes.groupBy(*keys).agg(
        F.min("shape").alias("lo_shape"), F.max("shape").alias("hi_shape"), low_x.alias("x0"), low_y.alias("y0"), side.alias("side")
    )
    cell = [*keys, "level", "cx", "cy"]
    whole = F.lit(0).cast("bigint")
    placed = attach(shapes, boxes, keys, order="shape", lo="lo_shape", hi="hi_shape").drop("lo_shape", "hi_shape")
    placed = stored(placed.withColumns({"level": F.lit(0), "cx": whole, "cy": whole}), "cells")
    own = placed.columns
    size = F.col("side") / F.pow(F.lit(float(PARTS)), F.col("level").cast("double"))
    # how far from a segment a point may lie and still touch it: its orientation is length times distance
    reach = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")), F.lit(1e-12))
    tolerance = F.least(ORIENTATION_EPS / reach, reach) + 1e-8
    pad = tolerance + size / PARTS * 1e-3
    parts = sub_cells(
        *[F.col(c) for c in SHAPE], F.col("x0") + F.col("cx") * size, F.col("y0") + F.col("cy") * size, size / PARTS, pad, PARTS
    )
    calm = []
    while True:
        # parts smaller than the tolerance would not part the segments
        load = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.max(size).alias("size"), F.avg(tolerance).alias("tolerance"))
        load = load.where((F.col("n") > crowded) & (F.col("size") > F.greatest(F.lit(SMALLEST), 4 * PARTS * F.col("tolerance"))))
        load = stored(load.select(*cell), "crowded")
        if load.isEmpty():
            break
        calm.append(placed.join(load, cell, "left_anti"))
        divided = placed.join(load, cell).withColumn("_p", F.explode(parts))
        finer = {"level": F.col("level") + 1, "cx": F.col("cx") * PARTS + F.col("_p.i"), "cy": F.col("cy") * PARTS + F.col("_p.j")}
        placed = stored(divided.withColumns(finer).select(*own), "cells")
    for part in calm:
        placed = placed.union(part.select(*own))
    return placed.drop("x0", "y0", "side")


def _crossing_shapes(shapes: DataFrame, keys: list[str], eps: float, crowded: int) -> DataFrame:
    """Crossing pairs of shapes, once each, with their copies."""
    cells = stored(shape_cells(shapes, keys, crowded), "cells")
    place, values = [*keys, "level", "cx", "cy"], ["shape", "copies", *SHAPE]
    left = cells.select(*place, *[F.col(c).alias(f"l_{c}") for c in values])
    right = cells.select(*place, *[F.col(c).alias(f"r_{c}") for c in values])
    met = left.join(right, place).where((F.col("l_shape") < F.col("r_shape")) & ~_apart() & crosses(eps=eps))
    return met.drop("level", "cx", "cy").dropDuplicates([*keys, "l_shape", "r_shape"])


def split_lines(
    lines: DataFrame, keys: Sequence[str] = LINE, rows: int = WHOLE_ROWS, columns: Sequence[str] = ("seq", "lat", "lon")
) -> tuple[DataFrame, DataFrame | None]:
    """Lines of at most ``rows`` finite vertices, and the others or None; both with ``columns`` only."""
    keys = list(keys)
    lines = lines.select(*keys, *columns).na.drop(subset=keys)
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("lat", "lon")]
    sizes = lines.groupBy(*keys).agg(
        F.min("seq").alias("lo_seq"),
        F.max("seq").alias("hi_seq"),
        ((F.count("*") <= rows) & F.every(finite[0] & finite[1])).alias("_whole"),
    )
    sizes = stored(sizes, "sizes")
    others = sizes.where(~F.col("_whole"))

    def of(some: DataFrame) -> DataFrame:
        return attach(lines, some.withColumnsRenamed({"lo_seq": "_lo", "hi_seq": "_hi"}), keys, lo="_lo", hi="_hi").select(*keys, *columns)

    if others.isEmpty():
        return lines, None
    return of(sizes.where("_whole")), of(others)


def _types(lines: DataFrame, columns: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _whole_crossings(lines: DataFrame, keys: list[str], eps: float, listed: bool) -> DataFrame:
    """Crossing pairs of short lines, or their number per line that has any."""

    def work(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        lat, lon = batch.column("lat").to_numpy(), batch.column("lon").to_numpy()
        for lines_, sizes, rows in whole.matrices(first, len(batch)):
            x, y = whole.filled(lon[rows], sizes), whole.filled(lat[rows], sizes)
            line, p, q = whole.crossing_pairs(x, y, eps, TOUCH_EPS)
            if listed:
                own, found = first[lines_[line]], [batch.column("seq").take(pa.array(rows[line, k])) for k in (p, q)]
            else:
                some, n = np.unique(line, return_counts=True)
                own, found = first[lines_[some]], [pa.array(n.astype("int64"))]
            columns = [batch.column(k).take(pa.array(own)) for k in keys] + found
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    names = ["first_segment", "second_segment"] if listed else ["intersections"]
    kind = dict(lines.dtypes)["seq"] if listed else "bigint"
    return map_whole(lines, keys, work, ", ".join([_types(lines, keys), *[f"{c} {kind}" for c in names]]))


def self_intersections(
    lines: DataFrame, keys: Sequence[str] = LINE, eps: float = ORIENTATION_EPS, crowded: int | None = None
) -> DataFrame:
    """Pairs of crossing segments, numbered by their start vertex (V14); ``crowded`` sends all lines over cells."""
    keys = list(keys)
    if crowded is None:
        short, others = split_lines(lines, keys)
        pairs = _whole_crossings(short, keys, eps, True)
        return pairs if others is None else pairs.unionByName(self_intersections(others, keys, eps, CROWDED))
    segs, shapes = _shapes(lines, keys)
    crossing = _crossing_shapes(shapes, keys, eps, crowded)
    # back from shapes to the segments having them
    first = segs.select(*keys, *[F.col(c).alias(f"l_{c}") for c in SHAPE], F.col("i").alias("p"))
    second = segs.select(*keys, *[F.col(c).alias(f"r_{c}") for c in SHAPE], F.col("i").alias("q"))
    pairs = crossing.join(first, [*keys, *[f"l_{c}" for c in SHAPE]]).join(second, [*keys, *[f"r_{c}" for c in SHAPE]])
    return (
        pairs.select(*keys, F.least("p", "q").alias("first_segment"), F.greatest("p", "q").alias("second_segment"))
        .where(F.col("second_segment") >= F.col("first_segment") + 2)
    )


def crossing_counts(
    lines: DataFrame, keys: Sequence[str] = LINE, eps: float = ORIENTATION_EPS, crowded: int | None = None
) -> DataFrame:
    """``intersections`` per line that has any: crossing shapes, times the copies of both.

    Neighbouring segments share a vertex and never cross, so no pair of V14 is left out, and none is listed.
    """
    keys = list(keys)
    if crowded is None:
        short, others = split_lines(lines, keys)
        counts = _whole_crossings(short, keys, eps, False)
        return counts if others is None else counts.unionByName(crossing_counts(others, keys, eps, CROWDED))
    crossing = _crossing_shapes(_shapes(lines, keys)[1], keys, eps, crowded)
    return crossing.groupBy(*keys).agg(F.sum(F.col("l_copies") * F.col("r_copies")).alias("intersections"))
