"""Grid cells touched by a segment, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: Column) -> Column:
    """Array of (cx, cy) structs covering a segment, padded by a thousandth of a cell.

    Column by column: the part of the segment inside a column spans an interval
    of rows, so a long segment touches a path of cells and not its whole box.
    """
    pad = cell * 1e-3
    lo_x, hi_x = F.least(x1, x2) - pad, F.greatest(x1, x2) + pad
    lo_y, hi_y = F.least(y1, y2), F.greatest(y1, y2)
    steep = F.abs(x2 - x1) <= pad
    slope = (y2 - y1) / F.when(steep, F.lit(1.0)).otherwise(x2 - x1)

    def column(cx: Column) -> Column:
        left, right = F.greatest(lo_x, cx * cell), F.least(hi_x, (cx + 1) * cell)
        at_left, at_right = y1 + (left - x1) * slope, y1 + (right - x1) * slope
        low = F.when(steep, lo_y).otherwise(F.greatest(lo_y, F.least(at_left, at_right)))
        high = F.when(steep, hi_y).otherwise(F.least(hi_y, F.greatest(at_left, at_right)))
        rows = F.sequence(F.floor((F.least(low, high) - pad) / cell), F.floor((F.greatest(low, high) + pad) / cell))
        return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(lo_x / cell), F.floor(hi_x / cell)), column))


def sub_cells(
    x1: Column, y1: Column, x2: Column, y2: Column, left: Column, low: Column, size: Column, pad: Column, parts: int
) -> Column:
    """Array of (i, j) structs: parts of the cell with corner (left, low) that a segment comes within ``pad`` of.

    ``size`` is a part's side; the array has at most ``parts`` squared entries.
    """
    lo_x, hi_x = F.least(x1, x2), F.greatest(x1, x2)
    lo_y, hi_y = F.least(y1, y2), F.greatest(y1, y2)
    steep = hi_x - lo_x <= pad
    slope = (y2 - y1) / F.when(steep, F.lit(1.0)).otherwise(x2 - x1)

    def number(value: Column, corner: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.floor((value - corner) / size), F.lit(float(parts)))).cast("int")

    def column(i: Column) -> Column:
        a = F.greatest(lo_x, left + i * size - pad)
        b = F.least(hi_x, left + (i + 1) * size + pad)
        at_a, at_b = y1 + (a - x1) * slope, y1 + (b - x1) * slope
        bottom = F.when(steep, lo_y).otherwise(F.greatest(lo_y, F.least(at_a, at_b)))
        top = F.when(steep, hi_y).otherwise(F.least(hi_y, F.greatest(at_a, at_b)))
        first = F.greatest(number(F.least(bottom, top) - pad, low), F.lit(0))
        last = F.least(number(F.greatest(bottom, top) + pad, low), F.lit(parts - 1))
        rows = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(rows, lambda j: F.struct(i.alias("i"), j.alias("j")))

    first = F.greatest(number(lo_x - pad, left), F.lit(0))
    last = F.least(number(hi_x + pad, left), F.lit(parts - 1))
    columns = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(columns, column))
