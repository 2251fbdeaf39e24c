"""Depth grid, bilinear lookup, nearest points and rock interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import lookup_join, with_one_row
from strandline.session import stored

# Fixed values of the rock interpolation.
NEIGHBOURS = 6
EXACT_HIT_DEG = 1e-6
DEFAULT_CLASS = "limestone"
DEFAULT_RESISTANCE = 2.5
DEFAULT_COLOR = "#8b8b8b"
DEFAULT_DESCRIPTION = "default lithology"


def build_grid(points: DataFrame, resolution: float) -> DataFrame:
    """Depth per cell; the last sample in input order wins."""
    return points.groupBy(
        F.floor(F.col("lat") / resolution).alias("i"), F.floor(F.col("lon") / resolution).alias("j")
    ).agg(F.max_by("depth", "ord").alias("depth"))


def grid_bounds(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


def interpolate_depth(points: DataFrame, samples: DataFrame, resolution: float) -> DataFrame:
    """Add ``depth`` and ``status`` by bilinear interpolation.

    The four corners are looked up once per distinct cell; the points then meet
    their cell in one equi-join.  Corner keys are derived from the cell corner
    in floating point, as the cell walls are.
    """
    res = F.lit(resolution)
    grid = build_grid(samples, resolution)
    bounds = grid_bounds(samples)
    keyed = points.withColumns({"_ci": F.floor(F.col("lat") / res), "_cj": F.floor(F.col("lon") / res)})
    cells = keyed.select("_ci", "_cj").distinct()

    def corner(index: Column, step: int) -> Column:
        start = index.cast("double") * res
        return F.floor((start + res if step else start) / res)

    corners = cells.select(
        "_ci",
        "_cj",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(2 * a + b).alias("k"), corner(F.col("_ci"), a).alias("i"), corner(F.col("_cj"), b).alias("j"))
                    for a in (0, 1)
                    for b in (0, 1)
                ]
            )
        ).alias("c"),
    ).select("_ci", "_cj", "c.k", "c.i", "c.j")
    looked = corners.join(grid, ["i", "j"]).groupBy("_ci", "_cj").agg(
        *[F.max(F.when(F.col("k") == k, F.col("depth"))).alias(f"_d{k}") for k in range(4)]
    )
    met = with_one_row(lookup_join(keyed, looked, ["_ci", "_cj"], "left"), bounds)
    fx = (F.col("lon") - F.col("_cj").cast("double") * res) / res
    fy = (F.col("lat") - F.col("_ci").cast("double") * res) / res
    low = F.col("_d0") + fx * (F.col("_d1") - F.col("_d0"))
    high = F.col("_d2") + fx * (F.col("_d3") - F.col("_d2"))
    value = low + fy * (high - low)
    outside = ~(
        F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    )
    status = F.when(outside, "outside").when(value.isNull(), "missing").otherwise("ok")
    return met.withColumn("status", status).withColumn("depth", F.when(F.col("status") == "ok", value)).drop(
        "_ci", "_cj", "_d0", "_d1", "_d2", "_d3", "min_lat", "max_lat", "min_lon", "max_lon"
    )


def depth_factor(depth: Column, scale_m: float | Column) -> Column:
    """Share of wave energy reaching the shore over a depth."""
    scale = scale_m if isinstance(scale_m, Column) else F.lit(scale_m)
    return F.when(depth.isNotNull(), 1 - F.exp(-F.greatest(-depth, F.lit(0.0)) / scale))


# -- nearest points ----------------------------------------------------------

#: Halvings of the box that the finest cells are made by, and halvings from one tier of cells to the next.
DEPTH, STEP = 48, 3
#: A cell with more points than this is divided before its points are looked at.
CROWDED = 12
CELL = ["depth", "ci", "cj"]


def _keep_first(points: DataFrame, k: int) -> DataFrame:
    """At most ``k`` points per position can be among the nearest ``k``.

    The rank filter is applied before the shuffle too, so a position holding a
    large share of all points sends only ``k`` rows per task.
    """
    w = Window.partitionBy("lat", "lon").orderBy("ord")
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _finest(value: str, low: Column, side: Column) -> Column:
    """Number of the finest cell along one axis; the far border belongs to the last cell."""
    return F.least(F.floor((F.col(value) - low) / side * float(2**DEPTH)), F.lit(2**DEPTH - 1))


def _at_depths(rows: DataFrame) -> DataFrame:
    """Every row once per tier of cells, with its cell."""
    def cell(name):
        return F.call_function("shiftright", F.col(name), F.lit(DEPTH) - F.col("depth"))

    tiers = F.explode(F.sequence(F.lit(0), F.lit(DEPTH), F.lit(STEP)))
    return rows.withColumn("depth", tiers).withColumns({"ci": cell("fi"), "cj": cell("fj")})


def _reach(frontier: DataFrame, k: int) -> DataFrame:
    """Cells that can hold one of the ``k`` nearest points of their place.

    Going through a place's cells by their farthest point, the one that brings the count to ``k``
    bounds the distance; cells that begin beyond are left out.
    """
    zero = F.lit(0.0)
    lat, lon = F.col("lat"), F.col("lon")
    near = geo.length2d(
        F.greatest(F.col("lat0") - lat, lat - F.col("lat1"), zero), F.greatest(F.col("lon0") - lon, lon - F.col("lon1"), zero)
    )
    far = geo.length2d(
        F.greatest(F.abs(lat - F.col("lat0")), F.abs(lat - F.col("lat1"))),
        F.greatest(F.abs(lon - F.col("lon0")), F.abs(lon - F.col("lon1"))),
    )
    place = Window.partitionBy("lat", "lon")
    before = place.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    ranked = frontier.withColumns({"_near": near, "_far": far}).withColumn("_sum", F.sum("n").over(before))
    limit = F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(place)
    ranked = ranked.withColumn("_limit", F.coalesce(limit, F.lit(float("inf"))))
    return ranked.where(F.col("_near") <= F.col("_limit") + 1e-9).drop("_near", "_far", "_sum", "_limit")


def candidate_cells(places: DataFrame, points: DataFrame, k: int, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """(place and cell, point and cell): cells that hold the ``k`` nearest points of each distinct place.

    The points' box is divided into cells again and again; of every cell the count and the
    true bounds of its points are known. A place starts at the smallest cell
    around it with ``k`` points: all of the nearest lie within that cell's diagonal, so within
    five cells in each direction. Then, in rounds, crowded cells are replaced by their parts and
    what is out of reach is dropped, until every cell holds ``crowded`` points or fewer (or is
    of the finest tier, which holds ``k`` per position). Cells of a place stay few wherever it lies: far
    from everything, between dense and empty regions, or inside a crowd.
    """
    both = places.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    box = both.union(points.select("lat", "lon")).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if box[0] is None:
        box = (0.0, 0.0, 0.0, 0.0)
    low_lat, low_lon = F.lit(box[0]), F.lit(box[2])
    width = max(box[1] - box[0], box[3] - box[2], 1e-9)
    numbers = {"fi": _finest("lat", low_lat, F.lit(width)), "fj": _finest("lon", low_lon, F.lit(width))}
    kept = stored(_keep_first(points, k).withColumns(numbers), "points")
    tiers = _at_depths(kept.select("lat", "lon", "fi", "fj"))
    bounds = {"lat0": F.min("lat"), "lat1": F.max("lat"), "lon0": F.min("lon"), "lon1": F.max("lon")}
    cells = stored(tiers.groupBy(*CELL).agg(F.count("*").alias("n"), *[v.alias(c) for c, v in bounds.items()]), "cells")

    enough = cells.where((F.col("n") >= k) | (F.col("depth") == 0)).select(*CELL)
    own = _at_depths(both.withColumns(numbers)).join(enough, CELL, "left_semi")
    start = own.groupBy("lat", "lon").agg(F.max(F.struct(*CELL)).alias("c")).select("lat", "lon", "c.*")
    for axis in ("ci", "cj"):
        start = start.withColumn(axis, F.explode(F.sequence(F.col(axis) - 2, F.col(axis) + 2)))
    frontier = stored(_reach(start.join(cells, CELL), k), "frontier")
    parents = {"depth": F.col("depth") - STEP} | {c: F.call_function("shiftright", F.col(c), F.lit(STEP)) for c in ("ci", "cj")}
    parts = cells.select(*[v.alias(f"p_{c}") for c, v in parents.items()], *cells.columns)
    open_ = (F.col("n") > crowded) & (F.col("depth") < DEPTH)
    while not frontier.where(open_).isEmpty():  # as many rounds as tiers, at most
        crowd = frontier.where(open_).select("lat", "lon", *[F.col(c).alias(f"p_{c}") for c in CELL])
        divided = crowd.join(parts, [f"p_{c}" for c in CELL]).select("lat", "lon", *cells.columns)
        frontier = stored(_reach(frontier.where(~open_).select("lat", "lon", *cells.columns).union(divided), k), "frontier")
    wanted = stored(frontier.select(*CELL).distinct(), "wanted")
    return frontier.select("lat", "lon", *CELL), _at_depths(kept).join(wanted, CELL).drop("fi", "fj")


def nearest_points(places: DataFrame, points: DataFrame, k: int = NEIGHBOURS, carry: Sequence[str] = ()) -> DataFrame:
    """Add ``near``: the ``k`` nearest points in planar degrees, ties by order (I4).

    Distinct places meet the points of their candidate cells; the rank filter is applied before
    the shuffle too, so a place is never listed with more than ``k`` points.
    """
    cells, found = candidate_cells(places, points.select("ord", "lat", "lon", *carry), k)
    point = found.select(*CELL, "ord", F.col("lat").alias("plat"), F.col("lon").alias("plon"), *carry)
    met = cells.join(point, CELL)
    met = met.withColumn("dist", geo.length2d(F.col("plat") - F.col("lat"), F.col("plon") - F.col("lon")))
    first = Window.partitionBy("lat", "lon").orderBy("dist", "ord")
    top = met.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    lists = top.groupBy("lat", "lon").agg(F.array_sort(F.collect_list(F.struct("dist", "ord", *carry))).alias("near"))
    return lookup_join(places, stored(lists, "nearest"), ["lat", "lon"], "left")


def default_rock(classes: DataFrame) -> DataFrame:
    """One row: resistance and colour of the default rock."""
    is_default = F.col("class") == DEFAULT_CLASS
    return classes.agg(
        F.coalesce(F.max(F.when(is_default, F.col("resistance"))), F.lit(DEFAULT_RESISTANCE)).alias("_dr"),
        F.coalesce(F.max(F.when(is_default, F.col("color"))), F.lit(DEFAULT_COLOR)).alias("_dc"),
    )


def rock_at(
    places: DataFrame,
    points: DataFrame,
    classes: DataFrame,
    bounds: dict[str, float] | None = None,
) -> DataFrame:
    """Rock class and resistance by inverse-distance weighting.

    Outside the bounds, without points, or with an unknown class of the nearest
    point, the default rock is used.  Weights fall with distance, so the
    heaviest neighbour is the nearest one.
    """
    known = classes.select(F.col("class").alias("lithology_class"), F.lit(True).alias("known"))
    tagged = lookup_join(points, known, ["lithology_class"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )
    carry = ["lithology_class", "resistance", "color", "description", "known"]
    met = with_one_row(nearest_points(places, tagged, NEIGHBOURS, carry), default_rock(classes))
    weights = F.transform("near", lambda p: F.lit(1.0) / (p["dist"] * p["dist"]))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    pulled = F.aggregate(
        F.transform("near", lambda p: p["resistance"] / (p["dist"] * p["dist"])), F.lit(0.0), lambda s, w: s + w
    )
    head = F.get("near", 0)
    usable = F.coalesce(head["known"], F.lit(False))
    if bounds is not None:
        usable = usable & F.col("lat").between(bounds["min_lat"], bounds["max_lat"]) & F.col("lon").between(
            bounds["min_lon"], bounds["max_lon"]
        )
    hit = head["dist"] < EXACT_HIT_DEG
    # one expression per value; an exact hit must not divide by its zero distance
    value = F.when(hit | (F.size("near") == 1), head["resistance"]).otherwise(pulled / total)
    return met.select(
        *places.columns,
        F.when(usable, head["lithology_class"]).otherwise(F.lit(DEFAULT_CLASS)).alias("rock"),
        F.when(usable, value).otherwise(F.col("_dr")).alias("rock_resistance"),
        F.when(usable, head["color"]).otherwise(F.col("_dc")).alias("rock_color"),
        F.when(usable, head["description"]).otherwise(F.lit(DEFAULT_DESCRIPTION)).alias("rock_description"),
    )


def profile_statistics(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, resistance range and mean of a profile."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("num_points"),
        F.min("resistance").alias("resistance_min"),
        F.max("resistance").alias("resistance_max"),
        F.avg("resistance").alias("resistance_mean"),
    )


def confidence_distribution(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points per confidence label."""
    return points.groupBy(*keys, "confidence").agg(F.count("*").alias("num_points"))
