"""Wave exposure of shore vertices in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.functions.cells import segment_cells
from strandline.lines import LINE, WHOLE_ROWS, attach, map_whole, spread_out, with_neighbours
from strandline.operators import whole
from strandline.operators.crossings import split_lines
from strandline.operators.geometry import line_reference, project_local
from strandline.operators.spatial import depth_factor, interpolate_depth
from strandline.session import cut_lineage, stored

# Fixed values of the scores.
DEPTH_FLOOR, DEPTH_SHARE = 0.35, 0.65
PROTRUSION_MAX, SHELTER_MAX = 1.5, 1.2
SHAPE_BASE, SHELTER_WEIGHT, SHAPE_LOW, SHAPE_HIGH = 0.55, 0.35, 0.1, 1.75
WIND_REFERENCE, WIND_LOW, WIND_HIGH = 12.0, 0.1, 4.0
SMOOTHING_MAX = 0.5

# Vertices times segments of the lines that a task works on at once.
RAY_PAIRS = 1 << 16
PER_CELL = 8
NEAR_CELLS = 4


@dataclass(frozen=True)
class WaveParams:
    """Parameters after defaulting (see ``normalise_wave`` for tables of them)."""

    strength_m: float
    wind_dir_deg: float = 0.0
    wind_speed: float = 12.0
    fetch_spread_deg: float = 55.0
    fetch_samples: int = 9
    max_fetch_m: float = 150_000.0
    depth_scale_m: float = 4_000.0
    exposure_power: float = 1.5
    max_retreat_m: float = 0.0
    probe_m: float = 25.0

    def probe(self) -> float:
        """Offset of the ray origin, adjusted to the longest fetch."""
        probe = self.probe_m if self.probe_m > 0 else 25.0
        if probe >= self.max_fetch_m:
            probe = self.max_fetch_m * 0.1
        return probe if probe > 0 else 1.0

    def bearings(self) -> list[float]:
        if self.fetch_samples <= 1:
            return [self.wind_dir_deg]
        width = 2 * self.fetch_spread_deg / (self.fetch_samples - 1)
        # positive offsets turn anticlockwise, against the sense of a bearing
        return [self.wind_dir_deg + self.fetch_spread_deg - i * width for i in range(self.fetch_samples)]


def fan_directions(params: DataFrame) -> DataFrame:
    """Unit vectors of the directional fan of each parameter row."""
    n = F.col("fetch_samples")
    fan = params.withColumn("ray", F.explode(F.sequence(F.lit(0), n - 1)))
    offset = F.when(n <= 1, F.lit(0.0)).otherwise(
        -F.col("fetch_spread_deg") + F.try_divide(F.col("ray"), n - 1) * 2 * F.col("fetch_spread_deg")
    )
    mx, my = geo.bearing_unit(F.col("wind_dir_deg"))
    dx, dy = geo.rotate(mx, my, F.radians(offset))
    return fan.withColumns({"offset_deg": offset, "dx": dx, "dy": dy})


def vertex_frames(shores: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Projected vertices with neighbours and unit tangent.

    Rings drop their closing vertex and wrap; the end vertices of open lines
    keep ``framed = false`` and only serve as ends of segments.
    """
    keys = list(keys)
    whole = line_reference(shores, keys)
    working = attach(shores.select(*keys, "seq", "lat", "lon"), whole.select(*keys, "closed", "lo_seq", "hi_seq"), keys)
    working = working.where(~(F.col("closed") & (F.col("seq") == F.col("hi_seq")))).drop("lo_seq", "hi_seq")
    ref = line_reference(working, keys).drop("closed")
    placed = project_local(working, keys, ref)
    nb = with_neighbours(placed, ["x", "y", "seq"], keys, wrap=True)
    tx, ty = geo.unit(F.col("next.x") - F.col("prev.x"), F.col("next.y") - F.col("prev.y"))
    inner = F.col("closed") | ((F.col("seq") > F.col("lo_seq")) & (F.col("seq") < F.col("hi_seq")))
    return nb.select(
        *keys, "seq", "lat", "lon", "x", "y", "closed", "points", "lo_seq", "hi_seq", "ref_lat", "ref_lon",
        "meters_per_deg_lon",
        F.col("prev.seq").alias("pseq"), F.col("prev.x").alias("px"), F.col("prev.y").alias("py"),
        F.col("next.x").alias("nx"), F.col("next.y").alias("ny"),
        tx.alias("tx"), ty.alias("ty"),
        (inner & (F.col("points") >= 3) & ((tx != 0) | (ty != 0))).alias("framed"),
    )


def _with_cell(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Add the grid size of a line: about PER_CELL segments per cell."""
    reach = F.greatest(F.abs(F.col("nx") - F.col("x")), F.abs(F.col("ny") - F.col("y")))
    stats = frames.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(reach).alias("reach"), F.min("lo_seq").alias("lo"), F.max("hi_seq").alias("hi"),
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
    )
    room = F.greatest(F.col("w"), F.col("reach")) * F.greatest(F.col("h"), F.col("reach"))
    cell = F.least(F.greatest(PER_CELL * room / (F.col("n") * F.col("reach")), F.col("reach") / 16), F.col("reach") * 4)
    sized = stats.select(*keys, "lo", "hi", F.greatest(F.coalesce(cell, F.lit(1.0)), F.lit(1.0)).alias("cell"))
    return attach(frames, sized, keys, lo="lo", hi="hi").drop("lo", "hi")


def _ways(p: WaveParams) -> list[tuple[Column, Column]]:
    """Directions of the rays: the fan, then the left and the right normal."""
    fan = [(F.lit(math.sin(math.radians(b))), F.lit(math.cos(math.radians(b)))) for b in p.bearings()]
    return [*fan, (-F.col("ty"), F.col("tx")), (F.col("ty"), -F.col("tx"))]


def ray_fetch(frames: DataFrame, p: WaveParams, keys: Sequence[str] = LINE) -> DataFrame:
    """Fetch along every ray of every framed vertex (W3), one row per ray.

    Rays 0..n-1 form the fan, rays n and n+1 follow the left and right normal.
    """
    keys = list(keys)
    every = [F.struct(F.lit(i).alias("ray"), dx.alias("dx"), dy.alias("dy"), F.col("fetches")[i].alias("fetch")) for i, (dx, dy) in enumerate(_ways(p))]
    return with_fetches(frames, p, keys).select(*keys, "seq", F.explode(F.array(*every)).alias("r")).select(*keys, "seq", "r.*")


def with_fetches(frames: DataFrame, p: WaveParams, keys: Sequence[str] = LINE, rows: int = WHOLE_ROWS) -> DataFrame:
    """Framed vertices with the array ``fetches``, one for each ray.

    Lines of at most ``rows`` vertices come whole to a task, where every ray meets every segment of its line.
    """
    keys = list(keys)
    probe = p.probe()
    limit = p.max_fetch_m - probe
    bearings = [math.radians(b) for b in p.bearings()]
    frames = stored(frames, "frames")
    short, others = split_lines(frames, keys, rows, [c for c in frames.columns if c not in keys])

    def work(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = {c: batch.column(c).to_numpy() for c in ("x", "y", "nx", "ny", "tx", "ty")}
        seq, before = batch.column("seq").to_numpy(), batch.column("pseq").fill_null(-1).to_numpy()
        framed = batch.column("framed").fill_null(False).to_numpy(zero_copy_only=False)
        known = batch.column("pseq").is_valid().to_numpy(zero_copy_only=False)
        segment = batch.column("closed").to_numpy(zero_copy_only=False) | (seq < batch.column("hi_seq").to_numpy())
        fetches = np.full((len(batch), len(bearings) + 2), limit)
        for _, sizes, at in whole.matrices(first, len(batch), RAY_PAIRS):
            inside = np.arange(at.shape[1]) < sizes[:, None]
            x, y, nx, ny, tx, ty = (values[c][at] for c in ("x", "y", "nx", "ny", "tx", "ty"))
            own = (seq[at][:, None, :] == seq[at][:, :, None]) | (seq[at][:, None, :] == before[at][:, :, None])
            allowed = ~own & (segment[at] & inside)[:, None, :] & known[at][:, :, None]
            fan = [(np.full_like(x[:, :1], math.sin(b)), np.full_like(x[:, :1], math.cos(b))) for b in bearings]
            for i, (dx, dy) in enumerate([*fan, (-ty, tx), (ty, -tx)]):
                t = whole.nearest_hits(x, y, nx, ny, allowed, dx, dy, probe, limit)
                fetches[at[inside], i] = t[inside]
        here = pa.array(np.flatnonzero(framed))
        flat = (probe + fetches[framed]).ravel()
        listed = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, fetches.shape[1], dtype=np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.take(here).columns, listed], names=[*batch.schema.names, "fetches"])

    if limit <= 0:
        flat = F.array(*[F.lit(p.max_fetch_m)] * (len(bearings) + 2))
        return frames.where("framed").withColumn("fetches", flat)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in short.schema.fields]
    done = map_whole(short, keys, work, ", ".join([*types, "fetches array<double>"]))
    if others is None:
        return done
    far = _fetch_by_cells(others, p, keys).groupBy(*keys, "seq").agg(
        *[F.max(F.when(F.col("ray") == i, F.col("fetch"))).alias(f"_f{i}") for i in range(len(bearings) + 2)]
    )
    listed = F.array(*[F.col(f"_f{i}") for i in range(len(bearings) + 2)])
    met = others.where("framed").join(far, [*keys, "seq"]).withColumn("fetches", listed)
    return done.unionByName(met.select(*done.columns))


def _fetch_by_cells(frames: DataFrame, p: WaveParams, keys: list[str]) -> DataFrame:
    """Fetch along every ray of lines of any length.

    A vertex first meets the segments of the cells around it, once for all of its rays:
    the nearest hit of every ray is one minimum of one aggregate.  Only rays
    without a hit there go on, in rounds of four times the reach over cells of four times
    the size, so that a ray passes a bounded number of cells in each.  Meeting a segment in
    several cells is harmless to a minimum.
    """
    sized = cut_lineage(_with_cell(frames, keys))
    probe = p.probe()
    limit = p.max_fetch_m - probe
    ways = _ways(p)
    at = sized.where("framed")
    has_segment = F.col("closed") | (F.col("seq") < F.col("hi_seq"))
    segs = sized.where(has_segment).select(
        *keys, F.col("seq").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.col("nx").alias("bx"), F.col("ny").alias("by"), "cell",
    )

    def crossing(dx: Column, dy: Column, ox: Column, oy: Column, reach: Column) -> Column:
        """Distance from the ray's origin to a segment that it hits within reach."""
        sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        den = geo.cross(dx, dy, sx, sy)
        ex, ey = F.col("ax") - ox, F.col("ay") - oy
        t, u = F.try_divide(geo.cross(ex, ey, sx, sy), den), F.try_divide(geo.cross(ex, ey, dx, dy), den)
        return F.when((F.abs(den) >= 1e-9) & (t > 1e-6) & u.between(-1e-6, 1 + 1e-6) & (t <= reach), t)

    others = (F.col("seg") != F.col("seq")) & (F.col("seg") != F.col("pseq"))
    cell_keys = [*keys, "cx", "cy"]

    def segment_table(size: Column) -> DataFrame:
        cells = F.explode(segment_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), size))
        return segs.withColumn("_c", cells).select(*keys, "seg", "ax", "ay", "bx", "by", "_c.cx", "_c.cy")

    # the cells around a vertex reach as far as its rays do in the first round
    near = F.least(F.lit(limit), F.col("cell") * NEAR_CELLS)
    size = near + probe + 1.0
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    homes = at.select(*keys, "seq", "pseq", "x", "y", "tx", "ty", "cell", size.alias("_s")).withColumn("_i", around).withColumn("_j", around)
    homes = homes.withColumns({"cx": F.floor(F.col("x") / F.col("_s")) + F.col("_i"), "cy": F.floor(F.col("y") / F.col("_s")) + F.col("_j")})
    met = spread_out(homes.drop("_i", "_j", "_s"), cell_keys).join(spread_out(segment_table(size), cell_keys), cell_keys).where(others)
    nearest = [
        F.min(crossing(dx, dy, F.col("x") + dx * probe, F.col("y") + dy * probe, near)).alias(f"t{i}") for i, (dx, dy) in enumerate(ways)
    ]
    found = met.groupBy(*keys, "seq").agg(*nearest)
    every = F.array(
        *[F.struct(F.lit(i).alias("ray"), dx.alias("dx"), dy.alias("dy"), F.col(f"t{i}").alias("t")) for i, (dx, dy) in enumerate(ways)]
    )
    best = at.join(found, [*keys, "seq"], "left").withColumn("_r", F.explode(every)).select(
        *keys, "seq", "pseq", "cell", "x", "y", "_r.ray", "_r.dx", "_r.dy", "_r.t", near.alias("reach")
    )
    best = stored(best, "rays")
    settled, going = [], (F.col("t").isNull()) & (F.col("reach") < limit)
    factor = 1
    while not best.where(going).isEmpty():  # reach grows fourfold, up to the limit
        settled.append(best.where(~going))
        factor *= 4
        rays = best.where(going).withColumns(
            {
                "ox": F.col("x") + F.col("dx") * probe, "oy": F.col("y") + F.col("dy") * probe,
                "upto": F.least(F.lit(limit), F.col("reach") * 4),
            }
        )
        size = F.col("cell") * factor
        ends = [F.col(o) + F.col(d) * F.col(r) for r in ("reach", "upto") for o, d in (("ox", "dx"), ("oy", "dy"))]
        passed = spread_out(rays, [*keys, "seq"]).withColumn("_c", F.explode(segment_cells(*ends, size)))
        passed = passed.select(*keys, "seq", "pseq", "ray", "ox", "oy", "dx", "dy", "upto", "_c.cx", "_c.cy")
        met = spread_out(passed, cell_keys).join(spread_out(segment_table(size), cell_keys), cell_keys).where(others)
        hit = F.min(crossing(F.col("dx"), F.col("dy"), F.col("ox"), F.col("oy"), F.col("upto"))).alias("_t")
        hits = met.groupBy(*keys, "seq", "ray").agg(hit)
        best = rays.join(hits, [*keys, "seq", "ray"], "left").select(
            *[F.coalesce("t", "_t").alias("t") if c == "t" else F.col("upto").alias("reach") if c == "reach" else F.col(c) for c in best.columns]
        )
        best = stored(best, "rays")
    for part in settled:
        best = best.union(part)
    best = best.withColumn("t", F.coalesce("t", F.lit(limit)))
    return best.select(*keys, "seq", "ray", "dx", "dy", (F.lit(probe) + F.col("t")).alias("fetch"))


def side_scores(
    frames: DataFrame,
    fetches: DataFrame | None,
    p: WaveParams,
    depths: DataFrame | None = None,
    resolution: float = 0.1,
    keys: Sequence[str] = LINE,
) -> DataFrame:
    """Score of both sides of every framed vertex (W4); ``fetches`` has a row per ray, or is None if ``frames`` has the array."""
    keys = list(keys)
    n = p.fetch_samples
    at = frames.where("framed")
    if depths is not None:
        at = interpolate_depth(at, depths, resolution).drop("status")
    else:
        at = at.withColumn("depth", F.lit(None).cast("double"))
    if fetches is None:
        scored = at.withColumns({f"{t}_{c}": v for t, own in _side_sums(p).items() for c, v in own.items()}).drop("fetches")
        # the sums are long expressions, which those that follow would repeat
        return _scored_sides(stored(scored, "sides"), p)
    rays = fetches.join(at.select(*keys, "seq", "tx", "ty"), [*keys, "seq"])
    in_fan = F.col("ray") < n
    left = geo.dot(-F.col("ty"), F.col("tx"), F.col("dx"), F.col("dy"))

    def side(sign: int, normal_ray: int, tag: str) -> list[Column]:
        incidence = left * sign
        weight = F.when(in_fan & (incidence > 0), F.pow(incidence, F.lit(p.exposure_power)))
        return [
            F.sum(weight).alias(f"{tag}_weight"),
            F.sum(weight * F.col("fetch")).alias(f"{tag}_pull"),
            F.max(F.when(F.col("ray") == normal_ray, F.col("fetch"))).alias(f"{tag}_normal_fetch"),
        ]

    sums = rays.groupBy(*keys, "seq").agg(*side(1, n, "left"), *side(-1, n + 1, "right"))
    return _scored_sides(at.join(sums, [*keys, "seq"]), p)


def _side_sums(p: WaveParams) -> dict[str, dict[str, Column]]:
    """Weight, pull and fetch along the normal of both sides from the array ``fetches``, summed from the first ray on."""
    out = {}
    ways = _ways(p)[:-2]
    for sign, tag in ((1, "left"), (-1, "right")):
        incidences = [geo.dot(-F.col("ty"), F.col("tx"), dx, dy) * sign for dx, dy in ways]
        weights = [F.when(i > 0, F.pow(i, F.lit(p.exposure_power))).otherwise(F.lit(0.0)) for i in incidences]
        weight = reduce(lambda a, b: a + b, weights)
        pull = reduce(lambda a, b: a + b, [w * F.col("fetches")[k] for k, w in enumerate(weights)])
        out[tag] = {
            "weight": F.when(weight > 0, weight),
            "pull": F.when(weight > 0, pull),
            "normal_fetch": F.col("fetches")[len(ways) + (sign < 0)],
        }
    return out


def _scored_sides(scored: DataFrame, p: WaveParams) -> DataFrame:
    n = p.fetch_samples
    for tag in ("left", "right"):
        weight = F.col(f"{tag}_weight")
        mean = F.col(f"{tag}_pull") / weight
        deep = F.coalesce(
            depth_factor(F.col("depth"), p.depth_scale_m), 1 - F.exp(-F.col(f"{tag}_normal_fetch") / p.depth_scale_m)
        )
        score = (
            F.sqrt(geo.clamp(mean / p.max_fetch_m, 0.0, 1.0))
            * geo.clamp(weight / n, 0.0, 1.0)
            * (DEPTH_FLOOR + DEPTH_SHARE * deep)
        )
        scored = scored.withColumns(
            {f"{tag}_mean_fetch": F.coalesce(mean, F.lit(0.0)), f"{tag}_score": F.coalesce(score, F.lit(0.0))}
        )
    return scored.drop(*[f"{t}_{c}" for t in ("left", "right") for c in ("pull", "normal_fetch", "weight")])


def seaward_side(scored: DataFrame, p: WaveParams) -> DataFrame:
    """Choose the seaward side; vertices without score drop out."""
    mx, my = math.sin(math.radians(p.wind_dir_deg)), math.cos(math.radians(p.wind_dir_deg))
    toward_right = geo.dot(F.col("ty"), -F.col("tx"), F.lit(mx), F.lit(my))
    right = (F.col("right_score") > F.col("left_score")) | (
        (F.abs(F.col("right_score") - F.col("left_score")) <= 1e-9) & (toward_right > -toward_right)
    )
    return (
        scored.withColumn("side", F.when(right, "right").otherwise("left"))
        .withColumn("score", F.when(F.col("side") == "right", F.col("right_score")).otherwise(F.col("left_score")))
        .withColumn("sea_x", F.when(F.col("side") == "right", F.col("ty")).otherwise(-F.col("ty")))
        .withColumn("sea_y", F.when(F.col("side") == "right", -F.col("tx")).otherwise(F.col("tx")))
        .where(F.col("score") > 0)
    )


def shape_factors(sided: DataFrame) -> DataFrame:
    """Protrusion and shelter from the offset to the neighbours' midpoint."""
    hx, hy = (F.col("px") + F.col("nx")) / 2 - F.col("x"), (F.col("py") + F.col("ny")) / 2 - F.col("y")
    scale = 0.5 * (
        geo.length2d(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        + geo.length2d(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
    )
    shaped = sided.withColumns({"shape_x": hx, "shape_y": hy, "local_scale": scale}).where(F.col("local_scale") > 1e-6)
    pull = geo.dot(F.col("shape_x"), F.col("shape_y"), F.col("sea_x"), F.col("sea_y")) / F.col("local_scale")
    return shaped.withColumns(
        {"protrusion": geo.clamp(-pull, 0.0, PROTRUSION_MAX), "shelter": geo.clamp(pull, 0.0, SHELTER_MAX)}
    )


def wind_factor(speed: Column) -> Column:
    return geo.clamp(F.pow(speed / WIND_REFERENCE, F.lit(2.0)), WIND_LOW, WIND_HIGH)


def retreat_potential(shaped: DataFrame, p: WaveParams) -> DataFrame:
    """Potential retreat per vertex, capped."""
    form = geo.clamp(SHAPE_BASE + F.col("protrusion") - SHELTER_WEIGHT * F.col("shelter"), SHAPE_LOW, SHAPE_HIGH)
    retreat = F.lit(p.strength_m) * wind_factor(F.lit(p.wind_speed)) * F.col("score") * form
    cap = p.max_retreat_m if p.max_retreat_m > 0 else p.strength_m
    if cap > 0:
        retreat = F.least(retreat, F.lit(cap))
    return shaped.withColumn("retreat_m", retreat)


def resisted(retreats: DataFrame, resistance: str = "rock_resistance") -> DataFrame:
    """Divide by rock resistance where it is positive."""
    r = F.col(resistance)
    return retreats.withColumn("retreat_m", F.when(r > 0, F.col("retreat_m") / r).otherwise(F.col("retreat_m")))


def moved_shore(frames: DataFrame, retreats: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Implied position of every vertex after one pass, rings closed again."""
    keys = list(keys)
    alpha = F.least(F.col("retreat_m") / F.col("local_scale"), F.lit(SMOOTHING_MAX))
    shifts = retreats.where(F.col("retreat_m") > 0).select(
        *keys,
        "seq",
        (-F.col("sea_x") * F.col("retreat_m") + F.col("shape_x") * alpha).alias("sx"),
        (-F.col("sea_y") * F.col("retreat_m") + F.col("shape_y") * alpha).alias("sy"),
    )
    zero = F.lit(0.0)
    x = F.col("x") + F.coalesce("sx", zero)
    y = F.col("y") + F.coalesce("sy", zero)
    moved = frames.join(shifts, [*keys, "seq"], "left").select(
        *keys,
        "seq",
        (F.col("ref_lat") + y / geo.METERS_PER_DEG_LAT).alias("lat"),
        (F.col("ref_lon") + x / F.col("meters_per_deg_lon")).alias("lon"),
        F.col("sx").isNotNull().alias("moved"),
        (F.col("closed") & (F.col("seq") == F.col("lo_seq"))).alias("_start"),
        "hi_seq",
    )
    closing = moved.where("_start").withColumn("seq", (F.col("hi_seq") + 1).cast("int"))
    return moved.unionByName(closing).drop("_start", "hi_seq")


def wave_pass(
    shores: DataFrame, p: WaveParams, depths: DataFrame | None = None, resolution: float = 0.1, keys: Sequence[str] = LINE
) -> tuple[DataFrame, DataFrame]:
    """Frames and uncapped-by-rock retreats of one pass."""
    frames = cut_lineage(vertex_frames(shores, keys))
    scored = side_scores(with_fetches(frames, p, keys), None, p, depths, resolution, keys)
    return frames, cut_lineage(retreat_potential(shape_factors(seaward_side(scored, p)), p))
