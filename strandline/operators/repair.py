"""Vertex-order repair (V13): greedy traversals compared by score.

The reversal of an order has the same score, so it can never replace it and is
not built.  Lines of at most ``WHOLE_ROWS`` vertices are walked, scored and repaired many at once in
a task, which sends only the best order.  A greedy walk is sequential; lines of at most ``LOCAL_POINTS``
vertices walk inside one task per line.  Longer lines walk in rounds, all lines
at once: each round fetches the ``TILE`` nearest unvisited vertices of every
walk and goes on as long as no vertex outside them can be nearer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import LINE, attach, map_whole, spread_out
from strandline.operators import whole
from strandline.operators.crossings import ORIENTATION_EPS, TOUCH_EPS, split_lines
from strandline.operators.quality import LONG_SEGMENT_KM, better_score, candidate_starts, order_score
from strandline.session import cut_lineage, stored

LOCAL_POINTS = 20_000
TABLE_POINTS = 1_500
TILE = 5_000


def _km(lat1, lon1, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    half_lat, half_lon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    h = np.sin(half_lat) ** 2 + np.sin(half_lon) ** 2 * np.cos(np.radians(lat1)) * np.cos(np.radians(lat2))
    return 2 * geo.EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def greedy_order(lat: np.ndarray, lon: np.ndarray, start: int) -> np.ndarray:
    """Indices of a nearest-unvisited walk; distances equal to a micrometre tie,
    and the earlier vertex wins."""
    n = len(lat)
    order = np.empty(n, dtype=np.int64)
    order[0] = start
    gone = np.zeros(n)
    gone[start] = np.inf
    table = None
    if n <= TABLE_POINTS:
        table = np.round(_km(lat[:, None], lon[:, None], lat[None, :], lon[None, :]), 9)
    for k in range(1, n):
        prev = order[k - 1]
        d = table[prev] if table is not None else np.round(_km(lat[prev], lon[prev], lat, lon), 9)
        order[k] = np.argmin(d + gone)
        gone[order[k]] = np.inf
    return order


def advance(lat, lon, from_lat: float, from_lon: float, reach: float) -> list[int]:
    """Walk over the nearest vertices of a place while the result is certain.

    Everything within ``reach`` of the place is given (in order of number), so
    a vertex at distance d from a walker that moved away by m is the nearest of
    all when d < reach - m.  The first step is always certain.
    """
    gone = np.zeros(len(lat))
    out: list[int] = []
    here = (from_lat, from_lon)
    while len(out) < len(lat):
        d = np.round(_km(here[0], here[1], lat, lon), 9) + gone
        q = int(np.argmin(d))
        moved = float(_km(from_lat, from_lon, np.array([here[0]]), np.array([here[1]]))[0])
        if out and not d[q] < reach - moved - 1e-6:
            break
        out.append(q)
        gone[q] = np.inf
        here = (lat[q], lon[q])
    return out


def _walk_in_rounds(points: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Greedy orders of long lines; ``points`` has ``position`` and ``start_seq``."""
    walk = [*keys, "position"]
    points = cut_lineage(points)
    first = points.where(F.col("seq") == F.col("start_seq")).select(
        *walk, "seq", "lat", "lon", F.lit(1).alias("k"), "lo_seq", "hi_seq"
    )
    left = points.where(F.col("seq") != F.col("start_seq")).select(*walk, "seq", "lat", "lon")
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    out_schema = ", ".join(f"{c} {fields[c]}" for c in [*walk, "seq"]) + ", lat double, lon double, k int, lo_seq int, hi_seq int"
    done = [first]
    state = first

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        reach = float(pdf.dist.max()) if len(pdf) >= tile else np.inf
        pdf = pdf.sort_values("seq", ignore_index=True)
        steps = advance(pdf.lat.to_numpy(), pdf.lon.to_numpy(), head.clat, head.clon, reach)
        out = pdf.iloc[steps][[*walk, "seq", "lat", "lon"]]
        return out.assign(
            k=np.arange(1, len(out) + 1, dtype="int32") + np.int32(head.ck), lo_seq=np.int32(head.lo_seq), hi_seq=np.int32(head.hi_seq)
        )

    while not left.isEmpty():
        at = state.select(
            *walk, F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.col("k").alias("ck"), "lo_seq", "hi_seq"
        )
        near = attach(left, at, walk).withColumn(
            "dist", F.round(geo.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")), 9)
        )
        by_dist = [F.col("dist"), F.col("seq")]
        salted = near.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(256)))
        some = salted.withColumn(
            "_r", F.row_number().over(Window.partitionBy(*walk, "_salt").orderBy(*by_dist))
        ).where(F.col("_r") <= tile)
        top = some.withColumn("_r", F.row_number().over(Window.partitionBy(*walk).orderBy(*by_dist))).where(
            F.col("_r") <= tile
        )
        step = cut_lineage(top.drop("_r", "_salt").groupBy(*walk).applyInPandas(go, out_schema))
        done.append(step)
        last = F.max_by(F.struct("lat", "lon"), F.col("k"))
        state = step.groupBy(*walk).agg(
            last.alias("p"), F.max("k").alias("k"), F.min("lo_seq").alias("lo_seq"), F.max("hi_seq").alias("hi_seq")
        ).select(*walk, "p.lat", "p.lon", "k", "lo_seq", "hi_seq")
        left = cut_lineage(left.join(step.select(*walk, "seq"), [*walk, "seq"], "left_anti"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        *keys, (F.col("position") + 1).cast("int").alias("candidate"), F.col("k").cast("int").alias("seq"), "lat", "lon"
    )


def candidate_orders(
    lines: DataFrame, keys: Sequence[str] = LINE, local_points: int = LOCAL_POINTS, tile: int = TILE
) -> DataFrame:
    """The given order (candidate 0) and one greedy order per candidate start."""
    keys = list(keys)
    base = lines.select(*keys, F.col("seq").cast("int").alias("seq"), "lat", "lon")
    sizes = base.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq")
    )
    starts = candidate_starts(base, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", "start_seq"))).alias("starts")
    )
    starts = starts.withColumn("starts", F.transform("starts", lambda s: s["start_seq"])).join(sizes, keys)
    short = attach(base, starts.where(F.col("n") <= local_points), keys).select(*keys, "seq", "lat", "lon", "starts")
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", candidate int, seq int, lat double, lon double"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        seq, lat, lon = pdf.seq.to_numpy(), pdf.lat.to_numpy(), pdf.lon.to_numpy()
        orders = [greedy_order(lat, lon, int(np.searchsorted(seq, s))) for s in pdf.starts.iloc[0]]
        picked = np.concatenate(orders)
        return pd.DataFrame(
            {k: pdf[k].iloc[0] for k in keys}
            | {
                "candidate": np.repeat(np.arange(1, len(orders) + 1, dtype="int32"), len(seq)),
                "seq": np.tile(np.arange(1, len(seq) + 1, dtype="int32"), len(orders)),
                "lat": lat[picked],
                "lon": lon[picked],
            }
        )

    local = spread_out(short, keys).groupBy(*keys).applyInPandas(walk, schema)
    as_is = base.select(*keys, F.lit(0).alias("candidate"), "seq", "lat", "lon")
    out = as_is.unionByName(local)
    long = starts.where(F.col("n") > local_points)
    if not long.isEmpty():
        unfolded = long.select(*keys, "lo_seq", "hi_seq", F.posexplode("starts").alias("position", "start_seq"))
        points = attach(base, unfolded, keys).select(
            *keys, "position", "start_seq", "seq", "lat", "lon", "lo_seq", "hi_seq"
        )
        out = out.unionByName(_walk_in_rounds(points, keys, tile))
    return out


def repair_order(
    lines: DataFrame, keys: Sequence[str] = LINE, long_km: float = LONG_SEGMENT_KM
) -> DataFrame:
    """Each line in its best-scoring order, with the number of the candidate and its score."""
    keys = list(keys)
    lines = stored(lines.select(*keys, F.col("seq").cast("int").alias("seq"), "lat", "lon"), "given")
    short, others = split_lines(lines, keys)
    repaired = _repair_whole(short, keys, long_km)
    return repaired if others is None else repaired.unionByName(_repair_by_tables(others, keys, long_km))


def _repair_whole(lines: DataFrame, keys: list[str], long_km: float) -> DataFrame:
    """``repair_order`` of short lines, many at once in a task."""
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}

    def work(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        lat, lon, seq = (batch.column(c).to_numpy() for c in ("lat", "lon", "seq"))
        for _, sizes, rows in whole.matrices(first, len(batch)):
            y, x = whole.filled(lat[rows], sizes), whole.filled(lon[rows], sizes)
            order, candidate, crossings, longs = whole.best_orders(y, x, sizes, long_km, ORIENTATION_EPS, TOUCH_EPS)
            line, place = np.nonzero(np.arange(rows.shape[1]) < sizes[:, None])
            at = rows[line, order[line, place]]
            number = np.where(candidate[line] == 0, seq[at], place + 1).astype("int32")
            own = [batch.column(k).take(pa.array(at)) for k in keys]
            found = [number, lat[at], lon[at], candidate[line], crossings[line], longs[line].astype("int64")]
            names = [*keys, "seq", "lat", "lon", "candidate", "intersections", "long_segments"]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], names=names)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return map_whole(
        lines, keys, work, f"{schema}, seq int, lat double, lon double, candidate int, intersections bigint, long_segments bigint"
    )


def _repair_by_tables(lines: DataFrame, keys: list[str], long_km: float) -> DataFrame:
    """``repair_order`` of lines of any length: all orders are one table, scored at once."""
    orders = cut_lineage(candidate_orders(cut_lineage(lines), keys))
    scores = order_score(orders, [*keys, "candidate"], long_km)
    fields = ["candidate", "intersections", "long_segments", "max_segment_km", "total_km"]
    listed = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    best = listed.select(
        *keys,
        F.aggregate(
            F.slice("all", 2, 100), F.element_at("all", 1), lambda old, new: F.when(better_score(new, old), new).otherwise(old)
        ).alias("b"),
    ).select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("candidate", "intersections", "long_segments")])
    sizes = (
        orders.where(F.col("candidate") == 0)
        .groupBy(*keys)
        .agg(F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"))
    )
    return attach(orders, best.join(sizes, keys), [*keys, "candidate"]).select(
        *keys, "seq", "lat", "lon", "candidate", "intersections", "long_segments"
    )
