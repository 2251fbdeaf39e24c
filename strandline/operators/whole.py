"""Short lines as rows of matrices: crossings, greedy walks and order scores of many lines at once.

A line of at most ``WHOLE_ROWS`` vertices comes whole to one task (``lines.map_whole``).  Lines of
like length stand in one matrix, shorter ones filled up with NaN, which crosses and precedes nothing.
The formulas are those of the Column expressions that serve longer lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from strandline.functions import geo

# Numbers of a matrix of pairs that a task holds at once.
HELD = 1 << 20


def haversine_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    half_lat, half_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + half_lon * half_lon * np.cos(np.radians(lat1)) * np.cos(np.radians(lat2))
    return 2 * geo.EARTH_RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def matrices(first: np.ndarray, rows: int, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lines, sizes, row index) of groups of lines of like length; filled-up places repeat a line's last row."""
    sizes = np.diff(np.append(first, rows))
    by_size = np.argsort(sizes, kind="stable")
    end = len(by_size)
    while end:
        longest = int(sizes[by_size[end - 1]])
        start = max(0, end - max(1, held // (longest * longest)))
        lines = by_size[start:end]
        yield lines, sizes[lines], first[lines, None] + np.minimum(np.arange(longest), sizes[lines, None] - 1)
        end = start


def filled(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Matrix ``values`` with NaN beyond the size of each line."""
    return np.where(np.arange(values.shape[1]) < sizes[:, None], values, np.nan)


def crossing_pairs(x: np.ndarray, y: np.ndarray, eps: float, touch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first, second) of the crossing segments, numbered from 0, of lines that are rows of ``x`` and ``y``."""
    ax, ay, bx, by = x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]
    n = ax.shape[1]
    slack = 1e-8
    apart = np.zeros((len(x), n, n), dtype=bool)
    for a, b in ((ax, bx), (ay, by)):
        low, high = np.minimum(a, b), np.maximum(a, b) + slack
        apart |= ~(low[:, :, None] <= high[:, None, :])
        apart |= ~(low[:, None, :] <= high[:, :, None])
    line, p, q = np.nonzero(~apart & np.triu(np.ones((n, n), dtype=bool), 2))
    ax_, ay_, bx_, by_ = ax[line, p], ay[line, p], bx[line, p], by[line, p]
    cx, cy, dx, dy = ax[line, q], ay[line, q], bx[line, q], by[line, q]

    def side(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def same(px, py, qx, qy):
        return (np.abs(py - qy) <= touch) & (np.abs(px - qx) <= touch)

    def within(px, py, mx, my, qx, qy):
        return (
            (mx <= np.maximum(px, qx) + touch) & (mx >= np.minimum(px, qx) - touch)
            & (my <= np.maximum(py, qy) + touch) & (my >= np.minimum(py, qy) - touch)
        )

    o1, o2 = side(ax_, ay_, bx_, by_, cx, cy), side(ax_, ay_, bx_, by_, dx, dy)
    o3, o4 = side(cx, cy, dx, dy, ax_, ay_), side(cx, cy, dx, dy, bx_, by_)
    shared = same(ax_, ay_, cx, cy) | same(ax_, ay_, dx, dy) | same(bx_, by_, cx, cy) | same(bx_, by_, dx, dy)
    met = ~shared & (
        ((o1 * o2 < -eps) & (o3 * o4 < -eps))
        | ((np.abs(o1) <= eps) & within(ax_, ay_, cx, cy, bx_, by_))
        | ((np.abs(o2) <= eps) & within(ax_, ay_, dx, dy, bx_, by_))
        | ((np.abs(o3) <= eps) & within(cx, cy, ax_, ay_, dx, dy))
        | ((np.abs(o4) <= eps) & within(cx, cy, bx_, by_, dx, dy))
    )
    return line[met], p[met], q[met]


def nearest_hits(
    x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, allowed: np.ndarray, dx: np.ndarray, dy: np.ndarray, probe: float, limit: float
) -> np.ndarray:
    """Distance from the origin of a ray of every vertex to the nearest segment it hits, ``limit`` if none is within it.

    Lines are rows; segments go from (x, y) to (nx, ny), and ``allowed`` (line, vertex, segment) names those a vertex may hit.
    """
    sx, sy = (nx - x)[:, None, :], (ny - y)[:, None, :]
    dx, dy = dx[:, :, None], dy[:, :, None]
    ex, ey = x[:, None, :] - (x[:, :, None] + dx * probe), y[:, None, :] - (y[:, :, None] + dy * probe)
    den = dx * sy - dy * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (ex * sy - ey * sx) / den, (ex * dy - ey * dx) / den
    hit = allowed & (np.abs(den) >= 1e-9) & (t > 1e-6) & (u >= -1e-6) & (u <= 1 + 1e-6) & (t <= limit)
    return np.where(hit, t, limit).min(axis=2)


def starts_of(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """(line, start) of the first vertex and those of extreme latitude and longitude (V12); -1 for one that stands before."""
    out = np.stack(
        [np.zeros(len(lat), dtype=np.int64)] + [f(v, axis=1) for v in (lat, lon) for f in (np.nanargmin, np.nanargmax)], axis=1
    )
    for k in range(1, out.shape[1]):
        out[(out[:, :k] == out[:, k, None]).any(axis=1), k] = -1
    return out


def greedy_walks(lat: np.ndarray, lon: np.ndarray, sizes: np.ndarray, line: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Nearest-unvisited walks from ``start`` in ``line``; distances equal to a micrometre tie, and the earlier vertex wins.

    Filled-up places come last, in ascending order.
    """
    n = lat.shape[1]
    km = np.round(haversine_km(lat[:, :, None], lon[:, :, None], lat[:, None, :], lon[:, None, :]), 9)
    beyond = np.arange(n) >= sizes[:, None]
    # farther than anything on the globe, yet nearer than what was visited
    km[np.isnan(km)] = 1e9
    gone = np.where(beyond, 1e9, 0.0)[line]
    walk = np.arange(len(line))
    order = np.empty((len(line), n), dtype=np.int64)
    order[:, 0] = start
    gone[walk, start] = np.inf
    for k in range(1, n):
        order[:, k] = np.argmin(km[line, order[:, k - 1]] + gone, axis=1)
        gone[walk, order[:, k]] = np.inf
    return order


def scores(lat: np.ndarray, lon: np.ndarray, long_km: float, eps: float, touch: float) -> tuple[np.ndarray, ...]:
    """Intersections, long segments, longest segment and length of the lines."""
    crossings = np.zeros(len(lat), dtype=np.int64)
    per = max(1, HELD // (lat.shape[1] * lat.shape[1]))
    for low in range(0, len(lat), per):
        line, _, _ = crossing_pairs(lon[low : low + per], lat[low : low + per], eps, touch)
        crossings[low : low + per] = np.bincount(line, minlength=len(crossings[low : low + per]))
    km = np.nan_to_num(haversine_km(lat[:, :-1], lon[:, :-1], lat[:, 1:], lon[:, 1:]), nan=0.0)
    return crossings, (km > long_km).sum(axis=1), km.max(axis=1, initial=0.0), km.sum(axis=1)


def best_orders(lat: np.ndarray, lon: np.ndarray, sizes: np.ndarray, long_km: float, eps: float, touch: float):
    """(order, candidate, intersections, long segments) of the best order of each line (V13); candidate 0 is the given one."""
    starts = starts_of(lat, lon)
    line, position = np.nonzero(starts >= 0)
    number = np.cumsum(starts >= 0, axis=1, dtype=np.int32)
    orders = greedy_walks(lat, lon, sizes, line, starts[line, position])
    order = np.tile(np.arange(lat.shape[1]), (len(lat), 1))
    candidate = np.zeros(len(lat), dtype=np.int32)
    best = scores(lat, lon, long_km, eps, touch)
    walked = scores(lat[line[:, None], orders], lon[line[:, None], orders], long_km, eps, touch)
    for k in range(starts.shape[1]):
        of = np.flatnonzero(position == k)
        at = line[of]
        new, old = [s[of] for s in walked], [s[at] for s in best]
        longest_differs = np.abs(new[2] - old[2]) > 1e-9
        better = np.select(
            [new[0] != old[0], new[1] != old[1], longest_differs], [new[0] < old[0], new[1] < old[1], new[2] < old[2]], new[3] < old[3] - 1e-9
        )
        of, at = of[better], at[better]
        order[at], candidate[at] = orders[of], number[at, k]
        for s, w in zip(best, walked):
            s[at] = w[of]
    return order, candidate, best[0], best[1]
