"""Box-counting dimension on many lines at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import LINE, WHOLE_ROWS, attach, map_whole, spread_out, with_neighbours
from strandline.operators.crossings import split_lines
from strandline.session import stored

# Fixed values of the analysis.
SCALE_FACTORS = [4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256]
OFFSETS = [(0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5)]
MIN_SAMPLES = 4
MIN_LOCAL_SLOPES = 3
MIN_R2 = 0.98
MAX_SPREAD = 0.18
SLOPE_RANGE = (0.5, 3.0)
CONVERGED_VERSIONS = 3
VERSION_DELTA = 0.03
THEORY_DELTA = 0.05
THEORY_DIMENSION = math.log(4) / math.log(3)
FAST_SCALES = [2, 4, 8, 16, 32]


#: Boxes beside the line's own on each side, boxes in a word of a bitmap, boxes and segments that a task works on at once.
MARGIN, WORD, HELD, SEGMENTS = 8, 64, 1_000_000, 4096
#: Numbers of a stretch: shorter lines are counted in one task.
STRETCH = 4096


def _bitmaps(batch: dict[str, np.ndarray], lines: np.ndarray, factor: float, offsets: Sequence[tuple[float, float]]):
    """(first line, offset, boxes met) of the grids of one scale: boxes met by samples at half-box steps along every segment.

    ``lines`` numbers the lines of the segments from 0, in ascending order; the boxes of a line are rows of whole words.
    """
    width = -(-(int(factor) + 2 * MARGIN) // WORD) * WORD
    rows = int(factor) + 2 * MARGIN
    per = max(1, HELD // (width * rows))
    for low in range(0, int(lines[-1]) + 1, per):
        a, b = np.searchsorted(lines, [low, low + per])
        if a == b:
            continue
        dx, dy, box = batch["dx"][a:b], batch["dy"][a:b], batch["size_m"][a:b] / factor
        steps = np.maximum(np.ceil(np.sqrt(dx * dx + dy * dy) / (box / 2)) + 1, 2)
        n = steps.astype(np.int64) + 1
        start = np.cumsum(n) - n

        def each(values: np.ndarray) -> np.ndarray:
            return np.repeat(values, n)

        t = (np.arange(start[-1] + n[-1]) - each(start)) / each(steps)
        size = each(box)
        x = each(batch["ax"][a:b]) + each(dx) * t - each(batch["min_x"][a:b])
        y = each(batch["ay"][a:b]) + each(dy) * t - each(batch["min_y"][a:b])
        first_row = each((lines[a:b] - low) * rows + MARGIN)
        rows_of = {o: (first_row + np.floor((y + o * size) / size).astype(np.int64)) * width + MARGIN for o in {oy for _, oy in offsets}}
        cols_of = {o: np.floor((x + o * size) / size).astype(np.int64) for o in {ox for ox, _ in offsets}}
        held = int(lines[b - 1]) - low + 1
        for k, (ox, oy) in enumerate(offsets):
            met = np.zeros(held * rows * width, dtype=bool)
            met[rows_of[oy] + cols_of[ox]] = True
            yield low, k, met.reshape(held, rows, width)


def box_coverage(lines: DataFrame, keys: Sequence[str] = LINE, offsets: int = len(OFFSETS), stretch: int = STRETCH) -> DataFrame:
    """Distinct boxes met per line, scale and grid offset, summed over offsets (F1, F2).

    Every segment is sampled at half-box steps.  The boxes of a grid are a bitmap.  Lines of at most ``WHOLE_ROWS``
    vertices (and ``stretch`` numbers) come whole to one task in one shuffle, which finds their segments and counts
    their boxes; see ``_boxes_of_parts`` for longer ones.
    """
    keys = list(keys)
    short, others = split_lines(lines, keys, min(WHOLE_ROWS, stretch))
    counted = _boxes_of_whole(short, keys, OFFSETS[:offsets])
    return counted if others is None else counted.unionByName(_boxes_of_parts(others, keys, OFFSETS[:offsets], stretch))


def _flat(lines: DataFrame, keys: list[str]) -> DataFrame:
    x, y = geo.regional_xy(F.col("lat"), F.col("lon"))
    return lines.select(*keys, "seq", x.alias("x"), y.alias("y"))


def _boxes_of_whole(lines: DataFrame, keys: list[str], used: Sequence[tuple[float, float]]) -> DataFrame:
    """Boxes of short lines, one row per scale."""
    flat = _flat(lines, keys)
    types = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", scale_factor int, size_m double, boxes bigint"

    def work(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        min_x, min_y = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
        size = np.maximum(np.maximum.reduceat(x, first) - min_x, np.maximum.reduceat(y, first) - min_y)
        used_lines = np.flatnonzero(size >= 1)
        if not len(used_lines):
            return
        line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        end = np.ones(len(x), dtype=bool)
        end[first] = False
        end = np.flatnonzero(end & (size[line] >= 1))
        of = line[end]
        values = {
            "size_m": size[of], "min_x": min_x[of], "min_y": min_y[of], "ax": x[end - 1], "ay": y[end - 1],
            "dx": x[end] - x[end - 1], "dy": y[end] - y[end - 1],
        }
        of = np.searchsorted(used_lines, of)
        own = [batch.column(k).take(pa.array(first[used_lines])) for k in keys]
        for factor in SCALE_FACTORS:
            boxes = np.zeros(len(used_lines), dtype=np.int64)
            for low, _, met in _bitmaps(values, of, float(factor), used):
                boxes[low : low + len(met)] += np.bitwise_count(met.view("<u8")).reshape(len(met), -1).sum(axis=1, dtype=np.int64)
            scale = pa.array(np.full(len(boxes), factor, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*own, scale, pa.array(size[used_lines]), pa.array(boxes)], names=[*keys, "scale_factor", "size_m", "boxes"]
            )

    return map_whole(flat, keys, work, schema, held_rows=SEGMENTS)


def _boxes_of_parts(lines: DataFrame, keys: list[str], used: Sequence[tuple[float, float]], stretch: int) -> DataFrame:
    """Boxes of other lines: those of at most ``stretch`` numbers come whole to one task, which counts them.

    Longer lines come by stretches, and the tasks give words of 64 boxes that are not
    empty; ``bit_or`` combines those of all tasks before they are counted.
    A task holds the bitmaps of as many lines as a bounded number of boxes allows.
    """
    flat = _flat(lines, keys)
    box = flat.groupBy(*keys).agg(
        F.min("seq").alias("lo_seq"),
        F.max("seq").alias("hi_seq"),
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("size_m"),
    ).where(F.col("size_m") >= 1)
    nb = with_neighbours(flat, ["x", "y"], keys).where(F.col("prev").isNotNull())
    whole = F.col("hi_seq") - F.col("lo_seq") < stretch
    segs = attach(nb, box, keys).select(
        *keys, F.when(whole, F.lit(-1)).otherwise(F.floor(F.col("seq") / stretch)).alias("_stretch"), "size_m", "min_x", "min_y",
        F.col("prev.x").alias("ax"), F.col("prev.y").alias("ay"),
        (F.col("x") - F.col("prev.x")).alias("dx"), (F.col("y") - F.col("prev.y")).alias("dy"),
    )
    group = [*keys, "_stretch"]
    segs = spread_out(segs, group).sortWithinPartitions(*group)
    numbers = ["size_m", "min_x", "min_y", "ax", "ay", "dx", "dy"]
    types = {f.name: f.dataType.simpleString() for f in flat.schema.fields}

    def marked(batch: pa.RecordBatch, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts and words of whole stretches: the number of the stretch of every segment is ``of``."""
        first = np.flatnonzero(np.diff(of, prepend=-1))
        counted = batch.column("_stretch").to_numpy()[first] < 0
        values = {c: batch.column(c).to_numpy() for c in numbers}

        def rows(of: np.ndarray, place: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            own = [batch.column(k).take(pa.array(first[of])) for k in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array(place), pa.array(bits)], names=[*keys, "word", "bits"])

        for n, factor in enumerate(SCALE_FACTORS):
            boxes = np.zeros(len(first), dtype=np.int64)
            for low, k, met in _bitmaps(values, of, float(factor), used):
                few = counted[low : low + len(met)]
                boxes[low : low + len(met)] += np.bitwise_count(met.view("<u8")).reshape(len(met), -1).sum(axis=1, dtype=np.int64)
                if not few.all():
                    at = np.flatnonzero(~few)
                    words = np.packbits(met[at], axis=2, bitorder="little").view("<i8")
                    line, row, word = np.nonzero(words)
                    yield rows(at[line] + low, ((4 * n + k) * 1024 + row) * 16 + word, words[line, row, word])
            here = np.flatnonzero(counted)
            if len(here):
                yield rows(here, np.full(len(here), -1 - n, dtype=np.int64), boxes[here])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(len(h) for h in held) < SEGMENTS:
                continue
            held, parts = split(held, False)
            for part in parts:
                yield from marked(*part)
        if held:
            for part in split(held, True)[1]:
                yield from marked(*part)

    def split(held: list[pa.RecordBatch], end: bool) -> tuple[list[pa.RecordBatch], list[tuple[pa.RecordBatch, np.ndarray]]]:
        """What is kept of the last stretch, which may go on, and the batches of whole stretches."""
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(len(batch), dtype=bool)
        new[:1] = True
        for c in group:
            column = batch.column(c)
            same = pc.equal(column.slice(1), column.slice(0, len(batch) - 1))
            new[1:] |= ~same.fill_null(False).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        upto = len(batch) if end else int(first[-1])
        ends = [*first[first < upto], upto]
        parts, start = [], 0
        for low, high in zip(ends[:-1], ends[1:]):
            if high - start >= SEGMENTS or high == upto:
                parts.append((batch.slice(start, high - start), np.cumsum(new[start:high]) - 1))
                start = high
        return [batch.slice(upto)] if upto < len(batch) else [], parts

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", word bigint, bits bigint"
    words = segs.mapInArrow(mark, schema)
    words = words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    # rows of counts carry -1 minus the number of the scale; words stand in four grids of 1024 rows of 16 words
    count_row = F.col("word") < 0
    scale = F.when(count_row, -1 - F.col("word")).otherwise(F.call_function("shiftright", F.col("word"), F.lit(16))).alias("n")
    boxes = F.when(count_row, F.col("bits")).otherwise(F.bit_count("bits").cast("bigint"))
    counted = words.groupBy(*keys, scale).agg(F.sum(boxes).alias("boxes"))
    factors = F.array(*[F.lit(f) for f in SCALE_FACTORS])
    return counted.join(box.select(*keys, "size_m"), keys).select(
        *keys, F.get(factors, F.col("n").cast("int")).alias("scale_factor"), "size_m", "boxes"
    )


def scale_series(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """One usable sample per line and scale with its logarithms."""
    mean = F.col("boxes") / len(OFFSETS)
    return (
        box_coverage(lines, keys)
        .withColumn("mean_boxes", mean)
        .where(F.col("mean_boxes") > 1)
        .withColumn("box_size_m", F.col("size_m") / F.col("scale_factor"))
        .withColumn("relative_scale", F.col("box_size_m") / F.col("size_m"))
        .withColumn("boxes_covered", F.floor(F.col("mean_boxes") + 0.5))
        .withColumn("log_inv_scale", F.log(1.0 / F.col("relative_scale")))
        .withColumn("log_boxes", F.log("mean_boxes"))
        .drop("boxes", "size_m")
    )


def regression(samples: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares with the degenerate guards (F4, F5), combined before the shuffle."""
    keys = list(keys)
    agg = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.regr_slope(y, x).alias("s"),
        F.regr_intercept(y, x).alias("i"),
        F.regr_r2(y, x).alias("r"),
    )
    return agg.select(
        *keys,
        "samples",
        F.coalesce("s", F.lit(0.0)).alias("slope"),
        F.coalesce("i", F.lit(0.0)).alias("intercept"),
        F.coalesce("r", F.lit(1.0)).alias("r_squared"),
    )


def series_arrays(series: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """The at most 13 samples of a line as arrays, ordered by scale."""
    point = F.struct("scale_factor", "log_inv_scale", "log_boxes")
    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return packed.select(
        *keys,
        F.transform("p", lambda s: s["log_inv_scale"]).alias("x"),
        F.transform("p", lambda s: s["log_boxes"]).alias("y"),
        F.size("p").alias("samples"),
    )


def _local_slopes(x: Column, y: Column) -> Column:
    """Slopes between successive samples; coinciding abscissae are left out."""
    steps = F.zip_with(
        F.arrays_zip(F.slice(x, F.lit(2), F.size(x)).alias("v"), F.slice(y, F.lit(2), F.size(y)).alias("w")),
        F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("v"), F.slice(y, F.lit(1), F.size(y) - 1).alias("w")),
        lambda a, b: F.when(F.abs(a["v"] - b["v"]) >= 1e-12, (a["w"] - b["w"]) / (a["v"] - b["v"])),
    )
    return F.array_compact(steps)


def _spread(values: Column) -> Column:
    return F.coalesce(F.array_max(values) - F.array_min(values), F.lit(0.0))


def local_slopes(series: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Local slopes of the whole series and their spread."""
    a = series_arrays(series, keys).where(F.col("samples") >= 2)
    s = a.withColumn("slopes", _local_slopes(F.col("x"), F.col("y"))).withColumn("spread", _spread(F.col("slopes")))
    return s.select(*keys, "spread", F.posexplode("slopes").alias("position", "local_slope"))


def best_window(series: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Best contiguous regression window per line."""
    return _best_of(series_arrays(series, keys), keys)


def _best_of(a: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best window of the arrays of ``series_arrays``, on many lines at once."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", samples int, first_sample int, last_sample int, slope double, intercept double, r_squared double, spread double, stable boolean"
    )
    names = ["first_sample", "last_sample", "slope", "intercept", "r_squared", "spread", "stable"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = batch.column("samples").to_numpy()
            filled = np.arange(n.max()) < n[:, None]
            x, y = np.zeros(filled.shape), np.zeros(filled.shape)
            x[filled], y[filled] = (batch.column(c).flatten().to_numpy() for c in ("x", "y"))
            best = best_windows(x, y, n)
            own = [batch.column(c) for c in [*keys, "samples"]]
            found = [pa.array(best[c].astype(np.int32) if c.endswith("_sample") else best[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *found], names=[*keys, "samples", *names])

    # spread by number: arrays of many lines are small, and all their windows would be folded in one task
    usable = spread_out(a.where(F.col("samples") >= MIN_SAMPLES), keys)
    return usable.select(*keys, "samples", "x", "y").mapInArrow(fold, schema)


def best_windows(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Best window of every row of ``x`` and ``y``, whose first ``n`` numbers (at least ``MIN_SAMPLES``) are samples.

    At most 55 windows of a line's 13 samples, one after the other: the preference is
    not transitive because of its slacks, hence an ordered fold.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.diff(x, axis=1)
        local = np.diff(y, axis=1) / step
    known = np.abs(step) >= 1e-12
    highest, lowest = np.where(known, local, -np.inf), np.where(known, local, np.inf)
    best: dict[str, np.ndarray] = {}
    for a in range(x.shape[1] - MIN_SAMPLES + 1):
        for b in range(a + MIN_SAMPLES - 1, x.shape[1]):
            at = np.flatnonzero(n > b)
            m, xs, ys = b - a + 1, x[at, a : b + 1].T, y[at, a : b + 1].T
            sx, sy, sxy, sxx, res, tot = np.zeros((6, len(at)))
            for p, q in zip(xs, ys):
                sx, sy, sxy, sxx = sx + p, sy + q, sxy + p * q, sxx + p * p
            d = m * sxx - sx * sx
            flat = np.abs(d) < 1e-12
            slope = np.where(flat, 0.0, (m * sxy - sx * sy) / np.where(flat, 1.0, d))
            mean_y, intercept = sy / m, (sy - slope * sx) / m
            for p, q in zip(xs, ys):
                off, dev = q - (slope * p + intercept), q - mean_y
                res, tot = res + off * off, tot + dev * dev
            r2 = np.where(tot < 1e-12, 1.0, 1.0 - res / np.where(tot < 1e-12, 1.0, tot))
            spread = np.where(known[at, a:b].any(axis=1), highest[at, a:b].max(axis=1) - lowest[at, a:b].min(axis=1), 0.0)
            new = {
                "first_sample": np.full(len(at), a), "last_sample": np.full(len(at), b), "n": np.full(len(at), m), "slope": slope,
                "intercept": intercept, "r_squared": r2, "spread": spread, "stable": (r2 >= MIN_R2) & (spread <= MAX_SPREAD),
            }
            if not best:  # the first window, which every line has
                best = new
                continue
            old = {c: v[at] for c, v in best.items()}
            dr = np.abs(r2 - old["r_squared"])
            better = np.select(
                [new["stable"] != old["stable"], m != old["n"], dr > 1e-9, (dr <= 1e-3) & (np.abs(slope - old["slope"]) > 1e-6)],
                [new["stable"], m > old["n"], r2 > old["r_squared"], slope > old["slope"]],
                spread < old["spread"],
            )
            for c, v in new.items():
                best[c][at[better]] = v[better]
    return best


def dimension(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Dimension verdict per line (F8); the scalar form is 1 when invalid."""
    keys = list(keys)
    series = stored(series_arrays(scale_series(lines, keys), keys), "series")  # the boxes are counted once
    best = _best_of(series, keys)
    counts = series.select(*keys, F.col("samples").cast("bigint").alias("sample_count"))
    every = lines.select(*keys).distinct()
    valid = F.coalesce(F.col("slope").between(*SLOPE_RANGE), F.lit(False))
    return (
        every.join(counts, keys, "left")
        .join(best, keys, "left")
        .select(
            *keys,
            F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
            valid.alias("valid"),
            F.when(valid, F.col("slope")).otherwise(F.lit(0.0)).alias("dimension"),
            F.when(valid, F.col("slope")).otherwise(F.lit(1.0)).alias("scalar_dimension"),
            F.coalesce("r_squared", F.lit(0.0)).alias("r_squared"),
            F.coalesce("spread", F.lit(0.0)).alias("spread"),
            (valid & F.coalesce("stable", F.lit(False))).alias("stable"),
        )
    )


def convergence(
    dimensions: DataFrame, keys: Sequence[str] = LINE, version: str = "step", theory: float = THEORY_DIMENSION
) -> tuple[DataFrame, DataFrame]:
    """Deltas between versions, and the verdict on the last three valid ones."""
    keys = list(keys)
    dimensions = stored(dimensions, "dimensions")
    w = Window.partitionBy(*keys).orderBy(version)
    change = F.when(
        F.col("valid") & F.lag("valid").over(w), F.col("dimension") - F.lag("dimension").over(w)
    )
    deltas = dimensions.withColumn("delta", change)
    ranked = dimensions.where("valid").withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc()))
    )
    tail = ranked.where(F.col("_r") <= CONVERGED_VERSIONS)
    packed = tail.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct(version, "dimension"))).alias("d"),
        F.bool_and("stable").alias("all_stable"),
        F.max_by("dimension", version).alias("final_dimension"),
    )
    jumps = F.zip_with(
        F.slice("d", 2, CONVERGED_VERSIONS), F.slice("d", 1, CONVERGED_VERSIONS - 1),
        lambda p, q: F.abs(p["dimension"] - q["dimension"]),
    )
    enough = F.col("n") >= CONVERGED_VERSIONS
    verdict = dimensions.select(*keys).distinct().join(
        packed.select(
            *keys,
            (enough & F.forall(jumps, lambda j: j <= VERSION_DELTA)).alias("converged"),
            (enough & F.col("all_stable")).alias("stable"),
            "final_dimension",
            (enough & (F.abs(F.col("final_dimension") - theory) <= THEORY_DELTA)).alias("near_theory"),
        ),
        keys,
        "left",
    )
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("converged", "stable", "near_theory")}
    return deltas, verdict.withColumns(flags).withColumn(
        "valid", F.col("converged") & F.col("stable") & F.col("near_theory")
    )


def fast_dimension(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Vertex-occupancy estimate (F10): raw regression slope, and its clamped negation."""
    keys = list(keys)
    box = lines.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"),
        (F.max("lat") - F.min("lat")).alias("lat_range"), (F.max("lon") - F.min("lon")).alias("lon_range"),
    )
    usable = box.where((F.col("points") >= 4) & (F.col("lat_range") > 0) & (F.col("lon_range") > 0))
    placed = attach(lines.select(*keys, "seq", "lat", "lon"), usable, keys).withColumn(
        "scale", F.explode(F.array(*[F.lit(s) for s in FAST_SCALES]))
    )
    cells = placed.select(
        *keys,
        "scale",
        F.floor((F.col("lat") - F.col("min_lat")) / (F.col("lat_range") / F.col("scale"))).alias("ci"),
        F.floor((F.col("lon") - F.col("min_lon")) / (F.col("lon_range") / F.col("scale"))).alias("cj"),
    ).distinct()
    counted = cells.groupBy(*keys, "scale").agg(F.count("*").alias("n"))
    fit = counted.groupBy(*keys).agg(F.regr_slope(F.log("n"), F.log("scale")).alias("raw_slope"))
    return box.select(*keys, "points").join(fit, keys, "left").select(
        *keys,
        "points",
        "raw_slope",
        F.coalesce(geo.clamp(-F.col("raw_slope"), 1.0, 2.0), F.lit(1.0)).alias("fast_dimension"),
    )
