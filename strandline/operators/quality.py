"""Data-quality rules and line repair."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import LINE, attach, renumber, running, lookup_join, with_neighbours
from strandline.operators.crossings import crossing_counts
from strandline.operators.geometry import line_summary, segments

# Thresholds, reference ranges, message formats, place names.
LONG_SEGMENT_KM = 450.0
LANDMARK_REACH_DEG = 0.15
NO_LANDMARK = "—"
LENGTH_TOLERANCE = 0.40
LENGTH_REFERENCE = [("black-sea.json", 4000.0, 4987.0)]
MSG_REMOVED = "удалены повторяющиеся координаты: %d"
MSG_REORDERED = "точки автоматически переупорядочены по обходу контура"
MSG_LANDMARK = 'обнаружен повторяющийся ориентир "%s": %d точек'
MSG_SEGMENT = "сегмент %d-%d имеет длину %.0f км, это больше порога %.0f км"
ALERT_COUNT = "Длинные сегменты > %.0f км: %d"
ALERT_SEGMENT = "сегмент %d-%d: %.0f км"
ALERT_FIXES = "Автоисправления: %d"
WARN_STEP_LOW = "YearsPerStep %.2f < minimum %.2f"
WARN_STEP_HIGH = "YearsPerStep %.2f > maximum %.2f"
WARN_STORMS = "High storm probability %.2f (unrealistic for most climates)"
WARN_SEA = "High sea level rise %.4f m/year (exceeds IPCC RCP8.5)"
LANDMARKS = [
    (46.48, 30.73, "Одесса, Украина"),
    (45.33, 32.49, "Евпатория, Крым"),
    (44.94, 34.10, "Алушта, Крым"),
    (44.62, 33.53, "Севастополь, Крым"),
    (44.55, 38.10, "Геленджик, Россия"),
    (43.70, 39.75, "Сочи, Россия"),
    (43.58, 39.72, "Адлер, Россия"),
    (42.00, 41.58, "Сухум, Абхазия"),
    (42.15, 41.65, "Поти, Грузия"),
    (41.65, 41.63, "Батуми, Грузия"),
    (41.55, 41.57, "Чорох (граница)"),
    (41.02, 40.27, "Трабзон, Турция"),
    (41.00, 39.65, "Орду, Турция"),
    (41.28, 31.42, "Синоп, Турция"),
    (43.00, 28.00, "Варна, Болгария"),
]


def default_landmarks(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *row) for i, row in enumerate(LANDMARKS)]
    return spark.createDataFrame(rows, "ord BIGINT, lat DOUBLE, lon DOUBLE, name STRING")


def length_reference(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LENGTH_REFERENCE, "dataset STRING, min_km DOUBLE, max_km DOUBLE")


def _finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) != float("inf"))


# -- row rules ---------------------------------------------------------------


def coordinate_violations(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """First vertex of each line outside the coordinate range (V1)."""
    bad_lat = ~F.col("lat").between(-90.0, 90.0)
    bad_lon = ~F.col("lon").between(-180.0, 180.0)
    flagged = lines.where(bad_lat | bad_lon).withColumn(
        "rule", F.when(bad_lat, F.lit("latitude")).otherwise(F.lit("longitude"))
    ).withColumn("value", F.when(bad_lat, F.col("lat")).otherwise(F.col("lon")))
    return flagged.groupBy(*keys).agg(F.min_by(F.struct("seq", "rule", "value"), "seq").alias("v")).select(*keys, "v.*")


def bathymetry_violations(points: DataFrame) -> DataFrame:
    """Depth samples breaking a rule (V2)."""
    margin = 0.1
    lat_bad = ~F.col("lat").between(40.0 - margin, 47.0 + margin)
    lon_bad = ~F.col("lon").between(27.0 - margin, 42.5 + margin)
    rule = (
        F.when(~_finite(F.col("lat")), "latitude not finite")
        .when(~_finite(F.col("lon")), "longitude not finite")
        .when(~_finite(F.col("depth")), "depth not finite")
        .when(lat_bad, "latitude out of range")
        .when(lon_bad, "longitude out of range")
        .when(F.col("depth") > 0, "positive depth")
        .when(F.col("depth") < -3000.0, "too deep")
    )
    return points.withColumn("rule", rule).where(F.col("rule").isNotNull())


def lithology_violations(meta: DataFrame, points: DataFrame, classes: DataFrame) -> DataFrame:
    """Profile rules over metadata, points and classes (V3), one row per finding."""

    def blank(col: Column) -> Column:
        return F.coalesce(F.length(col) == 0, F.lit(True))

    m = meta.select(
        F.lit("metadata").alias("part"),
        F.coalesce(F.col("name"), F.lit("")).alias("item"),
        F.when(blank(F.col("name")), "missing name")
        .when(F.col("min_lat") >= F.col("max_lat"), "latitude bounds")
        .when(F.col("min_lon") >= F.col("max_lon"), "longitude bounds")
        .alias("rule"),
    )
    p = points.select(
        F.lit("point").alias("part"),
        F.col("ord").cast("string").alias("item"),
        F.when(~F.col("lat").between(-90.0, 90.0), "latitude")
        .when(~F.col("lon").between(-180.0, 180.0), "longitude")
        .when((F.col("resistance") <= 0) | (F.col("resistance") > 20), "resistance")
        .when(blank(F.col("lithology_class")), "missing class")
        .alias("rule"),
    )
    c = classes.select(
        F.lit("class").alias("part"),
        F.col("class").alias("item"),
        F.when(F.col("resistance") <= 0, "resistance").when(blank(F.col("color")), "missing color").alias("rule"),
    )
    return m.unionByName(p).unionByName(c).where(F.col("rule").isNotNull())


def grid_verdict(grid: DataFrame, resolution: Column) -> DataFrame:
    """Grid rule (V4): some cells, and a resolution in (0, 0.1]."""
    return grid.agg(F.count("*").alias("cells")).select(
        "cells",
        resolution.alias("resolution"),
        F.when(F.col("cells") == 0, "no points")
        .when(resolution <= 0, "invalid resolution")
        .when(resolution > 0.1, "too coarse")
        .otherwise("ok")
        .alias("verdict"),
    )


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive box test (V5); ``box`` is (min_lat, max_lat, min_lon, max_lon)."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def clip_runs(lines: DataFrame, box: tuple[float, float, float, float], keys: Sequence[str] = LINE) -> DataFrame:
    """Maximal runs of at least two consecutive vertices inside the box (V6).

    A vertex belongs to such a run exactly when it and a neighbour are inside,
    so only the run number needs a running sum.  An all-zero box clips nothing.
    """
    if not any(box):
        return lines.withColumn("run_id", F.lit(1).cast("bigint"))
    flagged = lines.withColumn("_in", in_box(F.col("lat"), F.col("lon"), box))
    nb = with_neighbours(flagged, ["_in"], keys)
    before = F.coalesce(F.col("prev._in"), F.lit(False))
    after = F.coalesce(F.col("next._in"), F.lit(False))
    kept = nb.where(F.col("_in") & (before | after)).withColumn("_start", (~before).cast("int"))
    return running(kept, {"run_id": F.col("_start")}, keys).drop("_in", "_start", "prev", "next")


def longest_sequence(
    sequences: DataFrame, document: Sequence[str], sequence: str, prefer_later: bool = False
) -> DataFrame:
    """Longest sequence of each document by length, then vertices, then position (V7)."""
    summary = line_summary(sequences, [*document, sequence])
    rank = F.struct("length_km", "points", -F.col(sequence).alias("pos"))
    return summary.groupBy(*document).agg(
        F.max_by(F.struct(sequence, "points", "length_km"), rank).alias("b")
    ).select(*document, "b.*")


def ring_flags(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Both flavours of ring detection per line (V8)."""
    p = F.struct("lat", "lon")
    ends = lines.groupBy(*keys).agg(
        F.count("*").alias("points"), F.min_by(p, F.col("seq")).alias("a"), F.max_by(p, F.col("seq")).alias("b"),
        F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"),
    )
    many = F.col("points") >= 2
    return ends.select(
        *keys,
        "points",
        "lo_seq",
        "hi_seq",
        (
            many
            & (geo.ring_key(F.col("a.lat")) == geo.ring_key(F.col("b.lat")))
            & (geo.ring_key(F.col("a.lon")) == geo.ring_key(F.col("b.lon")))
        ).alias("closed_6dp"),
        (many & (F.col("a") == F.col("b"))).alias("closed_exact"),
    )


def drop_duplicate_vertices(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """First vertex per coordinate at six decimals (V10); a combining aggregate, so
    a coordinate repeated very often costs one row per map task."""
    others = [c for c in lines.columns if c not in keys]
    return (
        lines.groupBy(*keys, geo.ring_key(F.col("lat")).alias("_a"), geo.ring_key(F.col("lon")).alias("_o"))
        .agg(F.min_by(F.struct(*others), F.col("seq")).alias("v"))
        .select(*keys, "v.*")
    )


def duplicate_counts(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    per_key = lines.groupBy(*keys, geo.ring_key(F.col("lat")).alias("_a"), geo.ring_key(F.col("lon")).alias("_o")).count()
    return per_key.groupBy(*keys).agg(
        F.count("*").alias("kept"), (F.sum("count") - F.count("*")).alias("removed")
    )


def open_rings(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Drop the closing vertex of closed lines and carry the flag ``closed_6dp``."""
    flags = ring_flags(lines, keys)
    return attach(lines, flags, keys).where(~(F.col("closed_6dp") & (F.col("seq") == F.col("hi_seq")))).drop(
        "points", "lo_seq", "hi_seq", "closed_exact"
    )


def close_again(lines: DataFrame, keys: Sequence[str] = LINE, flag: str = "closed_6dp") -> DataFrame:
    """Append the first vertex to lines carrying the flag."""
    others = [c for c in lines.columns if c not in keys and c != "seq"]
    tail = (
        lines.where(F.col(flag))
        .groupBy(*keys)
        .agg((F.max("seq") + 1).alias("seq"), F.min_by(F.struct(*others), F.col("seq")).alias("f"))
        .select(*keys, "seq", "f.*")
    )
    return lines.unionByName(tail)


def normalise_rings(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Open, remove repeated vertices, number afresh, close again (V9)."""
    clean = renumber(drop_duplicate_vertices(open_rings(lines, keys), keys), keys)
    return close_again(clean, keys)


# -- order score -------------------------------------------------------------


def order_score(
    lines: DataFrame, keys: Sequence[str] = LINE, long_km: float = LONG_SEGMENT_KM
) -> DataFrame:
    """Intersections, long segments, longest segment and length of each line."""
    keys = list(keys)
    lengths = segments(lines, keys).groupBy(*keys).agg(
        F.count_if(F.col("km") > long_km).alias("long_segments"),
        F.max("km").alias("max_segment_km"),
        F.sum("km").alias("total_km"),
    )
    crossing = crossing_counts(lines, keys)
    return (
        lines.select(*keys).distinct()
        .join(lengths, keys, "left")
        .join(crossing, keys, "left")
        .select(
            *keys,
            F.coalesce("intersections", F.lit(0)).alias("intersections"),
            F.coalesce("long_segments", F.lit(0)).alias("long_segments"),
            F.coalesce("max_segment_km", F.lit(0.0)).alias("max_segment_km"),
            F.coalesce("total_km", F.lit(0.0)).alias("total_km"),
        )
    )


def better_score(new: Column, old: Column) -> Column:
    """Whether score ``new`` beats ``old``; the third part is compared with slack."""
    longest_differs = F.abs(new["max_segment_km"] - old["max_segment_km"]) > 1e-9
    return (
        F.when(new["intersections"] != old["intersections"], new["intersections"] < old["intersections"])
        .when(new["long_segments"] != old["long_segments"], new["long_segments"] < old["long_segments"])
        .when(longest_differs, new["max_segment_km"] < old["max_segment_km"])
        .otherwise(new["total_km"] < old["total_km"] - 1e-9)
    )


def candidate_starts(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """First vertex and the vertices of extreme latitude and longitude."""
    seq = F.col("seq")
    low = lambda c: F.min_by("seq", F.struct(F.col(c), seq))
    high = lambda c: F.max_by("seq", F.struct(F.col(c), -seq))
    picks = F.array_distinct(F.array(F.min("seq"), low("lat"), high("lat"), low("lon"), high("lon")))
    return lines.groupBy(*keys).agg(picks.alias("p")).select(
        *keys, F.posexplode("p").alias("position", "start_seq")
    )


# -- findings ----------------------------------------------------------------


def long_segments(lines: DataFrame, keys: Sequence[str] = LINE, long_km: float = LONG_SEGMENT_KM) -> DataFrame:
    """Segments above the threshold with their end vertices."""
    return segments(lines, keys).where(F.col("km") > long_km).select(
        *keys,
        F.col("start_seq").alias("start_index"),
        F.col("seq").alias("end_index"),
        F.col("plat").alias("start_lat"),
        F.col("plon").alias("start_lon"),
        F.col("lat").alias("end_lat"),
        F.col("lon").alias("end_lon"),
        F.col("km").alias("length_km"),
    )


def nearest_landmark(
    lines: DataFrame, landmarks: DataFrame, keys: Sequence[str] = LINE, reach: float = LANDMARK_REACH_DEG
) -> DataFrame:
    """Nearest landmark within the strict box around each vertex.

    Only the first landmark of a position can win, so positions are made unique
    first; then vertices meet the landmarks of their own and adjacent cells.
    """
    keys = list(keys)
    unique = landmarks.groupBy("lat", "lon").agg(F.min_by(F.struct("ord", "name"), "ord").alias("m")).select(
        F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), F.col("m.ord").alias("l_ord"), F.col("m.name").alias("l_name")
    )
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = (
        unique.withColumn("_di", F.explode(around))
        .withColumn("_dj", F.explode(around))
        .withColumn("ci", F.floor(F.col("l_lat") / reach) + F.col("_di"))
        .withColumn("cj", F.floor(F.col("l_lon") / reach) + F.col("_dj"))
        .drop("_di", "_dj")
    )
    cells = lines.withColumns({"ci": F.floor(F.col("lat") / reach), "cj": F.floor(F.col("lon") / reach)})
    met = lookup_join(cells, spread, ["ci", "cj"], "left")
    dy, dx = F.col("lat") - F.col("l_lat"), F.col("lon") - F.col("l_lon")
    inside = (F.abs(dy) < reach) & (F.abs(dx) < reach)
    best = F.when(inside, F.struct(geo.length2d(dx, dy).alias("d"), F.col("l_ord").alias("o"), F.col("l_name").alias("n")))
    return met.groupBy(*keys, "seq").agg(F.min(best).alias("b")).select(
        *keys, "seq", F.coalesce("b.n", F.lit(NO_LANDMARK)).alias("landmark")
    )


def repeated_landmarks(
    lines: DataFrame, landmarks: DataFrame, keys: Sequence[str] = LINE, max_points: int | None = None
) -> DataFrame:
    """Landmarks named by more than one vertex (V17); ``max_points`` leaves longer lines out."""
    keys = list(keys)
    if max_points is not None:
        sizes = lines.groupBy(*keys).agg(
            F.count("*").alias("points"), F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq")
        )
        lines = attach(lines, sizes.where(F.col("points") <= max_points), keys).select(*keys, "seq", "lat", "lon")
    named = nearest_landmark(lines, landmarks, keys).where(F.col("landmark") != NO_LANDMARK)
    return named.groupBy(*keys, "landmark").agg(F.count("*").alias("vertices")).where(F.col("vertices") > 1)


def issue_summary(
    lines: DataFrame, landmarks: DataFrame, keys: Sequence[str] = LINE, long_km: float = LONG_SEGMENT_KM
) -> DataFrame:
    """Exactly two issue rows per line."""
    keys = list(keys)
    return count_issues(
        lines.select(*keys).distinct(), long_segments(lines, keys, long_km), repeated_landmarks(lines, landmarks, keys), keys, long_km
    )


def count_issues(
    all_lines: DataFrame, longs: DataFrame, repeated: DataFrame, keys: Sequence[str] = LINE, long_km: float = LONG_SEGMENT_KM
) -> DataFrame:
    """The two issue rows of each line from the findings of ``long_segments`` and ``repeated_landmarks``."""
    keys = list(keys)
    longs = longs.groupBy(*keys).agg(F.count("*").alias("n"))
    reps = repeated.groupBy(*keys).agg(F.count("*").alias("n"))

    def issue(counts: DataFrame, kind: str, threshold: float) -> DataFrame:
        return all_lines.join(counts, keys, "left").select(
            *keys,
            F.lit(kind).alias("warning_type"),
            F.coalesce("n", F.lit(0)).alias("issues"),
            F.lit(threshold).alias("threshold_km"),
        )

    return issue(longs, "long_segment", long_km).unionByName(issue(reps, "duplicate_location", 0.0))


def verdicts(
    raw: DataFrame,
    ordered: DataFrame,
    landmarks: DataFrame,
    keys: Sequence[str] = LINE,
    long_km: float = LONG_SEGMENT_KM,
) -> DataFrame:
    """Validation verdict per line.

    ``ordered`` is the repaired line (``seq``, ``lat``, ``lon``, ``candidate``),
    where candidate 0 means that the order was left alone.  Its score (``intersections``,
    ``long_segments``) is taken from there if the repair left it on the rows.
    """
    keys = list(keys)
    dup = duplicate_counts(raw, keys)
    scored = [c for c in ("intersections", "long_segments") if c in ordered.columns]
    moved = ordered.groupBy(*keys).agg((F.max("candidate") > 0).alias("reordered"), *[F.max(c).alias(c) for c in scored])
    parts = [moved]
    if "intersections" not in scored:
        parts.append(crossing_counts(ordered, keys))
    if "long_segments" not in scored:
        parts.append(long_segments(ordered, keys, long_km).groupBy(*keys).agg(F.count("*").alias("long_segments")))
    reps = repeated_landmarks(ordered, landmarks, keys).groupBy(*keys).agg(F.count("*").alias("repeated_landmarks"))
    joined = dup
    for part in (*parts, reps):
        joined = joined.join(part, keys, "left")
    zero = [
        F.coalesce(c, F.lit(0)).alias(c) for c in ("intersections", "long_segments", "repeated_landmarks")
    ]
    facts = joined.select(*keys, "kept", "removed", F.coalesce("reordered", F.lit(False)).alias("reordered"), *zero)
    fatal = (
        F.when(F.col("kept") < 2, "fewer than 2 points").when(F.col("intersections") > 0, "self-intersection")
    )
    fixes = F.array_compact(
        F.array(
            F.when(F.col("removed") > 0, F.format_string(MSG_REMOVED, F.col("removed"))),
            F.when(F.col("reordered"), F.lit(MSG_REORDERED)),
        )
    )
    return facts.withColumn("fatal", fatal).withColumn("fixes", fixes).withColumn(
        "warnings", F.when(fatal.isNotNull(), F.lit(0)).otherwise(F.col("long_segments") + F.col("repeated_landmarks"))
    )


def length_plausibility(lengths: DataFrame, reference: DataFrame) -> DataFrame:
    """Length against the reference range of its dataset.

    ``lengths`` carries ``dataset`` and ``length_km``; unknown datasets stay
    unchecked.  The dimension is small by nature, and joins by its key.
    """
    joined = lookup_join(lengths, reference, ["dataset"], "left")
    known = F.col("min_km").isNotNull()
    fine = F.col("length_km").between(
        F.col("min_km") * (1 - LENGTH_TOLERANCE), F.col("max_km") * (1 + LENGTH_TOLERANCE)
    )
    return joined.withColumn("checked", known).withColumn("valid", known & F.coalesce(fine, F.lit(False)))


def alerts(
    longs: DataFrame, repeated: DataFrame, fixes: DataFrame, keys: Sequence[str] = LINE, long_km: float = LONG_SEGMENT_KM
) -> DataFrame:
    """Digest of about five messages per line.

    ``fixes`` has one row per line with the number of ``fixes``; the three first
    long segments come from a limit applied before the shuffle.
    """
    from pyspark.sql import Window

    keys = list(keys)
    total = longs.groupBy(*keys).agg(F.count("*").alias("n_long"))
    w = Window.partitionBy(*keys).orderBy("start_index")
    top = (
        longs.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= 3)
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "_r",
                        F.format_string(ALERT_SEGMENT, F.col("start_index"), F.col("end_index"), F.col("length_km")).alias("m"),
                    )
                )
            ).alias("top")
        )
    )
    wr = Window.partitionBy(*keys).orderBy("message")
    said = (
        repeated.select(*keys, F.format_string(MSG_LANDMARK, F.col("landmark"), F.col("vertices")).alias("message"))
        .withColumn("_r", F.row_number().over(wr))
        .where(F.col("_r") <= 5)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("message")).alias("said"))
    )
    joined = fixes.join(total, keys, "left").join(top, keys, "left").join(said, keys, "left")
    empty = F.array().cast("array<string>")
    head = F.when(
        F.col("n_long") > 0,
        F.concat(
            F.array(F.format_string(ALERT_COUNT, F.lit(long_km), F.col("n_long"))), F.transform("top", lambda t: t["m"])
        ),
    ).otherwise(empty)
    messages = F.slice(F.concat(head, F.coalesce("said", empty)), 1, 5)
    return joined.select(
        *keys,
        F.when(
            (F.size(messages) == 0) & (F.col("fixes") > 0), F.array(F.format_string(ALERT_FIXES, F.col("fixes")))
        )
        .otherwise(messages)
        .alias("alerts"),
    )


# -- parameters --------------------------------------------------------------


def _default(cond: Column, name: str, value: float | Column) -> Column:
    col = F.lit(value) if not isinstance(value, Column) else value
    return F.when(F.coalesce(cond, F.lit(True)), col).otherwise(F.col(name))


def normalise_temporal(params: DataFrame) -> DataFrame:
    """Defaults and clamps of the temporal parameters."""
    for name in ("min_years_per_step", "max_years_per_step"):
        if name not in params.columns:
            params = params.withColumn(name, F.lit(None).cast("double"))
    p = params.withColumns(
        {
            "years_per_step": _default(F.col("years_per_step") <= 0, "years_per_step", 1.0),
            "storm_probability": geo.clamp(F.coalesce("storm_probability", F.lit(0.0)), 0.0, 1.0),
            "storm_intensity": F.least(_default(F.col("storm_intensity") <= 1.0, "storm_intensity", 2.0), F.lit(10.0)),
            "sea_level_rise": F.greatest(F.coalesce("sea_level_rise", F.lit(0.0)), F.lit(0.0)),
            "seasonal_phase": geo.clamp(F.coalesce("seasonal_phase", F.lit(0.0)), 0.0, 2 * math.pi),
            "min_years_per_step": _default(F.col("min_years_per_step") <= 0, "min_years_per_step", 0.1),
        }
    )
    return p.withColumn(
        "max_years_per_step",
        _default(F.col("max_years_per_step") <= F.col("min_years_per_step"), "max_years_per_step", 10.0),
    )


def normalise_sediment(params: DataFrame) -> DataFrame:
    """Defaults of the sediment parameters."""

    def share(name: str, value: float) -> Column:
        return _default((F.col(name) <= 0) | (F.col(name) > 1), name, value)

    return params.withColumns(
        {
            "transport_coefficient": share("transport_coefficient", 0.7),
            "deposition_rate": share("deposition_rate", 0.5),
            "capacity_factor": _default(F.col("capacity_factor") <= 0, "capacity_factor", 1.0),
            "longshore_drift_coefficient": share("longshore_drift_coefficient", 0.8),
        }
    )


def normalise_wave(params: DataFrame) -> DataFrame:
    """Defaults of the wave parameters and the bearing in [0, 360)."""

    def positive(name: str, value) -> Column:
        return _default(F.col(name) <= 0, name, value)

    return params.withColumns(
        {
            "wind_speed": positive("wind_speed", 12.0),
            "fetch_spread_deg": positive("fetch_spread_deg", 55.0),
            "fetch_samples": positive("fetch_samples", 9),
            "max_fetch_m": positive("max_fetch_m", 150_000.0),
            "depth_scale_m": positive("depth_scale_m", 4_000.0),
            "exposure_power": positive("exposure_power", 1.5),
            "max_retreat_m": positive("max_retreat_m", F.col("strength_m")),
            "probe_m": positive("probe_m", 25.0),
            "wind_dir_deg": F.pmod(F.col("wind_dir_deg"), F.lit(360.0)),
        }
    )


def temporal_warnings(params: DataFrame) -> DataFrame:
    """Warnings on already normalised temporal parameters."""
    y, lo, hi = F.col("years_per_step"), F.col("min_years_per_step"), F.col("max_years_per_step")
    found = F.array_compact(
        F.array(
            F.when(y < lo, F.format_string(WARN_STEP_LOW, y, lo)),
            F.when(y > hi, F.format_string(WARN_STEP_HIGH, y, hi)),
            F.when(
                F.col("storm_probability") > 0.5,
                F.format_string(WARN_STORMS, F.col("storm_probability")),
            ),
            F.when(
                F.col("sea_level_rise") > 0.01,
                F.format_string(WARN_SEA, F.col("sea_level_rise")),
            ),
        )
    )
    return params.withColumn("warnings", found)
