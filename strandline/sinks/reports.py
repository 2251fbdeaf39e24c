"""Nested metrics documents.

A document holds arrays of steps or findings.  Arrays are cut into pages of at
most ``PAGE`` order values, so a line with very many of them becomes several
rows instead of one unbounded row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.lines import LINE
from strandline.operators.fractal import dimension
from strandline.operators.geometry import compare_simplification, line_summary, version_ratios
from strandline.operators.quality import LONG_SEGMENT_KM, count_issues, long_segments, repeated_landmarks
from strandline.session import stored
from strandline.operators.reports import KEY, basic_statistics, erosion_totals, storm_split, temporal_change

PAGE = 10_000


def _paged(df: DataFrame, keys: Sequence[str], order: str, row: Column, name: str) -> DataFrame:
    return (
        df.groupBy(*keys, F.floor(F.col(order) / PAGE).alias("page"))
        .agg(F.array_sort(F.collect_list(row)).alias(name))
    )


def _polyline(lines: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    s = line_summary(lines, keys)
    return s.select(*keys, F.struct(F.col("points").alias("points_count"), "length_km").alias(name))


def coastline_documents(
    lines: DataFrame,
    rendered: DataFrame,
    landmarks: DataFrame,
    keys: Sequence[str] = LINE,
    long_km: float = LONG_SEGMENT_KM,
) -> DataFrame:
    """Real and rendered line, simplification, highlights and issues (S14), both lists in pages."""
    keys = list(keys)
    comparison = stored(compare_simplification(lines, rendered, keys), "comparison")
    head = comparison.select(
        *keys,
        F.struct(F.col("points_before").alias("points_count"), F.col("length_before_km").alias("length_km")).alias("real"),
        F.struct(F.col("points_after").alias("points_count"), F.col("length_after_km").alias("length_km")).alias("render"),
        F.struct(*[c for c in comparison.columns if c not in keys]).alias("render_simplification"),
    )
    # both findings are read twice: listed, and counted as issues
    longs = stored(long_segments(lines, keys, long_km), "long-segments")
    found = stored(repeated_landmarks(lines, landmarks, keys), "repeated")
    pages = _paged(
        longs, keys, "start_index",
        F.struct(
            "start_index", "end_index", "length_km",
            F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")).alias("start"),
            F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")).alias("end"),
        ),
        "long_segments",
    )
    issues = count_issues(comparison.select(*keys), longs, found, keys, long_km).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("warning_type", F.col("issues").alias("count"), "threshold_km"))).alias("summary")
    )
    numbered = Window.partitionBy(*keys).orderBy("landmark")
    repeated = found.withColumn("_n", F.row_number().over(numbered) - 1)
    repeated = _paged(
        repeated, keys, "_n", F.struct(F.col("landmark").alias("name"), F.col("vertices").alias("count")), "duplicate_locations"
    )
    pages = pages.join(repeated, [*keys, "page"], "full")
    return head.join(issues, keys, "left").join(pages, keys, "left").select(
        *keys,
        F.coalesce("page", F.lit(0)).alias("page"),
        "real",
        "render",
        "render_simplification",
        F.struct("long_segments").alias("highlights"),
        F.struct("summary", "duplicate_locations").alias("validation"),
    )


def erosion_series_documents(snapshots: DataFrame, reference: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """One element per step: vertices, length and area."""
    keys = list(keys)
    sized = line_summary(snapshots, [*keys, "step"])
    steps = _paged(
        sized, keys, "step", F.struct("step", F.col("points"), "length_km", "area_km2"), "steps"
    )
    return _polyline(reference, keys, "reference_coastline").join(steps, keys)


def fractal_series_documents(versions: DataFrame, keys: Sequence[str] = LINE, version: str = "step") -> DataFrame:
    """One element per version: vertices, length, ratios and dimension."""
    keys = list(keys)
    full = [*keys, version]
    ratios = version_ratios(versions, version, keys)
    dims = dimension(versions, full)
    joined = ratios.join(dims, full)
    measured = F.when(
        F.col("sample_count") > 0,
        F.struct(
            "valid",
            F.when(F.col("valid"), F.col("dimension")).alias("dimension"),
            F.col("r_squared").alias("regression_r_squared"),
            F.col("stable").alias("stable_across_scales"),
            F.col("spread").alias("stability_spread"),
            "sample_count",
        ),
    )
    row = F.struct(
        F.col(version).alias("iteration"),
        F.col("points").alias("points_count"),
        "length_km",
        F.col("relative_to_base").alias("relative_to_model_base"),
        "relative_to_reference",
        measured.alias("dimension"),
    )
    return _paged(joined, keys, version, row, "iterations")


def report_documents(m: DataFrame) -> DataFrame:
    """Summary and one struct per step."""
    summary = (
        basic_statistics(m)
        .join(temporal_change(m).select(*KEY, "simulated_years"), KEY)
        .join(erosion_totals(m).select(*KEY, "total_eroded_m3"), KEY)
        .join(storm_split(m).select(*KEY, "storm_events"), KEY)
        .select(
            *KEY,
            F.struct(
                "total_steps", "initial_length_km", "final_length_km", "simulated_years",
                F.col("total_eroded_m3").alias("total_erosion_m3"), "storm_events",
            ).alias("summary"),
        )
    )
    row = F.struct("step", "length_km", "year", "area_km2", "eroded_m3", "storm_event")
    steps = _paged(m, KEY, "step", row, "steps")
    return summary.join(steps, KEY).select(*KEY, "page", "summary", F.struct("steps").alias("analysis"))


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; null members are left out."""
    docs.write.mode(mode).json(path)
