"""Snapshot series and scenario calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import LINE, attach, previous_row
from strandline.operators.fractal import fast_dimension
from strandline.operators.geometry import line_summary


def seasonal_factor(year: Column, phase: Column) -> Column:
    """Seasonal multiplier between 0.5 and 1.5."""
    return 1.0 + 0.5 * F.sin(geo.TWO_PI * year + F.try_mod(phase, F.lit(geo.TWO_PI)))


def step_calendar(params: DataFrame) -> DataFrame:
    """Steps of each scenario with year, season and sea level."""
    steps = F.greatest(F.ceil(F.col("target_years") / F.col("years_per_step")), F.lit(1))
    cal = params.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), steps))).withColumn(
        "step", F.col("step").cast("int")
    )
    year = F.col("step") * F.col("years_per_step")
    later = F.col("step") > 0
    season = F.when(F.col("seasonality"), seasonal_factor(year, F.col("seasonal_phase"))).otherwise(F.lit(1.0))
    return cal.withColumns(
        {
            "year": year,
            "seasonal_factor": F.when(later, season).otherwise(F.lit(0.0)),
            "sea_level_offset": F.when(later & (F.col("sea_level_rise") > 0), year * F.col("sea_level_rise")).otherwise(
                F.lit(0.0)
            ),
        }
    )


def modulated_rate(base: Column) -> Column:
    """Rate under storm, season and sea level of a step."""
    storm = F.when(F.col("is_storm"), F.col("storm_intensity")).otherwise(F.lit(1.0))
    level = F.col("sea_level_offset")
    sea = F.when(level > 0, 1.0 + 0.1 * F.log(1.0 + level)).otherwise(F.lit(1.0))
    return base * storm * F.col("seasonal_factor") * sea


def retreats(snapshots: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Distance of each vertex to its place one step earlier, in km.

    An equi-join on (line, step, seq); pairs of snapshots of unequal size are
    left out.
    """
    keys = list(keys)
    full = [*keys, "step"]
    pairs = attach(snapshots, _same_size(snapshots, keys), full).join(_earlier(snapshots, keys), [*full, "seq"])
    return pairs.select(*full, "seq", _moved().alias("retreat_km"))


def _same_size(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshots with as many vertices as the one before: keys, step, lo_seq, hi_seq."""
    full = [*keys, "step"]
    size = snapshots.groupBy(*full).agg(
        F.count("*").alias("n"), F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq")
    )
    before = size.select(*keys, (F.col("step") + 1).alias("step"), F.col("n").alias("n_before"))
    return size.join(before, full).where(F.col("n") == F.col("n_before")).drop("n", "n_before")


def _earlier(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    return snapshots.select(
        *keys, (F.col("step") + 1).alias("step"), "seq", F.col("lat").alias("plat"), F.col("lon").alias("plon")
    )


def _moved() -> Column:
    return geo.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))


def retreat_summary(snapshots: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Mean and largest of ``retreats`` per line and step; unequal pairs are left out after the vertices are summed up."""
    keys = list(keys)
    full = [*keys, "step"]
    vertices = snapshots.select(*full, "seq", "lat", "lon")
    pairs = vertices.join(_earlier(snapshots, keys), [*full, "seq"])
    moved = pairs.groupBy(*full).agg(F.avg(_moved()).alias("mean_retreat"), F.max(_moved()).alias("max_retreat"))
    return moved.join(_same_size(snapshots, keys).select(*full), full)


def snapshot_metrics(snapshots: DataFrame, states: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Length, area, dimension, retreat and state per line and step (T4)."""
    full = [*keys, "step"]
    sized = line_summary(snapshots, full).select(*full, "points", "length_km", "area_km2")
    dims = fast_dimension(snapshots, full).select(*full, "fast_dimension")
    moved = retreat_summary(snapshots, keys)
    return (
        sized.join(dims, full)
        .join(moved, full, "left")
        .join(states, full, "left")
        .select(
            *full,
            "year",
            "points",
            "length_km",
            "area_km2",
            F.when(F.col("points") > 10, F.col("fast_dimension")).otherwise(F.lit(0.0)).alias("fractal_dimension"),
            F.coalesce("mean_retreat", F.lit(0.0)).alias("mean_retreat"),
            F.coalesce("max_retreat", F.lit(0.0)).alias("max_retreat"),
            "storm_event",
            "seasonal_factor",
        )
    )


def eroded_volumes(sized: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Volumes estimated from the change of length between steps (T5)."""
    prev = previous_row(sized, ["length_km"], keys, "step")
    eroded = F.coalesce((F.col("prev.length_km") - F.col("length_km")) * 1000.0, F.lit(0.0))
    return prev.withColumns(
        {"eroded_m3": eroded, "deposited_m3": F.lit(0.0), "net_change_m3": eroded}
    ).drop("prev")


def series_summary(metrics: DataFrame, rise_per_year: Column, keys: Sequence[str] = LINE) -> DataFrame:
    """One row per line over its steps.

    The sum of all shortenings telescopes to first minus last length.
    """
    agg = metrics.groupBy(*keys).agg(
        F.max("year").alias("total_years"),
        (F.count("*") - 1).alias("total_steps"),
        F.count_if("storm_event").alias("storm_count"),
        F.min_by("length_km", "step").alias("initial_length_km"),
        F.max_by("length_km", "step").alias("final_length_km"),
    )
    change = F.col("final_length_km") - F.col("initial_length_km")
    return agg.select(
        *keys,
        "total_years",
        "total_steps",
        "storm_count",
        F.try_divide(F.col("storm_count").cast("double"), F.col("total_steps").cast("double")).alias("storm_frequency"),
        (-change * 1000).alias("accumulated_erosion_m"),
        (F.col("total_years") * rise_per_year).alias("sea_level_rise_m"),
        "initial_length_km",
        "final_length_km",
        change.alias("length_change_km"),
        (F.try_divide(change, F.col("initial_length_km")) * 100).alias("length_change_percent"),
    )
