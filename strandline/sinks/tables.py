"""Long and wide step tables and raw snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_COLUMNS = ["year", "step", "length_km", "area_km2", "eroded_m3", "deposited_m3", "net_change_m3", "storm_event", "sea_level_m"]
WIDE_METRICS = ["year", "length_km", "area_km2", "storm_event", "sea_level_m"]


def fixed(col: Column, digits: int) -> Column:
    """Fixed-point text; halves go to the even digit."""
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f", F.rint(col * scale) / scale)


def long_frame(m: DataFrame) -> DataFrame:
    """Text columns of the long table."""
    level = F.when(F.coalesce(F.col("sea_level_m"), F.lit(0.0)) > 0, F.col("sea_level_m")).otherwise(F.lit(0.0))
    lead = [c for c in ("scenario",) if c in m.columns]
    return m.select(
        *lead,
        fixed(F.coalesce("year", F.lit(0.0)), 1).alias("year"),
        F.col("step").cast("string").alias("step"),
        *[fixed(F.col(c), 1).alias(c) for c in ("length_km", "area_km2", "eroded_m3", "deposited_m3", "net_change_m3")],
        F.when(F.coalesce("storm_event", F.lit(False)), "true").otherwise("false").alias("storm_event"),
        fixed(level, 4).alias("sea_level_m"),
    )


def wide_frame(m: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """One row per metric, one column per step.

    Without temporal states (``year`` null) the year is the step number.
    """
    text = long_frame(m).withColumn(
        "year", F.when(F.lit("year" in m.columns), F.col("year")).otherwise(F.col("step"))
    )
    tall = text.unpivot(["scenario", "step"], WIDE_METRICS, "metric_name", "value")
    wide = tall.withColumn("step", F.col("step").cast("int")).groupBy("scenario", "metric_name").pivot("step", steps).agg(
        F.first("value")
    )
    lead = ["scenario", "metric_name"]
    return wide.select(*lead, *[F.col(f"`{c}`").alias(f"step_{c}") for c in wide.columns if c not in lead])


def write_long(m: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, one folder per scenario."""
    long_frame(m).write.mode(mode).partitionBy("scenario").option("header", True).csv(path)


def write_wide(m: DataFrame, path: str, mode: str = "errorifexists", steps: list[int] | None = None) -> None:
    wide_frame(m, steps).write.mode(mode).partitionBy("scenario").option("header", True).csv(path)


def snapshot_frame(docs: DataFrame, at: Column) -> DataFrame:
    """Payloads with their versioned name (S11); ``docs`` has ``dataset, is_point_array, payload``."""
    from strandline.sources.naming import slug, snapshot_name

    return docs.select(
        F.coalesce(F.nullif(slug(F.col("dataset")), F.lit("")), F.lit("coastline")).alias("dataset"),
        F.date_format(at, "yyyyMMdd-HHmmss").alias("snapshot_ts"),
        snapshot_name(F.col("dataset"), F.col("is_point_array"), at).alias("file_name"),
        "payload",
    )


def write_snapshots(frame: DataFrame, path: str, mode: str = "append") -> None:
    frame.write.mode(mode).partitionBy("dataset", "snapshot_ts").parquet(path)
