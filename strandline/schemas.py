"""Schemas of the domain tables, and the required-column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERTICES = "line_id BIGINT, seq INT, lat DOUBLE, lon DOUBLE"
BATHYMETRY = "ord BIGINT, lat DOUBLE, lon DOUBLE, depth DOUBLE"
LITHO_POINT = (
    "lat DOUBLE, lon DOUBLE, region STRING, lithology_class STRING, resistance DOUBLE, "
    "color STRING, description STRING, confidence STRING, source STRING, "
    "erosion_observed DOUBLE, note STRING, dynamic BOOLEAN"
)
LITHO_CLASS = (
    "resistance DOUBLE, color STRING, description STRING, erosion_range ARRAY<DOUBLE>, "
    "dynamic BOOLEAN, note STRING"
)
EROSION_BASELINE = (
    "resistance_range ARRAY<DOUBLE>, erosion_m_year MAP<STRING,DOUBLE>, description STRING, note STRING"
)
LITHO_BOUNDS = "min_lat DOUBLE, max_lat DOUBLE, min_lon DOUBLE, max_lon DOUBLE"


def _struct(ddl: str) -> str:
    return "STRUCT<" + ", ".join(
        f"{part.strip().split(' ', 1)[0]}: {part.strip().split(' ', 1)[1]}" for part in _split(ddl)
    ) + ">"


def _split(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return parts + [current]


LITHO_PROFILE = (
    "metadata STRUCT<name: STRING, version: STRING, created: STRING, sources: ARRAY<STRING>, "
    f"resolution: DOUBLE, bounds: {_struct(LITHO_BOUNDS)}, regions: ARRAY<STRING>, note: STRING>, "
    f"points ARRAY<{_struct(LITHO_POINT)}>, "
    f"classes MAP<STRING, {_struct(LITHO_CLASS)}>, "
    f"erosion_baselines MAP<STRING, {_struct(EROSION_BASELINE)}>"
)

STEP_METRICS = T.StructType(
    [
        T.StructField("year", T.DoubleType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("length_km", T.DoubleType()),
        T.StructField("area_km2", T.DoubleType()),
        T.StructField("eroded_m3", T.DoubleType()),
        T.StructField("deposited_m3", T.DoubleType()),
        T.StructField("net_change_m3", T.DoubleType()),
        T.StructField("storm_event", T.BooleanType()),
        T.StructField("sea_level_m", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Raise when a mandatory column is absent, else pass the frame through."""
    missing = [name for name in needed if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
