"""Longshore sediment budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import LINE, with_halo, with_one_row
from strandline.session import stored

# Fixed values of the budget: limits and message formats.
HARD_ROCK = 5.0
HARD_ROCK_SHARE = 0.7
MISSING_ENERGY = 0.5
CALM_ENERGY = 0.3
BALANCE_LIMIT = 0.15
WARN_BALANCE = "Poor mass balance: %.2f vs %.2f"
NOTE_EROSION = "Erosion at %d points"
NOTE_DEPOSITION = "Deposition at %d points"


@dataclass(frozen=True)
class SedimentParams:
    """Parameters after defaulting (see ``normalise_sediment`` for tables of them)."""

    transport_coefficient: float = 0.7
    deposition_rate: float = 0.5
    capacity_factor: float = 1.0
    longshore_drift_coefficient: float = 0.8
    direction_deg: float = 0.0


def for_parameters(shore: DataFrame, params: DataFrame) -> tuple[DataFrame, SimpleNamespace]:
    """Every row of ``shore`` once per row of ``params``, and parameters that E1 to E7 take as columns.

    ``params``: a short table of defaulted parameters (names as in ``SedimentParams``) with a column that
    tells its rows apart, which then is one of the keys: all scenarios are computed in one call.
    """
    packed = params.agg(F.collect_list(F.struct(*params.columns)).alias("_params"))
    rows = with_one_row(shore, packed).withColumn("_p", F.explode("_params")).select(*shore.columns, "_p.*")
    return rows, SimpleNamespace(**{f.name: F.col(f.name) for f in fields(SedimentParams)})


def erosion_volumes(shore: DataFrame, p: SedimentParams) -> DataFrame:
    """Eroded, transported and locally deposited volume per vertex."""
    res = F.col("resistance")
    eroded = F.when(res > 0, F.col("erosion_rate") / res).otherwise(F.col("erosion_rate"))
    share = F.lit(p.transport_coefficient) * F.when(res > HARD_ROCK, HARD_ROCK_SHARE).otherwise(1.0)
    return (
        shore.withColumn("eroded", eroded)
        .withColumn("transported", F.col("eroded") * share)
        .withColumn("deposited", F.col("eroded") * (1 - share))
    )


def longshore_exchange(volumes: DataFrame, p: SedimentParams, keys: Sequence[str] = LINE) -> DataFrame:
    """Volumes sent to and received from the adjacent vertices.

    Neighbours wrap on every line.  With fewer than three vertices the chord
    between the neighbours has no length and nothing moves.  What a vertex sends depends on its
    neighbours and what it receives on theirs, so chunks carry two rows of each side.
    """
    rows, along = with_halo(volumes, 2, keys, wrap=True)
    lat, lon = F.col("lat"), F.col("lon")
    cx, cy = F.lead(lon).over(along) - F.lag(lon).over(along), F.lead(lat).over(along) - F.lag(lat).over(along)
    rows = rows.withColumns({"_cx": cx, "_cy": cy})
    chord = geo.length2d(F.col("_cx"), F.col("_cy"))
    ux, uy = F.col("_cx") / chord, F.col("_cy") / chord
    wx, wy = geo.bearing_unit(F.lit(p.direction_deg))
    energy = F.coalesce(F.col("energy"), F.lit(MISSING_ENERGY))
    drift = F.lit(p.longshore_drift_coefficient) * F.abs(geo.dot(ux, uy, wx, wy)) * energy
    half = F.col("transported") * 0.5 * drift
    forward = geo.cross(ux, uy, wx, wy) > 0
    moves = chord >= 1e-9
    sent = rows.withColumns(
        {
            "to_next": F.when(moves, half * F.when(forward, 1.5).otherwise(0.5)).otherwise(0.0),
            "to_prev": F.when(moves, half * F.when(forward, 0.5).otherwise(1.5)).otherwise(0.0),
        }
    )
    got = sent.withColumn("incoming", F.lag("to_next").over(along) + F.lead("to_prev").over(along))
    return got.where("_own").drop("_own", "_home", "_cx", "_cy")


def deposition(exchanged: DataFrame, p: SedimentParams) -> DataFrame:
    """Deposition above capacity or in calm water, and the net change."""
    energy = F.coalesce(F.col("energy"), F.lit(MISSING_ENERGY))
    capacity = F.lit(p.capacity_factor) * energy
    over = F.col("incoming") > capacity
    settles = over | (energy < CALM_ENERGY)
    excess = F.when(over, F.col("incoming") - capacity).otherwise(capacity * 0.5)
    added = F.when(settles, excess * p.deposition_rate).otherwise(0.0)
    return (
        exchanged.withColumn("transported", F.col("transported") + F.when(over, excess - added).otherwise(0.0))
        .withColumn("deposited", F.col("deposited") + added)
        .withColumn("accumulating", settles)
        .withColumn("net_change", F.col("eroded") - F.col("deposited"))
    )


def modified_rate(accumulating: str = "accumulating") -> Column:
    """Rate left after deposition, never negative (E5)."""
    return F.when(
        F.col(accumulating), F.greatest(F.col("erosion_rate") - F.col("deposited"), F.lit(0.0))
    ).otherwise(F.col("erosion_rate"))


def budget_totals(settled: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Totals, mass balance and warnings per line."""
    agg = settled.groupBy(*keys).agg(
        F.sum("eroded").alias("total_eroded"),
        F.sum("transported").alias("total_transport"),
        F.sum("deposited").alias("total_deposited"),
        F.count_if(F.col("net_change") > 0).alias("erosion_points"),
        F.count_if(F.col("net_change") < 0).alias("deposition_points"),
    )
    gap = F.abs(F.col("total_eroded") - (F.col("total_deposited") + F.col("total_transport")))
    ratio = F.when(F.col("total_eroded") > 0, gap / F.col("total_eroded")).otherwise(F.lit(0.0))
    fine = F.when(F.col("total_eroded") > 0, ratio < BALANCE_LIMIT).otherwise(F.lit(True))
    warnings = F.array_compact(
        F.array(
            F.when(
                ~fine,
                F.format_string(WARN_BALANCE, F.col("total_eroded"), F.col("total_deposited")),
            ),
            F.when(F.col("erosion_points") > 0, F.format_string(NOTE_EROSION, F.col("erosion_points"))),
            F.when(F.col("deposition_points") > 0, F.format_string(NOTE_DEPOSITION, F.col("deposition_points"))),
        )
    )
    return agg.withColumns(
        {
            "net_change": F.col("total_eroded") - F.col("total_deposited"),
            "balance_ratio": ratio,
            "is_valid": fine,
            "warnings": warnings,
        }
    )


def sediment_budget(
    shore: DataFrame, p: SedimentParams, keys: Sequence[str] = LINE
) -> tuple[DataFrame, DataFrame]:
    """Budget per vertex and per line (E7); the shore is read once."""
    settled = deposition(longshore_exchange(erosion_volumes(stored(shore, "shore"), p), p, keys), p)
    settled = settled.withColumn("modified_rate", modified_rate())
    return settled, budget_totals(settled, keys)
