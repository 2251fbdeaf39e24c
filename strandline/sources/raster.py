"""Resampling of a depth raster to a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.lines import with_one_row


#: Target positions of an axis that are sorted together.
STRETCH = 4096


def _axis_matches(values: DataFrame, low: float, high: float, step: float, name: str) -> DataFrame:
    """Target positions of one axis with the nearest source position, lower on ties.

    An as-of join in both directions, in stretches of ``STRETCH`` positions: source and target
    are sorted together within a stretch, and what a stretch needs of those before and after it
    comes from one least and one largest value per stretch.
    """
    spark = values.sparkSession
    count = int((high - low) / step) + 1
    target = spark.range(count).select(
        (F.lit(low) + F.col("id") * step).alias("t"), F.lit(None).cast("double").alias("v")
    )
    source = values.select(F.col(name).alias("t"), F.col(name).alias("v")).distinct()
    stretch = F.floor((F.col("t") - low) / (step * STRETCH)).alias("s")
    ends = source.groupBy(stretch).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    ends = ends.agg(F.collect_list(F.struct("s", "least", "most")).alias("ends"))
    ordered = Window.partitionBy("s").orderBy("t")
    below = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above = ordered.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = source.unionByName(target).withColumn("s", stretch)
    seen = both.withColumns({"lo": F.max("v").over(below), "hi": F.min("v").over(above)}).where(F.col("v").isNull())
    seen = with_one_row(seen, ends)
    earlier = F.array_max(F.transform(F.filter("ends", lambda e: e["s"] < F.col("s")), lambda e: e["most"]))
    later = F.array_min(F.transform(F.filter("ends", lambda e: e["s"] > F.col("s")), lambda e: e["least"]))
    seen = seen.withColumns({"lo": F.coalesce("lo", earlier), "hi": F.coalesce("hi", later)})
    nearest = F.when(F.col("hi").isNull(), F.col("lo")).when(F.col("lo").isNull(), F.col("hi")).otherwise(
        F.when(F.abs(F.col("lo") - F.col("t")) <= F.abs(F.col("hi") - F.col("t")), F.col("lo")).otherwise(F.col("hi"))
    )
    return seen.select(F.col("t").alias(f"{name}_out"), nearest.alias(name))


def resample(
    raster: DataFrame,
    bounds: tuple[float, float, float, float],
    resolution: float,
    positive_is_depth: bool = True,
) -> DataFrame:
    """Nearest source cell for every cell of a regular grid; depths are not positive.

    ``raster`` has ``lat, lon, value``; ``bounds`` is (min_lat, max_lat, min_lon,
    max_lon).  With ``positive_is_depth`` off, land cells are dropped instead of
    being turned into water.
    """
    min_lat, max_lat, min_lon, max_lon = bounds
    inside = raster.where(F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon))
    rows = _axis_matches(inside, min_lat, max_lat, resolution, "lat")
    cols = _axis_matches(inside, min_lon, max_lon, resolution, "lon")
    met = inside.join(rows, "lat").join(cols, "lon")
    if positive_is_depth:
        depth = -F.abs(F.col("value"))
    else:
        met, depth = met.where(F.col("value") <= 0), F.col("value")
    return met.select(
        F.round("lat_out", 6).alias("lat"), F.round("lon_out", 6).alias("lon"), (F.round(depth, 2) + 0.0).alias("depth")
    )
