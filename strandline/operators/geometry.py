"""Per-line geometry (G1-G15) as DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import LINE, SCAN_CHUNK, attach, chunk_number, with_neighbours

MODEL_POINT_CAP = 3072
MODEL_POINT_BUDGET = 400_000


def segments(lines: DataFrame, keys: Sequence[str] = LINE, extra: Sequence[str] = ()) -> DataFrame:
    """One row per segment (G1): its end vertex, start vertex ``p*`` and length.

    ``seq`` is the number of the end vertex.
    """
    nb = with_neighbours(lines, ["lat", "lon", "seq"], keys).where(F.col("prev").isNotNull())
    return nb.select(
        *keys,
        (F.col("seq") - 1).alias("start_seq"),
        "seq",
        F.col("prev.lat").alias("plat"),
        F.col("prev.lon").alias("plon"),
        "lat",
        "lon",
        *extra,
        geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")).alias("km"),
    )


def line_summary(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """One row per line (G2-G5): counts, length, area, bounds, closure.

    One shuffle on (line, chunk) for the segment lengths, then a combining
    aggregate; the closing term of the shoelace sum uses the two end vertices.
    """
    nb = with_neighbours(lines, ["lat", "lon"], keys)
    # shoelace terms relative to a fixed origin keep the products small
    y, x = F.col("lat") - geo.REGIONAL_REF_LAT, F.col("lon") - geo.REGIONAL_REF_LON
    py, px = F.col("prev.lat") - geo.REGIONAL_REF_LAT, F.col("prev.lon") - geo.REGIONAL_REF_LON
    measured = nb.select(
        *keys,
        "seq",
        "lat",
        "lon",
        geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")).alias("km"),
        geo.cross(px, py, x, y).alias("cross"),
    )
    point = F.struct("lat", "lon")
    agg = measured.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.coalesce(F.sum("km"), F.lit(0.0)).alias("length_km"),
        F.coalesce(F.max("km"), F.lit(0.0)).alias("max_segment_km"),
        F.coalesce(F.sum("cross"), F.lit(0.0)).alias("cross"),
        F.avg("lat").alias("ref_lat"),
        F.avg("lon").alias("ref_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
        F.min("seq").alias("lo_seq"),
        F.max("seq").alias("hi_seq"),
        F.min_by(point, F.col("seq")).alias("first"),
        F.max_by(point, F.col("seq")).alias("last"),
    )
    closing = geo.cross(
        F.col("last.lon") - geo.REGIONAL_REF_LON,
        F.col("last.lat") - geo.REGIONAL_REF_LAT,
        F.col("first.lon") - geo.REGIONAL_REF_LON,
        F.col("first.lat") - geo.REGIONAL_REF_LAT,
    )
    m_lon = geo.meters_per_deg_lon(F.col("ref_lat"))
    area = F.abs(F.col("cross") + closing) * m_lon * geo.METERS_PER_DEG_LAT / 2.0e6
    width = (F.col("max_lon") - F.col("min_lon")) * m_lon
    height = (F.col("max_lat") - F.col("min_lat")) * geo.METERS_PER_DEG_LAT
    segs = F.greatest(F.col("points") - 1, F.lit(0))
    return (
        agg.withColumn("segments", segs)
        .withColumn("mean_segment_km", geo.safe_ratio(F.col("length_km"), F.col("segments").cast("double")))
        .withColumn("area_km2", F.when(F.col("points") < 3, F.lit(0.0)).otherwise(area))
        .withColumn("meters_per_deg_lon", m_lon)
        .withColumn("width_m", width)
        .withColumn("height_m", height)
        .withColumn("diagonal_m", geo.length2d(width, height))
        .withColumn(
            "closed_exact", (F.col("points") >= 2) & (F.col("first") == F.col("last"))
        )
        .withColumn(
            "closed_6dp",
            (F.col("points") >= 2)
            & (geo.ring_key(F.col("first.lat")) == geo.ring_key(F.col("last.lat")))
            & (geo.ring_key(F.col("first.lon")) == geo.ring_key(F.col("last.lon"))),
        )
        .drop("cross")
    )


def line_reference(lines: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Mean vertex and scale of the local projection, one row per line.

    The mean is the sum along ``seq`` over the count: a sum in another order differs in its last bits, which
    moves coordinates that lie on the middle between two rounded values.  Only beyond ``SCAN_CHUNK`` numbers
    are sums of stretches added.
    """
    keys = list(keys)
    stretch = [*keys, "_chunk"]
    along = Window.partitionBy(*stretch).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    part = lines.select(*keys, "seq", "lat", "lon", chunk_number("seq", SCAN_CHUNK).alias("_chunk"))
    summed = part.withColumns({f"_{c}": F.sum(c).over(along) for c in ("lat", "lon")})
    sums = summed.groupBy(*stretch).agg(
        F.count("*").alias("n"), F.count("lat").alias("n_lat"), F.count("lon").alias("n_lon"),
        F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        *[F.max_by(f"_{c}", "seq").alias(f"sum_{c}") for c in ("lat", "lon")],
        *[F.min_by(c, "seq").alias(f"first_{c}") for c in ("lat", "lon")],
        *[F.max_by(c, "seq").alias(f"last_{c}") for c in ("lat", "lon")],
    )

    def mean(c: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct("_chunk", f"sum_{c}")))
        return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.coalesce(p[f"sum_{c}"], F.lit(0.0))) / F.sum(f"n_{c}")

    def met(c: str) -> Column:
        return F.min_by(f"first_{c}", "_chunk").eqNullSafe(F.max_by(f"last_{c}", "_chunk"))

    return sums.groupBy(*keys).agg(
        F.sum("n").alias("points"),
        mean("lat").alias("ref_lat"),
        mean("lon").alias("ref_lon"),
        F.min("lo").alias("lo_seq"),
        F.max("hi").alias("hi_seq"),
        (met("lat") & met("lon") & (F.sum("n") >= 2)).alias("closed"),
    ).withColumn("meters_per_deg_lon", geo.meters_per_deg_lon(F.col("ref_lat")))


def project_local(lines: DataFrame, keys: Sequence[str] = LINE, reference: DataFrame | None = None) -> DataFrame:
    """Local equirectangular metres ``x``, ``y`` around the mean vertex."""
    ref = line_reference(lines, keys) if reference is None else reference
    joined = attach(lines, ref, keys)
    return joined.withColumns(
        {
            "x": (F.col("lon") - F.col("ref_lon")) * F.col("meters_per_deg_lon"),
            "y": (F.col("lat") - F.col("ref_lat")) * geo.METERS_PER_DEG_LAT,
        }
    )


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Back to (lat, lon) with the reference columns of ``project_local``."""
    return (
        F.col("ref_lat") + y / geo.METERS_PER_DEG_LAT,
        F.col("ref_lon") + x / F.col("meters_per_deg_lon"),
    )


def point_budget(iterations: Column) -> Column:
    """Vertices allowed before a fourfold growth is applied ``iterations`` times."""
    growth = F.pow(F.lit(4.0), F.greatest(iterations, F.lit(0)).cast("double"))
    return F.greatest(
        F.least(F.floor(F.lit(float(MODEL_POINT_BUDGET)) / growth) + 1, F.lit(MODEL_POINT_CAP)), F.lit(4)
    )


def compare_simplification(before: DataFrame, after: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Counts and lengths of two versions of each line."""
    b = line_summary(before, keys).select(
        *keys, F.col("points").alias("points_before"), F.col("length_km").alias("length_before_km")
    )
    a = line_summary(after, keys).select(
        *keys, F.col("points").alias("points_after"), F.col("length_km").alias("length_after_km")
    )
    delta = F.col("length_after_km") - F.col("length_before_km")
    return b.join(a, list(keys)).select(
        *keys,
        (F.col("points_before") != F.col("points_after")).alias("applied"),
        "points_before",
        "points_after",
        "length_before_km",
        "length_after_km",
        delta.alias("length_delta_km"),
        F.when(F.col("length_before_km") > 0, delta / F.col("length_before_km") * 100)
        .otherwise(F.lit(0.0))
        .alias("length_delta_percent"),
    )


def even_sample(lines: DataFrame, keys: Sequence[str] = LINE, size: int = 30) -> DataFrame:
    """At most ``size`` evenly spaced vertices per line, ends included.

    The wanted numbers are derived from the vertex count, then matched by an
    equi-join on (line, seq): no line is ever sorted.
    """
    span = lines.groupBy(*keys).agg(F.count("*").alias("n"), F.min("seq").alias("lo"))
    last = F.col("n") - 1
    picks = F.when(
        F.col("n") <= size, F.sequence(F.lit(0).cast("bigint"), last)
    ).otherwise(
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.lit(size - 1)),
                lambda i: F.floor(i * last / F.lit(size - 1)),
            )
        )
    )
    wanted = span.select(*keys, F.explode(picks).alias("index"), "lo").select(
        *keys, "index", (F.col("index") + F.col("lo")).cast("int").alias("seq")
    )
    return wanted.join(lines, [*keys, "seq"])


def version_ratios(versions: DataFrame, version: str = "step", keys: Sequence[str] = LINE) -> DataFrame:
    """Length of each version against the first version and the longest one.

    The first version plays the base, the per-line maximum the reference line.
    """
    sized = line_summary(versions, [*keys, version]).select(*keys, version, "points", "length_km")
    base = sized.groupBy(*keys).agg(
        F.min_by("length_km", version).alias("base_km"), F.max("length_km").alias("reference_km")
    )
    return sized.join(base, list(keys)).select(
        *keys,
        version,
        "points",
        "length_km",
        geo.safe_ratio(F.col("length_km"), F.col("base_km")).alias("relative_to_base"),
        geo.safe_ratio(F.col("length_km"), F.col("reference_km")).alias("relative_to_reference"),
    )
