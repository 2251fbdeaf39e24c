"""Domain tables derived from the driver's tables, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.lines import LINE, previous_row, running
from strandline.sources.lithology import default_classes
from strandline.operators.quality import default_landmarks

CLASS_NAMES = ["limestone", "clay", "volcanic", "sedimentary"]
CONFIDENCE = ["high", "medium", "low"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """One line per user: a compact walk, ordered by event id."""
    return _walk(table(spark, sf, "events").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("src_id")))


def one_line(spark: SparkSession, sf: str) -> DataFrame:
    """The same walk with all events on a single line, which grows with the table."""
    return _walk(table(spark, sf, "events").select(F.lit(1).cast("bigint").alias("line_id"), F.col("event_id").alias("src_id")))


def _walk(e: DataFrame) -> DataFrame:
    walk = running(
        e,
        {
            "n": F.lit(1),
            "dlat": F.col("src_id") * 7919 % 21 - 10,
            "dlon": F.col("src_id") * 104729 % 31 - 15,
        },
        LINE,
        "src_id",
    )
    return walk.select(
        "line_id",
        F.col("n").cast("int").alias("seq"),
        (F.lit(43.0) + F.col("dlat").cast("double") / 100.0).alias("lat"),
        (F.lit(34.0) + F.col("dlon").cast("double") / 100.0).alias("lon"),
        "src_id",
    )


def close_lines(lines: DataFrame) -> DataFrame:
    """Append the first vertex of every line at its end."""
    tail = lines.groupBy("line_id").agg(
        (F.max("seq") + 1).alias("seq"), F.min_by(F.struct("lat", "lon", "src_id"), "seq").alias("p")
    )
    return lines.unionByName(tail.select("line_id", "seq", "p.lat", "p.lon", "p.src_id"))


def rings(spark: SparkSession, sf: str) -> DataFrame:
    return close_lines(vertices(spark, sf))


def shores(spark: SparkSession, sf: str) -> DataFrame:
    """Even lines closed, odd lines open."""
    v = vertices(spark, sf)
    closed = close_lines(v.where(F.col("line_id") % 2 == 0))
    return closed.unionByName(v.where(F.col("line_id") % 2 == 1))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    v = vertices(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(4))))
    shift = F.col("step") * (F.col("src_id") % 7 - 3) / 10000.0
    return v.select("line_id", "step", "seq", (F.col("lat") + shift).alias("lat"), "lon")


def bathymetry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        k.alias("ord"), (F.floor(k / 155) % 70 + 400).alias("i"), (k % 155 + 270).alias("j")
    )
    return o.select(
        "ord",
        ((F.col("i") + 0.5) * 0.1).alias("lat"),
        ((F.col("j") + 0.5) * 0.1).alias("lon"),
        (-((F.col("i") * 7919 + F.col("j") * 104729 + F.col("ord")) % 2200)).cast("double").alias("depth"),
    )


def litho_points(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    conf = F.array(*[F.lit(c) for c in CONFIDENCE])
    return table(spark, sf, "supplier").select(
        s.alias("ord"),
        (40 + (s * 37 % 70) / 10.0).alias("lat"),
        (27 + (s * 53 % 150) / 10.0).alias("lon"),
        F.concat(F.lit("r"), (F.col("s_nationkey") % 6).cast("string")).alias("region"),
        F.when(s % 17 == 0, F.lit("unknown"))
        .otherwise(F.element_at(names, (F.col("s_nationkey") % 4 + 1).cast("int")))
        .alias("lithology_class"),
        (0.8 + (s * 13 % 92) / 10.0).alias("resistance"),
        F.concat(F.lit("#"), (s % 10).cast("string")).alias("color"),
        F.col("s_name").alias("description"),
        F.element_at(conf, (s % 3 + 1).cast("int")).alias("confidence"),
    )


def litho_classes(spark: SparkSession) -> DataFrame:
    return default_classes(spark)


def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    more = table(spark, sf, "supplier").select(
        (s + 100).alias("ord"),
        (40 + (s * 37 % 70) / 10.0).alias("lat"),
        (27 + (s * 53 % 150) / 10.0).alias("lon"),
        F.col("s_name").alias("name"),
    )
    return default_landmarks(spark).unionByName(more)


def step_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d, st = F.col("o_orderdate"), F.col("o_orderstatus")
    per = (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("scenario"),
            ((F.year(d) - 1995) * 12 + F.month(d) - 1).alias("step"),
        )
        .agg(
            F.count_if(st == "F").alias("f"),
            F.count_if(st == "O").alias("o"),
            F.count_if(st == "P").alias("p"),
        )
    )
    run = running(per, {"cf": F.col("f"), "co": F.col("o")}, ["scenario"], "step")
    sized = run.select(
        "scenario",
        "step",
        (F.col("step") * 0.25).alias("year"),
        (6400.0 - F.col("cf") / 10.0).alias("length_km"),
        (419695.0 - F.col("co") / 5.0).alias("area_km2"),
        F.col("p").cast("double").alias("deposited_m3"),
        (F.col("p") > F.col("o")).alias("storm_event"),
    )
    withprev = previous_row(sized, ["length_km"], ["scenario"], "step")
    eroded = F.coalesce((F.col("prev.length_km") - F.col("length_km")) * 1000.0, F.lit(0.0))
    return withprev.select(
        "scenario",
        "year",
        "step",
        "length_km",
        "area_km2",
        eroded.alias("eroded_m3"),
        "deposited_m3",
        (eroded - F.col("deposited_m3")).alias("net_change_m3"),
        "storm_event",
        (F.col("year") * 0.01).alias("sea_level_m"),
        (1.0 + 0.5 * F.sin(F.col("year") * 6.283185307179586 + 0.3)).alias("seasonal_factor"),
    )


def scenario_params(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("scenario"),
        (c % 60).cast("int").alias("target_years"),
        ((c % 130 - 5) / 10.0).alias("years_per_step"),
        ((c % 13 - 1) / 10.0).alias("storm_probability"),
        (c % 12 * 1.0).alias("storm_intensity"),
        ((c % 30 - 5) / 1000.0).alias("sea_level_rise"),
        (c % 9 - 1.0).alias("seasonal_phase"),
        (c % 2 == 0).alias("seasonality"),
    )


def sediment_input(spark: SparkSession, sf: str) -> DataFrame:
    src = F.col("src_id")
    return vertices(spark, sf).select(
        "line_id",
        "seq",
        "lat",
        "lon",
        (1.0 + F.col("seq") % 3).alias("erosion_rate"),
        F.when(src % 13 != 0, (2 + F.col("seq") % 5) / 10.0).alias("energy"),
        F.when(src % 11 != 0, 0.8 + (src * 13 % 92) / 10.0).alias("resistance"),
    )


DOC_ROWS = 512


def _doc_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Vertex texts of at most 512 consecutive vertices per document."""
    v = vertices(spark, sf)
    doc = F.floor((F.col("seq") - 1) / DOC_ROWS)
    return (
        v.withColumn("doc", doc)
        .groupBy("line_id", "doc")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "seq", F.format_string("%.2f", "lat").alias("lat"), F.format_string("%.2f", "lon").alias("lon")
                    )
                )
            ).alias("pts")
        )
        .withColumn("doc_id", F.concat_ws("-", "line_id", "doc"))
    )


def point_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Point-array documents, with the key spelling varying between documents."""
    text = F.array_join(
        F.transform(
            "pts",
            lambda p: F.when(
                F.col("line_id") % 2 == 0, F.concat(F.lit('{"Lat":'), p["lat"], F.lit(',"Lon":'), p["lon"], F.lit("}"))
            ).otherwise(F.concat(F.lit('{"lat":'), p["lat"], F.lit(',"LON":'), p["lon"], F.lit("}"))),
        ),
        ",",
    )
    return _doc_parts(spark, sf).select("doc_id", F.concat(F.lit("["), text, F.lit("]")).alias("payload"))


def geojson_documents(spark: SparkSession, sf: str) -> DataFrame:
    """GeoJSON documents of six root and geometry types, by line number."""
    n = F.size("pts")
    half = F.floor(n / 2).cast("int")

    def coords(part):
        return F.concat(
            F.lit("["),
            F.array_join(
                F.transform(part, lambda p: F.concat(F.lit("["), p["lon"], F.lit(","), p["lat"], F.lit("]"))), ","
            ),
            F.lit("]"),
        )

    docs = _doc_parts(spark, sf).select(
        "doc_id",
        (F.col("line_id") % 6).alias("kind"),
        "line_id",
        coords(F.col("pts")).alias("c"),
        coords(F.slice("pts", F.lit(1), half)).alias("a"),
        coords(F.slice("pts", half + 1, n)).alias("b"),
    )
    k = F.col("kind")
    line = F.col("line_id").cast("string")
    payload = (
        F.when(
            k == 0,
            F.concat(
                F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Name":" Line '),
                line,
                F.lit(' ","MRGID":'),
                line,
                F.lit('},"geometry":{"type":"Polygon","coordinates":['),
                F.col("c"),
                F.lit(']}},{"type":"Feature","properties":null,"geometry":null}]}'),
            ),
        )
        .when(
            k == 1,
            F.concat(
                F.lit('{"type":"Feature","properties":{"name":"Shore '),
                line,
                F.lit('"},"geometry":{"type":"LineString","coordinates":'),
                F.col("c"),
                F.lit("}}"),
            ),
        )
        .when(
            k == 2,
            F.concat(F.lit('{"type":"MultiLineString","coordinates":['), F.col("a"), F.lit(","), F.col("b"), F.lit("]}")),
        )
        .when(k == 3, F.concat(F.lit('{"type":"Polygon","coordinates":['), F.col("c"), F.lit("]}")))
        .when(
            k == 4,
            F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), F.col("a"), F.lit("],["), F.col("b"), F.lit("]]}")),
        )
        .otherwise(
            F.concat(
                F.lit('{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":'),
                F.col("a"),
                F.lit('},{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":['),
                F.col("b"),
                F.lit("]}]}]}"),
            )
        )
    )
    return docs.select("doc_id", payload.alias("payload"))
