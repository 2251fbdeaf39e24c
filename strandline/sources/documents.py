"""Point-array and GeoJSON documents (S1, S2), depth samples (S3), inspection.

Input is a table ``doc_id, payload`` (``read_documents`` makes one).  A document
is parsed inside its row; coordinates are then exploded to vertices.  Documents
that cannot be read appear in ``rejected`` with a reason, never silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.geometry import line_summary
from strandline.operators.quality import longest_sequence

# Types of coordinates that hold numbers only.
ORDINATES = r"^(ARRAY<)+(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|VOID|DECIMAL\(.*\))>+$"
DEPTH_KEYS = ("lat", "lon", "depth")
GEOJSON_TYPES = [
    "featurecollection", "feature", "polygon", "multipolygon", "linestring", "multilinestring", "geometrycollection",
]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("payload"))


def _field(entry_map: Column, name: str) -> Column:
    """Number under any spelling of a key; the last spelling wins, a missing key reads as zero."""
    hit = F.filter(F.map_entries(entry_map), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.try_variant_get(F.try_element_at(hit, F.lit(-1))["value"], "$", "double"), F.lit(0.0))


def _entries(body: Column) -> Column:
    """An array of objects with members of any kind; null if the text is something else."""
    return F.from_json(body, "array<map<string,variant>>")


def _not_numeric(entries: Column, names: tuple[str, ...]) -> Column:
    """Some entry has a value under one of the names that is neither a number nor null."""
    number = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|VOID|DECIMAL.*)$"
    return F.exists(
        entries,
        lambda m: F.exists(
            F.map_entries(m), lambda e: F.lower(e["key"]).isin(*names) & ~F.schema_of_variant(e["value"]).rlike(number)
        ),
    )


def parse_points(docs: DataFrame) -> DataFrame:
    """Point arrays with any spelling of the keys and any other members (S1); missing keys read as zero."""
    parsed = docs.withColumn("_m", _entries(F.trim("payload")))
    readable = F.trim("payload").startswith("[") & ~F.coalesce(_not_numeric(F.col("_m"), ("lat", "lon")), F.lit(False))
    rows = parsed.where(readable).select("doc_id", F.posexplode("_m").alias("pos", "m"))
    return rows.select(
        "doc_id", (F.col("pos") + 1).alias("seq"), _field(F.col("m"), "lat").alias("lat"), _field(F.col("m"), "lon").alias("lon")
    )


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _sequences(geometry: Column) -> Column:
    """Coordinate sequences of one simple geometry; null when it cannot be read."""
    kind = F.lower(_text(geometry, "$.type"))
    path = "$.coordinates"
    return (
        F.when(kind == "linestring", F.array(F.try_variant_get(geometry, path, "array<array<double>>")))
        .when(kind.isin("multilinestring", "polygon"), F.try_variant_get(geometry, path, "array<array<array<double>>>"))
        .when(kind == "multipolygon", F.flatten(F.try_variant_get(geometry, path, "array<array<array<array<double>>>>")))
    )


def _is_collection(geometry: Column) -> Column:
    return F.coalesce(F.lower(_text(geometry, "$.type")) == "geometrycollection", F.lit(False))


def _nesting(payload: Column) -> Column:
    """How deep objects are nested in a text with geometry collections within each other; else 1.

    Strings are taken out first, as they may hold braces.
    """
    several = F.regexp_count(F.lower(payload), F.lit("geometrycollection")) > 1
    bare = F.regexp_replace(payload, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(1).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.when(several, F.aggregate(braces, start, step)["most"]).otherwise(F.lit(1))


def parse_geojson(docs: DataFrame) -> DataFrame:
    """Parsed documents: root type, features, sequences and the reason of a rejection."""
    v = docs.withColumn("v", F.try_parse_json(F.trim("payload")))
    v = v.withColumn("root_type", _text(F.col("v"), "$.type")).withColumn("_kind", F.lower("root_type"))
    none = F.array().cast("array<variant>")
    features = F.coalesce(F.try_variant_get(F.col("v"), "$.features", "array<variant>"), none)
    v = v.withColumn("features", F.when(F.col("_kind") == "featurecollection", features).otherwise(none))

    def geometry_of(feature: Column) -> Column:
        return F.try_variant_get(feature, "$.geometry", "variant")

    def present(g: Column) -> Column:
        return g.isNotNull() & ~F.is_variant_null(g)

    roots = (
        F.when(
            F.col("_kind") == "featurecollection",
            F.filter(F.transform("features", geometry_of), present),
        )
        .when(F.col("_kind") == "feature", F.filter(F.array(geometry_of(F.col("v"))), present))
        .otherwise(F.array(F.col("v")))
    )
    v = v.withColumn("_roots", roots)

    def unfold(level: Column, _: Column) -> Column:
        return F.flatten(
            F.transform(
                level,
                lambda g: F.when(
                    _is_collection(g), F.coalesce(F.try_variant_get(g, "$.geometries", "array<variant>"), none)
                ).otherwise(F.array(g)),
            )
        )

    # one level of collections at a time, as many as the document has
    flat = F.aggregate(F.sequence(F.lit(1), _nesting(F.col("payload"))), F.col("_roots"), unfold)
    v = v.withColumn("_flat", flat)
    coordinates = F.filter(F.transform("_flat", lambda g: F.try_variant_get(g, "$.coordinates", "variant")), lambda c: c.isNotNull())
    typed = ~F.exists(coordinates, lambda c: ~F.schema_of_variant(c).rlike(ORDINATES))
    v = v.withColumn("sequences", F.flatten(F.transform("_flat", _sequences)))
    short = F.exists("sequences", lambda s: F.exists(s, lambda p: F.coalesce(F.size(p) < 2, F.lit(True))))
    reason = (
        F.when(F.length(F.trim("payload")) == 0, "empty payload")
        .when(F.col("v").isNull(), "unreadable json")
        .when(F.col("_kind").isNull() | ~F.col("_kind").isin(GEOJSON_TYPES), "unsupported root type")
        .when((F.col("_kind") == "feature") & (F.size("_roots") == 0), "feature without geometry")
        .when(~typed | F.col("sequences").isNull(), "unsupported or unreadable geometry")
        .when(F.size("sequences") == 0, "no geometry")
        .when(short, "position with fewer than two ordinates")
    )
    return v.withColumn("reason", reason).drop("_flat", "_roots")


def geojson_vertices(parsed: DataFrame) -> DataFrame:
    """Vertices of readable documents (S2); extra ordinates are ignored."""
    good = parsed.where(F.col("reason").isNull())
    seqs = good.select("doc_id", F.posexplode("sequences").alias("sequence_id", "s"))
    rows = seqs.select("doc_id", "sequence_id", F.posexplode("s").alias("pos", "p"))
    return rows.select(
        "doc_id", "sequence_id", (F.col("pos") + 1).alias("seq"), F.get("p", 1).alias("lat"), F.get("p", 0).alias("lon")
    )


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("doc_id", "reason")


def rejected_points(docs: DataFrame) -> DataFrame:
    """Point-array documents that cannot be read."""
    body = F.trim("payload")
    reason = (
        F.when(F.length(body) == 0, "empty payload")
        .when(~body.startswith("["), "unsupported payload")
        .when(_entries(body).isNull() | _not_numeric(_entries(body), ("lat", "lon")), "unreadable point array")
    )
    return docs.select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def parse_bathymetry(docs: DataFrame) -> DataFrame:
    """Depth samples in input order, with any spelling of the keys (S3); missing keys read as zero."""
    parsed = docs.withColumn("_m", _entries(F.trim("payload")))
    readable = ~F.coalesce(_not_numeric(F.col("_m"), DEPTH_KEYS), F.lit(False))
    rows = parsed.where(readable).select("doc_id", F.posexplode("_m").alias("ord", "m"))
    return rows.select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), *[_field(F.col("m"), c).alias(c) for c in DEPTH_KEYS]
    )


def rejected_bathymetry(docs: DataFrame) -> DataFrame:
    """Depth documents that hold no samples, with the reason."""
    body = F.trim("payload")
    reason = (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, "empty payload")
        .when(_entries(body).isNull() | _not_numeric(_entries(body), DEPTH_KEYS), "unreadable depth samples")
        .when(F.size(_entries(body)) == 0, "no depth samples")
    )
    return docs.select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def property_text(properties: Column, key: str) -> Column:
    """Text of a property found without regard to case (S8); numbers lose a zero fraction."""
    entries = F.map_entries(F.try_variant_get(properties, "$", "map<string,variant>"))
    value = F.get(F.filter(entries, lambda e: F.lower(e["key"]) == key.lower()), 0)["value"]
    number = F.try_variant_get(value, "$", "double")
    is_text = F.schema_of_variant(value) == "STRING"
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.coalesce(
        F.when(is_text | number.isNull(), F.trim(F.try_variant_get(value, "$", "string")))
        .when(whole, number.cast("bigint").cast("string"))
        .otherwise(number.cast("string")),
        F.lit(""),
    )


def inspect_geojson(docs: DataFrame) -> DataFrame:
    """One row of metadata per readable document."""
    parsed = parse_geojson(docs).where(F.col("reason").isNull())
    is_fc, is_feature = F.col("_kind") == "featurecollection", F.col("_kind") == "feature"

    def named(key: str) -> Column:
        own = F.when(
            is_fc | is_feature, property_text(F.try_variant_get(F.col("v"), "$.properties", "variant"), key)
        ).otherwise(F.lit(""))
        of_features = F.filter(
            F.transform("features", lambda f: property_text(F.try_variant_get(f, "$.properties", "variant"), key)),
            lambda t: t != "",
        )
        return F.coalesce(F.nullif(own, F.lit("")), F.get(of_features, 0), F.lit(""))

    feature_types = F.array_compact(F.transform("features", lambda f: F.try_variant_get(f, "$.geometry.type", "string")))
    types = (
        F.when(is_fc, feature_types)
        .when(is_feature, F.array_compact(F.array(F.try_variant_get(F.col("v"), "$.geometry.type", "string"))))
        .otherwise(F.array("root_type"))
    )
    heads = parsed.select(
        "doc_id",
        F.lit("GeoJSON").alias("format"),
        "root_type",
        F.when(is_fc, F.size("features")).otherwise(F.lit(1)).alias("feature_count"),
        F.array_sort(F.array_distinct(types)).alias("geometry_types"),
        named("name").alias("name"),
        named("mrgid").alias("region_id"),
        F.octet_length(F.trim("payload")).alias("payload_bytes"),
    )
    vertices = geojson_vertices(parsed)
    best = longest_sequence(vertices, ["doc_id"], "sequence_id").select("doc_id", "sequence_id")
    measured = line_summary(vertices, ["doc_id", "sequence_id"]).join(best, ["doc_id", "sequence_id"])
    return heads.join(
        measured.select("doc_id", "points", "min_lat", "max_lat", "min_lon", "max_lon"), "doc_id"
    )


def inspect_points(docs: DataFrame) -> DataFrame:
    """Metadata of point-array documents."""
    bounds = parse_points(docs).groupBy("doc_id").agg(
        F.count("*").alias("points"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )
    heads = docs.select(
        "doc_id", F.lit("point-array").alias("format"), F.lit("array").alias("root_type"), F.lit(1).alias("feature_count"),
        F.array(F.lit("PointArray")).alias("geometry_types"), F.lit("").alias("name"), F.lit("").alias("region_id"),
        F.octet_length(F.trim("payload")).alias("payload_bytes"),
    )
    return heads.join(bounds, "doc_id")
