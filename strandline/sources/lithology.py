"""Rock-type profiles (S4) and the built-in default profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schemas import LITHO_PROFILE

# Fixed values of the default profile, used when no profile is supplied.
DEFAULT_BOUNDS = {"min_lat": 40.0, "max_lat": 47.0, "min_lon": 27.0, "max_lon": 42.0}
DEFAULT_POINTS = [
    (45.0, 34.5, "crimea", "limestone", 4.0, "#6b6b6b", "Crimean limestone", "low"),
    (41.5, 40.0, "turkey", "volcanic", 6.5, "#4a4a4a", "Pontic volcanic", "low"),
    (42.5, 28.0, "bulgaria", "limestone", 4.0, "#6b6b6b", "Bulgarian limestone", "low"),
    (44.5, 29.0, "romania", "clay", 1.2, "#c4a484", "Romanian clay", "low"),
    (42.5, 41.5, "georgia", "sedimentary", 2.5, "#8b8b8b", "Caucasus sedimentary", "low"),
]
DEFAULT_CLASSES = [
    ("limestone", 4.0, "#6b6b6b", "Sarmatian/Neogene limestone"),
    ("volcanic", 6.5, "#4a4a4a", "Volcanic rocks"),
    ("clay", 1.2, "#c4a484", "Clayey formations"),
    ("sedimentary", 2.5, "#8b8b8b", "Sedimentary rocks"),
]
DEFAULT_BASELINES = [
    ("very_soft", 0.8, 1.4, 5.0, 12.0, 7.5, "Soft sediments — very rapid erosion"),
    ("soft", 1.5, 2.4, 2.0, 5.0, 3.5, "Consolidated sediments — rapid erosion"),
    ("medium", 2.5, 3.9, 1.0, 3.0, 2.0, "Sandstone, conglomerate — significant erosion"),
    ("medium_hard", 4.0, 5.9, 0.5, 2.0, 1.2, "Limestone, metamorphic — noticeable erosion"),
    ("hard", 6.0, 7.9, 0.3, 1.0, 0.6, "Volcanic rocks — moderate erosion"),
    ("very_hard", 8.0, 10.0, 0.1, 0.5, 0.3, "Serpentinite, granite — very slow erosion"),
]


def default_points(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(DEFAULT_POINTS)]
    return spark.createDataFrame(
        rows,
        "ord BIGINT, lat DOUBLE, lon DOUBLE, region STRING, lithology_class STRING, resistance DOUBLE, "
        "color STRING, description STRING, confidence STRING",
    )


def default_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DEFAULT_CLASSES, "class STRING, resistance DOUBLE, color STRING, description STRING"
    )


def default_baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DEFAULT_BASELINES,
        "name STRING, resistance_min DOUBLE, resistance_max DOUBLE, erosion_min DOUBLE, erosion_max DOUBLE, "
        "erosion_mean DOUBLE, description STRING",
    )


def parse_profiles(docs: DataFrame) -> DataFrame:
    """Nested profile per document (``doc_id``, ``payload``); see ``rejected_profiles`` for those not ``readable``."""
    parsed = docs.withColumn("p", F.from_json("payload", LITHO_PROFILE))
    return parsed.select("doc_id", "p.*").withColumn(
        "readable", F.coalesce(F.length(F.trim(F.col("metadata.name"))) > 0, F.lit(False))
    )


def rejected_profiles(docs: DataFrame) -> DataFrame:
    """Profile documents that cannot be used, with the reason; the others are ``readable``."""
    body, p = F.trim("payload"), F.from_json("payload", LITHO_PROFILE)
    points, classes = p["points"], p["classes"]
    reason = (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, "empty payload")
        .when(F.try_parse_json(body).isNull(), "unreadable json")
        .when(~body.startswith("{"), "no profile")
        .when(F.coalesce(F.length(F.trim(p["metadata"]["name"])), F.lit(0)) == 0, "no name")
        .when(F.coalesce(F.size(points), F.lit(0)) <= 0, "no points")
        .when(F.coalesce(F.size(classes), F.lit(0)) <= 0, "no classes")
    )
    return docs.select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def profile_points(profiles: DataFrame) -> DataFrame:
    return profiles.select("doc_id", F.posexplode("points").alias("ord", "p")).select("doc_id", "ord", "p.*")


def profile_classes(profiles: DataFrame) -> DataFrame:
    return profiles.select("doc_id", F.explode("classes").alias("class", "c")).select("doc_id", "class", "c.*")


def profile_baselines(profiles: DataFrame) -> DataFrame:
    return profiles.select("doc_id", F.explode("erosion_baselines").alias("name", "b")).select("doc_id", "name", "b.*")


def profile_metadata(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "doc_id",
        "metadata.*",
        F.size("points").alias("n_points"),
        F.size("classes").alias("n_classes"),
        F.size("erosion_baselines").alias("n_baselines"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return parse_profiles(text.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("payload")))
