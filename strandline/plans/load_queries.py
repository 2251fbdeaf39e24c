"""Queries of the load operation: documents to valid lines, with reasons of rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.loading import OUTSIDE, chosen_sequences, load_lines
from strandline.plans import adapters as a
from strandline.plans import source_queries  # noqa: F401  (defines shared tables)
from strandline.plans.quality_queries import LONG_KM
from strandline.plans.registry import register
from strandline.plans.sql import define, query

BOX = (43.0, 44.0, 33.0, 35.0)
define(
    "doc_ends",
    """SELECT doc_id, line_id, any_value(n) AS n,
 any_value(n)>=2 AND arg_min(lat,pos)=arg_max(lat,pos) AND arg_min(lon,pos)=arg_max(lon,pos) AS ring FROM docs GROUP BY 1,2""",
    "docs",
)


@register(
    "load_lines",
    query(
        """SELECT doc_id, CASE WHEN n<2 THEN 'not enough coordinates' ELSE coalesce(fatal,'loaded') END AS outcome,
 CASE WHEN n>=2 AND fatal IS NULL THEN removed-CAST(ring AS BIGINT) END AS removed, CASE WHEN n>=2 AND fatal IS NULL THEN warnings END AS warnings
FROM doc_ends JOIN verdict USING (line_id)""",
        "doc_ends",
        "verdict",
    ),
)
def load(spark, sf):
    """Point-array documents of all lines, loaded or rejected with a reason."""
    got = load_lines(a.point_documents(spark, sf), a.landmarks(spark, sf), long_km=LONG_KM)
    good = got.reports.select("doc_id", F.lit("loaded").alias("outcome"), "removed", "warnings")
    return good.unionByName(got.rejects.select("doc_id", F.col("reason").alias("outcome")), allowMissingColumns=True)


@register(
    "load_rejects",
    query(
        f"""SELECT doc_id, 'no coordinates inside bounds' AS reason FROM (
 SELECT doc_id, inside AND coalesce(lag(inside) OVER (PARTITION BY doc_id, sequence_id ORDER BY seq), false) AS run FROM (
  SELECT *, lat BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND lon BETWEEN {BOX[2]}e0 AND {BOX[3]}e0 AS inside FROM doc_seqs))
 GROUP BY doc_id HAVING NOT bool_or(run)""",
        "doc_seqs",
    ),
)
def load_rejects(spark, sf):
    """GeoJSON documents of all lines that have no two neighbouring coordinates in a box."""
    _, rejects = chosen_sequences(a.geojson_documents(spark, sf), BOX)
    return rejects.where(F.col("reason") == OUTSIDE).select("doc_id", "reason")
