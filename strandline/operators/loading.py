"""Loading lines from documents, with the reasons of those that cannot be loaded.

One pass takes every document through reading, clipping, choice of its longest sequence,
coordinate rules, removal of repeated vertices, order repair and the crossing test. A
stage hands on what is good and adds what is not to one table of rejects, so each document
ends in exactly one of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.lines import renumber
from strandline.operators.quality import (
    LONG_SEGMENT_KM, clip_runs, close_again, coordinate_violations, drop_duplicate_vertices, duplicate_counts, longest_sequence,
    open_rings, verdicts,
)
from strandline.operators.repair import repair_order
from strandline.session import stored
from strandline.sources.documents import geojson_vertices, parse_geojson, parse_points, rejected, rejected_points

DOC = ["doc_id"]
NO_BOX = (0.0, 0.0, 0.0, 0.0)
# Reasons of rejects, by stage.
UNREADABLE, OUTSIDE, SHORT, FEW = "read", "no coordinates inside bounds", "not enough coordinates", "fewer than 2 points"


@dataclass
class Loaded:
    """``lines`` (doc_id, seq, lat, lon), ``reports`` (doc_id, removed, reordered, fixes, warnings) and ``rejects`` (doc_id, stage, reason)."""

    lines: DataFrame
    reports: DataFrame
    rejects: DataFrame


def read_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sequence_id, seq, lat, lon) of point arrays and GeoJSON documents, and their rejects."""
    head = F.substring(F.trim("payload"), 1, 1)
    arrays, objects = docs.where(head == "["), docs.where(head == "{")
    # read twice, for vertices and for rejects
    parsed = stored(parse_geojson(objects).select("doc_id", "reason", F.when(F.col("reason").isNull(), F.col("sequences")).alias("sequences")), "parsed")
    points = parse_points(arrays).select("doc_id", F.lit(0).alias("sequence_id"), "seq", "lat", "lon")
    other = docs.where(F.coalesce(~head.isin("[", "{"), F.lit(True)))
    other = other.select("doc_id", F.when(F.coalesce(F.length(F.trim("payload")), F.lit(0)) == 0, "empty payload").otherwise("unsupported payload").alias("reason"))
    return points.unionByName(geojson_vertices(parsed)), rejected(parsed).unionByName(rejected_points(arrays)).unionByName(other)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("doc_id"), "doc_id", "left_anti")


def chosen_sequences(
    docs: DataFrame, box: tuple[float, float, float, float] = NO_BOX
) -> tuple[DataFrame, DataFrame]:
    """Longest clipped sequence of each document, open, with the flag ``closed_6dp``, and the rejects so far.

    Bounds clip GeoJSON only; a point array is taken as it is.
    """
    docs = stored(docs.select("doc_id", "payload"), "documents")
    rows, unread = read_lines(docs)
    rows = stored(rows, "sequences")
    is_array = stored(docs.where(F.trim("payload").startswith("[")).select("doc_id"), "arrays")
    clipped = rows
    if any(box):
        runs = clip_runs(rows.join(is_array, "doc_id", "left_anti"), box, [*DOC, "sequence_id"])
        runs = runs.withColumn("sequence_id", F.col("sequence_id").cast("bigint") * (1 << 32) + F.col("run_id")).drop("run_id")
        renumbered = renumber(stored(runs, "runs"), [*DOC, "sequence_id"])
        clipped = stored(rows.join(is_array, "doc_id", "left_semi").unionByName(renumbered), "clipped")
    best = longest_sequence(clipped, DOC, "sequence_id")
    line = stored(clipped.join(best.select(*DOC, "sequence_id"), [*DOC, "sequence_id"]).drop("sequence_id"), "lines")
    opened = stored(open_rings(line, DOC), "opened")
    sizes = docs.select("doc_id").join(opened.groupBy(*DOC).agg(F.count("*").alias("n")), "doc_id", "left")
    sizes = sizes.join(is_array.withColumn("array", F.lit(True)), "doc_id", "left").join(line.select("doc_id").distinct().withColumn("any", F.lit(True)), "doc_id", "left")
    short = without(sizes, unread).where(F.coalesce("n", F.lit(0)) < 2)
    reason = F.when(F.col("array") | F.col("any"), SHORT).otherwise(F.lit(OUTSIDE if any(box) else SHORT))
    rejects = unread.withColumn("stage", F.lit(UNREADABLE)).unionByName(short.select("doc_id", reason.alias("reason"), F.lit("choose").alias("stage")))
    return without(opened, short), rejects


def load_lines(
    docs: DataFrame,
    landmarks: DataFrame,
    box: tuple[float, float, float, float] = NO_BOX,
    long_km: float = LONG_SEGMENT_KM,
) -> Loaded:
    """Documents (doc_id, payload; ids are unique) as valid lines; rings come back closed.

    Rejects, in the order of the stages: a document that cannot be read (with the
    reader's reason), one without coordinates inside the bounds or with fewer than two, a
    coordinate out of range, fewer than two distinct vertices, and a line that crosses itself
    in its best order.
    """
    line, rejects = chosen_sequences(docs, box)
    range_ = coordinate_violations(line, DOC)
    range_ = range_.select("doc_id", F.concat(F.lit("invalid "), F.col("rule")).alias("reason"), F.lit("range").alias("stage"))
    good = stored(without(line, range_), "in-range")
    counts = duplicate_counts(good.drop("closed_6dp"), DOC)
    few = counts.where("kept < 2").select("doc_id", F.lit(FEW).alias("reason"), F.lit("order").alias("stage"))
    good = stored(without(good, few), "distinct")
    flags = good.groupBy(*DOC).agg(F.max("closed_6dp").alias("closed_6dp"))
    bare = good.drop("closed_6dp")
    ordered = stored(repair_order(renumber(drop_duplicate_vertices(bare, DOC), DOC), DOC, long_km), "ordered")
    report = verdicts(bare, ordered, landmarks, DOC, long_km)
    crossed = report.where("fatal IS NOT NULL").select("doc_id", F.col("fatal").alias("reason"), F.lit("order").alias("stage"))
    crossed = stored(crossed, "crossed")
    final = without(ordered, crossed).select("doc_id", "seq", "lat", "lon").join(flags, "doc_id")
    rejects = rejects.unionByName(range_).unionByName(few).unionByName(crossed).select("doc_id", "stage", "reason")
    reports = report.where("fatal IS NULL").select("doc_id", "removed", "reordered", "fixes", "warnings")
    return Loaded(close_again(final, DOC).select("doc_id", "seq", "lat", "lon"), reports, rejects)
