"""Step-metrics CSV files, read by column name.

Files of one call may have their columns in any order, lack optional ones and carry
others. The header of every file is found in one scan of the first blocks; files that
share a header are read together by Spark's CSV reader under that header's names, so
the number of reads is the number of different headers. What one record cannot give is a reject
with its reason, not a failed job and not a row of nulls.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.schemas import STEP_METRICS

REQUIRED = ["step", "length_km"]
RECORD = "_record"


def file_path(path: Column) -> Column:
    """Plain text of ``_metadata.file_path``, which is percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def scenario_of(path: Column) -> Column:
    """File stem."""
    return F.regexp_extract(path, "([^/]+?)(\\.[^./]*)?$", 1)


def scenario_folder(path: Column) -> Column:
    """Value of the ``scenario=`` folder, as partitioned tables write it."""
    return F.regexp_extract(path, "scenario=([^/]*)/", 1)


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, header: the first line that is not blank of every file; files without one are left out."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    first = lines.where((F.col("block") == 0) & (F.trim("value") != ""))
    return first.groupBy("path").agg(F.min(F.struct("at", "value")).alias("f")).select("path", F.col("f.value").alias("header"))


def column_names(header: str) -> list[str]:
    names = [n.strip().lstrip("\ufeff").strip() for n in next(csv.reader([header]), [])]
    return [n if n and n not in names[:i] else f"_unnamed_{i}" for i, n in enumerate(names)]


def _records(spark: SparkSession, paths: str | list[str], required: list[str], scenario, wanted: list[str]) -> DataFrame:
    """Every record: scenario, path, the ``wanted`` columns typed, the record's text if it is broken, and a reason for a reject."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in headers(spark, paths).collect():  # a row per file, as the driver's own list of files
        groups.setdefault(tuple(column_names(row["header"])), []).append(unquote(row["path"]))
    types = {f.name: f.dataType.simpleString() for f in STEP_METRICS}
    parts = []
    for names, files in sorted(groups.items()):
        missing = [c for c in required if c not in names]
        if missing:
            raise ValueError(f"missing required columns: {missing} in {sorted(files)[:3]}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, RECORD)])
        raw = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", RECORD).csv(sorted(files))
        here = [c for c in wanted if c in names]
        reason = F.when(F.col(RECORD).isNotNull(), "wrong number of fields")
        for c in here:
            text, value = F.trim(F.col(f"`{c}`")), F.trim(F.col(f"`{c}`")).try_cast(types[c])
            bad = (text != "") & value.isNull()
            if c in required:
                reason = reason.when(F.coalesce(text, F.lit("")) == "", f"no {c}")
            reason = reason.when(bad, f"{c} is no {types[c]}")
        path = file_path(F.col("_metadata.file_path"))
        values = [
            (F.trim(F.col(f"`{c}`")).try_cast(types[c]) if c in here else F.lit(None).cast(types[c])).alias(c) for c in wanted
        ]
        shown = F.coalesce(F.col(RECORD), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
        parts.append(raw.select(scenario(path).alias("scenario"), path.alias("path"), *values, shown.alias("record"), reason.alias("reason")))
    if not parts:
        return spark.createDataFrame([], f"scenario string, path string, {', '.join(f'{c} {types[c]}' for c in wanted)}, record string, reason string")
    return reduce(DataFrame.unionByName, parts)


def read_step_metrics(
    spark: SparkSession,
    paths: str | list[str],
    required: list[str] | None = None,
    scenario=scenario_of,
    columns: list[str] | None = None,
) -> DataFrame:
    """Good records of one or many files, folders or globs; absent optional columns are null.

    A file without a ``required`` column (step and length_km) is an error. ``scenario`` makes
    the scenario from the path, the file stem unless told otherwise. ``columns`` limits the
    columns that are typed and checked; required ones are always among them.
    """
    required = required or REQUIRED
    wanted = [f.name for f in STEP_METRICS if columns is None or f.name in columns or f.name in required]
    return _records(spark, paths, required, scenario, wanted).where("reason IS NULL").select(*wanted, "scenario")


def step_metrics_rejects(
    spark: SparkSession, paths: str | list[str], required: list[str] | None = None, scenario=scenario_of
) -> DataFrame:
    """scenario, path, record and reason of every record that is not read."""
    wanted = [f.name for f in STEP_METRICS]
    rows = _records(spark, paths, required or REQUIRED, scenario, wanted)
    return rows.where("reason IS NOT NULL").select("scenario", "path", "record", "reason")

