"""Training-data pipeline over ``documents``: language, near duplicates, benchmark leaks, secrets, mix.

Every stage takes what its predecessor kept and returns the columns of ``documents``;
the last one adds each document's place in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, jaccard, langid, mixing, secrets
from strandline.llm.common import table
from strandline.session import ship_package, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that have no language (no text or not a letter); lang stays as labelled, or is filled.

    A low cosine alone rejects nothing: a clean text of one word has one, too.
    """
    ship_package(spark)
    profiles = langid.fit(docs)
    found = langid.predict(docs, profiles)
    if not profiles.languages:  # nothing was learned, so nothing is judged
        return found.select(*docs.columns)
    found = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates stays: five-word shingles, Jaccard 0.8."""
    ship_package(spark)
    return jaccard.kept(docs, width=5, num=8, den=10).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are half benchmark or more go."""
    ship_package(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    ship_package(spark)
    found = secrets.scan(docs, redact="[SECRET]")
    n_chars = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the place of every document in the mix of sources."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets),
    ("mix_sources", mix_sources),
]

#: Language ID, zstandard and the automaton have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
