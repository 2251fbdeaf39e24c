"""Helpers shared by the operators: tables, tokens, hashes and components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows whose texts a task turns into Python objects at once.
ROWS = 500


def lean(run, rows: int | None = None):
    """``run`` (for mapInArrow), given ``rows`` rows at a time; at its end the worker gives its free memory back.

    A worker serves the tasks of later stages, too, and would keep the largest amount it ever held.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
                    yield batch.slice(at, rows)

        try:
            yield from run(parts())
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return held


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


#: A random word for every byte at every of 64 places; a word's hash is the mixed sum of its bytes' entries.
PLACES = 64
ENTRIES = mix64(np.arange(256 * PLACES, dtype=np.uint64) + GOLDEN)
BLANK = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data`` between bytes 20 and 09 to 0D, without a Python object per word."""
    buffer = np.frombuffer(data.translate(BLANK), dtype=np.uint8)
    at = np.flatnonzero(buffer != 32)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    entry = ENTRIES[buffer[at].astype(np.int64) * PLACES + place % PLACES]
    if sizes.max() > PLACES:  # the same places of later stretches count for more
        entry = entry * (MIX_1 * (place // PLACES).astype(np.uint64) + np.uint64(1))
    return mix64(np.add.reduceat(entry, first) + GOLDEN * sizes.astype(np.uint64))


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for i in range(width):
            out = mix64((out + GOLDEN) ^ hashes[i : i + n])
    return out


def contracted(links: DataFrame, most: int = 200_000) -> DataFrame:
    """Links (u > v) that connect the same ids: within a task, ``most`` at a time become stars around their smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := above.get(top, top)) != top:
                top = up
            while x != top:
                above[x], x = top, above.get(x, x)
            return top

        def stars() -> pa.RecordBatch:
            u = list(above)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([root(x) for x in u], pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                p, q = root(u), root(v)
                if p != q:
                    above[max(p, q)] = min(p, q)
            if len(above) > most:
                yield stars()
                above.clear()
        if above:
            yield stars()

    return links.mapInArrow(run, "u long, v long")


def are_stars(edge: DataFrame) -> bool:
    """Whether every id of ``edge`` (distinct u > v) either has one smaller neighbour or is the smallest of its own."""
    roles = edge.select(F.col("u").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    roles = roles.union(edge.select("v", F.lit(0), F.lit(1)))
    roles = roles.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return roles.where("ups > 1 OR (ups = 1 AND downs = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): id, component_id (its smallest id).

    Tasks first contract what they hold; then alternating large and small stars. Every
    round pre-aggregates the smallest neighbour of each vertex and joins it back to the
    links; the tables of a round are written to the shared folder, so that the planner
    knows their size and a vertex with very many links is split as a skewed join. Rounds
    end when all links are stars. Null ids and self links are ignored.
    """
    edge = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edge = contracted(edge.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edge = stored(contracted(edge.distinct()).distinct(), "links")
    while not are_stars(edge):
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edge.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        edge.select("v", F.col("v").alias("component_id")).distinct()
    )


#: Bytes of text that a task turns into arrays at once; longer texts come in segments.
SEGMENT = 2_000_000
NOT_BLANK = re.compile(rb"[^ ]")


def segments(text: bytes, overlap: bool, most: int | None = None) -> Iterator[tuple[bytes, bool]]:
    """(stretch, whether its first word was seen) of ``text``: about ``most`` bytes each, cut at white space, never in a word.

    With ``overlap`` a stretch begins with the last word of the one before. A longer word makes
    a longer stretch. At least one stretch, also of an empty text.
    """
    most = most or SEGMENT
    if len(text) <= most:
        yield text, False
        return
    blank = text.translate(BLANK)
    at, seen, again = 0, -1, False  # the next stretch begins at ``at``, its new words after ``seen``
    while len(text) - at > most:
        cut = blank.rfind(b" ", seen + 1, at + most)
        if cut <= at:
            cut = blank.find(b" ", max(seen + 1, at + most))
        if cut < 0:
            break
        end = at + len(blank[at:cut].rstrip(b" "))
        if overlap and again and end <= seen:  # blanks only: on to the end of the next word
            word = NOT_BLANK.search(blank, cut)
            cut = blank.find(b" ", word.start()) if word else -1
            if cut < 0:
                break
            end = cut
        yield text[at:cut], again
        again = overlap and end > at
        at, seen = (max(blank.rfind(b" ", at, end) + 1, at), end) if again else (cut, cut)
    yield text[at:], again


def numbered(rows: DataFrame, order: list[Column], column: str, name: str = "numbered") -> DataFrame:
    """``rows`` with their number (from 0) in the order of ``order`` over the whole table, in ``column``.

    Rows are sorted in ranges, so no task holds more than a range; the ranges are written
    to the shared folder with the number of every row in its own, and rows of earlier
    ranges are added from one count per range. Rows that tie in ``order`` are told apart
    by where they were read, so equal rows spread over ranges, too.
    """
    # written first, as Spark reads the rows once for the borders of the ranges and once to deal them
    ties = stored(rows.withColumn("_nb_tie", F.monotonically_increasing_id()), name)
    keys = [*order, F.col("_nb_tie")]
    sorted_ = ties.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_nb_tie")
    # the range's number in the upper bits, the row's number in its range in the lower 33
    ranges = stored(sorted_.withColumn("_nb_at", F.monotonically_increasing_id()), name)
    part = F.call_function("shiftright", F.col("_nb_at"), F.lit(33))
    counts = ranges.groupBy(part.alias("_nb_part")).agg(F.count("*").alias("_nb_n"))
    before = Window.orderBy("_nb_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("_nb_part", F.coalesce(F.sum("_nb_n").over(before), F.lit(0)).alias("_nb_start"))
    starts = stored(starts, f"{name}-ranges")
    found = ranges.withColumn("_nb_part", part).join(starts, "_nb_part")
    at = F.col("_nb_start") + F.col("_nb_at").bitwiseAND(F.lit((1 << 33) - 1))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], at.alias(column))
