"""Order-aware work on long tables without ever sorting a whole line in one task.

A table of ordered rows is identified by its key columns and an integer order
column.  One key may own a large share of all rows, so nothing here groups by
the key alone except aggregations that combine before the shuffle.  Order-aware
steps work on *chunks* of consecutive order values:

* ``with_neighbours`` copies the border rows of a chunk to the adjacent chunk,
  so previous and next rows come from one shuffle on (key, chunk);
* ``running`` adds running sums inside a chunk to the totals of earlier chunks;
* ``previous_row`` finds the row before, when order values have gaps;
* ``attach`` brings per-key values back to the rows, again on (key, chunk).

Lines of few rows need no chunks: ``map_whole`` hands many of them at once to a function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096
SCAN_CHUNK = 1 << 20
LINE = ("line_id",)
#: Rows of a line up to which it may come whole to one task, and rows of whole lines that a task works on at once.
WHOLE_ROWS = 1024
HELD_ROWS = 16_384


def chunk_number(order: str, width: int = CHUNK) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def with_neighbours(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = LINE,
    order: str = "seq",
    wrap: bool = False,
    width: int = CHUNK,
) -> DataFrame:
    """Add structs ``prev`` and ``next`` holding ``cols`` of the adjacent rows.

    ``order`` must be gap-free per key.  With ``wrap`` the ends of a line are
    neighbours of each other.
    """
    keys = list(keys)
    last = width - 1
    slot = F.pmod(F.col(order), F.lit(width))
    base = df.withColumn("_chunk", chunk_number(order, width))
    homes = (
        F.when(slot == 0, F.array(F.col("_chunk"), F.col("_chunk") - 1))
        .when(slot == last, F.array(F.col("_chunk"), F.col("_chunk") + 1))
        .otherwise(F.array(F.col("_chunk")))
    )
    spread = base.withColumn("_home", F.explode(homes))
    if wrap:
        row = F.struct(*[F.col(c) for c in cols])
        ends = df.groupBy(*keys).agg(
            F.min(order).alias("_lo"),
            F.max(order).alias("_hi"),
            F.min_by(row, F.col(order)).alias("_first"),
            F.max_by(row, F.col(order)).alias("_last"),
        )
        copies = ends.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(
                        (F.col("_lo") - 1).alias("o"),
                        F.floor(F.col("_lo") / F.lit(width)).alias("h"),
                        F.col("_last").alias("r"),
                    ),
                    F.struct(
                        (F.col("_hi") + 1).alias("o"),
                        F.floor(F.col("_hi") / F.lit(width)).alias("h"),
                        F.col("_first").alias("r"),
                    ),
                )
            ).alias("_e"),
        )
        carried = [c for c in cols if c != order and c not in keys]
        copies = copies.select(
            *keys,
            F.col("_e.o").cast(df.schema[order].dataType).alias(order),
            F.col("_e.h").alias("_home"),
            *[F.col(f"_e.r.{c}").alias(c) for c in carried],
        )
        spread = spread.unionByName(copies, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_home").orderBy(order)
    pack = F.struct(*[F.col(c) for c in cols])
    return (
        spread.withColumns({"prev": F.lag(pack).over(w), "next": F.lead(pack).over(w)})
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


def with_halo(
    df: DataFrame,
    reach: int,
    keys: Sequence[str] = LINE,
    order: str = "seq",
    wrap: bool = False,
    width: int = CHUNK,
) -> tuple[DataFrame, WindowSpec]:
    """Rows with copies of the ``reach`` rows on either side of every chunk, and the window over a chunk.

    Several steps to neighbours can follow each other on that window in one shuffle; rows
    with ``_own`` false are copies and are dropped at the end (as is ``_home``). ``order`` must be gap-free per
    key. With ``wrap`` the ends of a line go on at each other.
    """
    keys = list(keys)
    rows = df.withColumn("_own", F.lit(True))
    if wrap:
        at = F.col(order).cast("bigint")
        ends = df.groupBy(*keys).agg(F.min(order).alias("lo_seq"), F.max(order).alias("hi_seq"))
        met = attach(df, ends, keys, order, width=width)
        lo, n = F.col("lo_seq").cast("bigint"), (F.col("hi_seq") - F.col("lo_seq") + 1).cast("bigint")
        beyond = [lo - k for k in range(1, reach + 1)] + [lo + n + k for k in range(reach)]
        own = [F.when(lo + F.pmod(v - lo, n) == at, v) for v in beyond]
        near = F.array_compact(F.array(F.when(n > 0, at), *own))
        rows = met.withColumn("_at", F.explode(near)).withColumn("_own", F.col("_at") == at)
        rows = rows.withColumn(order, F.col("_at").cast(df.schema[order].dataType)).drop("_at", "lo_seq", "hi_seq")
    first = F.floor((F.col(order) - reach) / F.lit(width))
    last = F.floor((F.col(order) + reach) / F.lit(width))
    spread = rows.withColumn("_home", F.explode(F.sequence(first, last)))
    spread = spread.withColumn("_own", F.col("_own") & (F.col("_home") == chunk_number(order, width)))
    return spread, Window.partitionBy(*keys, "_home").orderBy(order)


def running(
    df: DataFrame,
    sums: dict[str, Column],
    keys: Sequence[str] = LINE,
    order: str = "seq",
    width: int = SCAN_CHUNK,
) -> DataFrame:
    """Add inclusive running sums along ``order`` (unique per key, gaps allowed)."""
    keys = list(keys)
    names = list(sums)
    part = df.withColumns({"_chunk": chunk_number(order, width)} | {f"_v_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = part.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    totals = part.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names]
    )
    joined = local.join(offsets, [*keys, "_chunk"])
    out = joined.withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in names})
    return out.drop("_chunk", *[f"_{p}_{n}" for n in names for p in "vro"])


def renumber(df: DataFrame, keys: Sequence[str] = LINE, order: str = "seq", start: int = 1) -> DataFrame:
    """Replace ``order`` by a gap-free number from ``start``."""
    ranked = running(df, {"_rank": F.lit(1)}, keys, order)
    return ranked.withColumn(order, (F.col("_rank") + (start - 1)).cast("int")).drop("_rank")


def previous_row(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: str,
    width: int = SCAN_CHUNK,
) -> DataFrame:
    """Add the struct ``prev`` of the row before; order values may have gaps."""
    keys = list(keys)
    pack = F.struct(*[F.col(c) for c in cols])
    part = df.withColumn("_chunk", chunk_number(order, width))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = part.withColumn("_in", F.lag(pack).over(inside))
    lasts = part.groupBy(*keys, "_chunk").agg(F.max_by(pack, F.col(order)).alias("_last"))
    earlier = lasts.select(
        *keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before")
    )
    return (
        local.join(earlier, [*keys, "_chunk"])
        .withColumn("prev", F.coalesce("_in", "_before"))
        .drop("_chunk", "_in", "_before")
    )


def attach(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str] = LINE,
    order: str = "seq",
    lo: str = "lo_seq",
    hi: str = "hi_seq",
    how: str = "inner",
    width: int = CHUNK,
) -> DataFrame:
    """Join one row per key to all its rows, spread over chunks instead of over keys.

    ``per_key`` carries the smallest and largest order value, from which its row
    is repeated once per chunk: a key with very many rows meets many tasks.
    """
    keys = list(keys)
    spans = per_key.withColumn(
        "_chunk", F.explode(F.sequence(F.floor(F.col(lo) / F.lit(width)), F.floor(F.col(hi) / F.lit(width))))
    )
    return df.withColumn("_chunk", chunk_number(order, width)).join(spans, [*keys, "_chunk"], how).drop("_chunk")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of many rows with one or few rows per key.

    A key owning a large share of ``big`` is split by adaptive execution: no
    caller needs the partitioning of the join afterwards, which is the condition
    for Spark to divide a skewed partition and repeat the small side for it.
    """
    return big.join(small, list(on), how)


def spread_out(df: DataFrame, by: Sequence[str], factor: int = 1) -> DataFrame:
    """Repartition ahead of an explosion of rows.

    Adaptive execution sizes partitions by their input, which says nothing about
    rows that each unfold into hundreds; an explicit number is left alone.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted * factor, *by)


def map_whole(
    df: DataFrame,
    keys: Sequence[str],
    work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    order: str = "seq",
    held_rows: int = HELD_ROWS,
) -> DataFrame:
    """``work`` on batches of whole short lines: rows in order, and the index of each line's first row.

    A batch ends with a line and has ``held_rows`` rows or little more, so the lines of ``df`` must be short.
    """
    keys = list(keys)

    def of_lines(held: list[pa.RecordBatch], end: bool) -> tuple[pa.RecordBatch, np.ndarray, int]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(len(batch), dtype=bool)
        new[:1] = True
        for c in keys:
            column = batch.column(c)
            same = pc.equal(column.slice(1), column.slice(0, len(batch) - 1))
            new[1:] |= ~same.fill_null(False).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        upto = len(batch) if end else int(first[-1])
        return batch, first[first < upto], upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(len(h) for h in held) < held_rows:
                continue
            whole, first, upto = of_lines(held, False)
            if upto:
                yield from work(whole.slice(0, upto), first)
            held = [whole.slice(upto)]
        if held:
            whole, first, _ = of_lines(held, True)
            yield from work(whole, first)

    return spread_out(df, keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) to every row.

    A scalar subquery: evaluated once, no join.
    """
    value = row.select(F.struct(*row.columns).alias("r")).scalar()
    return df.withColumn("_one", value).select(*df.columns, "_one.*")
