"""Mixing sources to target weights by Pfair scheduling (operator 1).

Every source is cut into blocks of ``block_docs`` documents. With weight
``w = parts / period`` its k-th block (from 0) is released at slot
``floor(k / w)`` and due at slot ``ceil((k + 1) / w)``; one block is served per
slot, the released block with the earliest deadline first (ties: the source that
sorts first). The weights sum to one, so every block is served in its window and
after any number of slots each source is less than one block away from its target.

The weights are whole parts of a bounded period, and at the end of a period
every source has had exactly its parts; the schedule repeats from there. Hence one
period is scheduled, from the small table of sources, and the slot of any block of
any source is arithmetic on its number. Nothing that grows with the documents is
ordered globally: a document's number within its source comes from counts of hash
ranges, about the square root of the rows each, so that a source that owns a
third of all rows is spread like the rest.

When a source runs out, its later slots stay idle (the others keep their slots, and
their deviation bound); ``position`` counts documents, without the idle slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stored

OWN = ("mix_source", "mix_index", "mix_block", "mix_release", "mix_deadline", "mix_slot", "position")


def schedule(weights: DataFrame, resolution: int = 1000) -> DataFrame:
    """One row: the period and, for every source, its parts and slots.

    ``weights``: mix_source, mix_weight (long > 0), mix_rows. Parts are
    ``resolution * weight / total`` rounded, one at least; the period is their sum.
    More sources than ``resolution`` are an error, which bounds the row.
    """
    rows = weights.select(F.struct("mix_source", "mix_weight", "mix_rows").alias("s")).agg(
        F.array_sort(F.collect_list("s")).alias("s"), F.sum("s.mix_weight").alias("total")
    )
    rows = rows.where(
        F.when(F.size("s") <= resolution, True).otherwise(
            F.raise_error(F.lit("more sources than the resolution of the weights")).cast("boolean")
        )
    )
    # DECIMAL keeps resolution * weight exact; round half up
    rows = rows.selectExpr(
        "transform(s, x -> x.mix_source) AS names",
        "transform(s, x -> x.mix_rows) AS sizes",
        "transform(s, x -> greatest(1, CAST((CAST(x.mix_weight AS DECIMAL(20,0)) * "
        f"{2 * resolution} + total) div (2 * total) AS INT))) AS parts",
    ).selectExpr("*", "aggregate(parts, 0, (a, p) -> a + p) AS period")
    # state: blocks served per source, the chosen source of each slot, counts before each slot
    return rows.selectExpr(
        "*",
        """aggregate(sequence(0, period - 1),
             named_struct('served', transform(parts, p -> 0), 'pick', CAST(array() AS ARRAY<INT>),
                          'before', CAST(array() AS ARRAY<ARRAY<INT>>)),
             (a, t) -> transform(array(
                 array_min(filter(transform(parts, (p, i) -> named_struct(
                     'due', (CAST(a.served[i] + 1 AS BIGINT) * period + p - 1) div p,
                     'i', i,
                     'free', CAST(a.served[i] AS BIGINT) * period div p <= t)), x -> x.free)).i),
                 j -> named_struct(
                     'served', transform(a.served, (c, i) -> c + IF(i = j, 1, 0)),
                     'pick', array_append(a.pick, j),
                     'before', array_append(a.before, a.served)))[0]) AS plan""",
    ).selectExpr(
        "names",
        "sizes",
        "parts",
        "period",
        "aggregate(sizes, CAST(0 AS BIGINT), (a, n) -> a + n) AS rows",
        "plan.before AS before",
        "transform(parts, (p, i) -> filter(sequence(0, period - 1), t -> plan.pick[t] = i)) AS slots",
    )


def _key(docs: DataFrame, key: list[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in key]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    source: str = "source",
    key: tuple[str, ...] = ("doc_id", "text"),
    block_docs: int = 64,
    resolution: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Interleave ``docs`` to target weights: every input row once, with its place.

    ``weights``: columns ``source`` and ``weight`` (long, relative, > 0); sources
    without a weight are an error. None: the whole part of 1000 times the square root
    of a source's rows, which lifts small sources. Within a source the order is
    pseudo-random (md5 of ``seed`` and the ``key`` columns; equal rows tie and take
    either number).

    Adds mix_source (the source as text; null becomes the source ``null``),
    mix_index (number in the source), mix_block, mix_release, mix_deadline, mix_slot
    and position (number in the mix, from 0); input columns of these names are
    replaced. A null key counts as a value of its own, an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in OWN and c != "_mix_key"]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("null")).alias("mix_source"),
        _key(docs, list(key), seed).alias("_mix_key"),
    )
    sizes = rows.groupBy("mix_source").agg(F.count("*").alias("mix_rows"))
    if weights is None:
        sizes = sizes.withColumn("mix_weight", F.floor(1000 * F.sqrt("mix_rows")).cast("long"))
    else:
        given = weights.select(F.col("source").cast("string").alias("mix_source"), F.col("weight").cast("long").alias("mix_weight"))
        sizes = sizes.join(given, "mix_source", "left").withColumn(
            "mix_weight",
            F.when(F.col("mix_weight") > 0, F.col("mix_weight")).otherwise(
                F.raise_error(F.concat(F.lit("no weight above 0 for source "), "mix_source")).cast("long")
            ),
        )
    # one row, bounded by resolution x sources; stored, so that its size is known
    plan = stored(schedule(sizes, resolution), "mix-plan")
    facts = plan.select(F.struct(F.map_from_arrays("names", "parts").alias("parts"), "period", "rows").alias("p")).scalar()
    turns = (
        plan.selectExpr("names", "sizes", "parts", "before", "posexplode(slots) AS (i, own)")
        .selectExpr("names[i] AS mix_source", "sizes", "parts", "before", "posexplode(own) AS (k, slot)")
        .selectExpr("mix_source", "k AS _mix_turn", "slot AS _mix_slot", "zip_with(sizes, arrays_zip(parts, before[slot]), (n, x) -> struct(n AS rows, x.parts AS parts, x.`1` AS before)) AS _mix_facts")
    )

    # hash ranges: as many as the square root of the rows, as a power of two
    bits = F.least(F.ceil(F.log2(F.greatest(facts["rows"], F.lit(1))) / 2), F.lit(28)).cast("int")
    head = F.conv(F.substring("_mix_key", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("_mix_bucket", F.call_function("shiftright", head, F.lit(28) - bits))
    before = Window.partitionBy("mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy("mix_source", "_mix_bucket")
        .agg(F.count("*").alias("n"))
        .select("mix_source", "_mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_before"))
    )
    numbered = rows.withColumn(
        "_mix_row", F.row_number().over(Window.partitionBy("mix_source", "_mix_bucket").orderBy("_mix_key"))
    ).join(counts, ["mix_source", "_mix_bucket"])

    own = [f"`{c}`" for c in kept]
    return (
        numbered.withColumn("mix_index", F.col("_mix_before") + F.col("_mix_row") - 1)
        .withColumn("mix_block", F.expr(f"mix_index div {block_docs}"))
        .withColumn("_mix_parts", facts["parts"][F.col("mix_source")].cast("long"))
        .withColumn("_mix_period", facts["period"].cast("long"))
        .withColumn("_mix_turn", (F.col("mix_block") % F.col("_mix_parts")).cast("int"))
        .join(turns, ["mix_source", "_mix_turn"])
        .selectExpr(
            *own,
            "mix_source",
            "mix_index",
            "mix_block",
            "mix_block * _mix_period div _mix_parts AS mix_release",
            "((mix_block + 1) * _mix_period + _mix_parts - 1) div _mix_parts AS mix_deadline",
            "mix_block div _mix_parts * _mix_period + _mix_slot AS mix_slot",
            f"""mix_index % {block_docs} + aggregate(
                  _mix_facts, CAST(0 AS BIGINT), (a, x) -> a + least(
                      x.rows, {block_docs} * (mix_block div _mix_parts * x.parts + x.before))) AS position""",
        )
    )
