"""Embedding near-dedup by NN-descent (operator 3).

Every vector keeps a short list of its nearest known neighbours. Lists start from
vectors adjacent in a few sorts by random hyperplane codes. A round joins each
vector's neighbours, forward and backward, with one another (neighbours of neighbours),
compares them within tasks, and sends on only what is closer than the worst of a
list. A list full of neighbours above the threshold is saturated and grows. Rounds
end when few lists change and an audit against brute force, on a bounded set of
query vectors, misses no link; if rounds run out with less than the recall asked for,
the call fails. The audit only measures: its links are no edges.

Edges at the threshold or above are kept, and their components are the classes. Lists
that are still saturated may owe links to other classes; their vectors are compared
exactly with those of other classes, group by group, where the triangle inequality on
angles leaves a link possible. Within a class all links are then counted exactly in
double precision, block against block, without listing pairs, as a class of many near
copies has too many.

Equal vectors are one vector with a number of copies. Vectors that are null, empty,
zero, or hold nulls or non-finite numbers link with nothing; vectors of unlike lengths
do not link. Rows without an id have a null class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import components
from strandline.session import ship_package, stored

#: Neighbours per list at the start and at most, growth of a saturated list, sorts per start, and reach in a sort.
LIST, LIST_MOST, GROWTH, SORTS, REACH = 8, 64, 4, 6, 6
#: Vectors joined at one place, and compared with as many in the exact count.
JOINED, BLOCK = 64, 1024
#: Query vectors of the audit.
AUDIT = 512


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it cannot link."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    size = np.abs(x).max()
    if not np.isfinite(size) or size == 0:
        return None
    x /= size
    return x / np.sqrt(x @ x)


def units(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """v (id) and x (unit vector as bytes, null if it cannot link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit(v) for v in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], names=["v", "x"]
            )

    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("v"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "v long, x binary")


def stacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x) for x in column.to_pylist()])


def sort_code(x: np.ndarray, seed: int, bits: int = 48) -> int:
    planes = _PLANES.get((seed, len(x)))
    if planes is None:
        planes = _PLANES[seed, len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((bits, len(x)))
    return int("".join("1" if s else "0" for s in planes @ x > 0), 2)


_PLANES: dict[tuple[int, int], np.ndarray] = {}

EDGE = "u long, v long, sim double"


def adjacent(points: DataFrame, seed: int) -> DataFrame:
    """Edges between vectors within REACH of each other in a sort by hyperplane code."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [sort_code(np.frombuffer(x), seed) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("x"), pa.array(codes, pa.int64())], names=["v", "x", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        for batch in batches:
            rows = held + list(zip(batch.column("v").to_pylist(), batch.column("x").to_pylist()))
            out = []
            for i in range(len(held), len(rows)):
                v, x = rows[i][0], np.frombuffer(rows[i][1])
                for w, y in rows[max(0, i - REACH) : i]:
                    if len(y) == x.nbytes:
                        sim = float(x @ np.frombuffer(y))
                        out += [(v, w, sim), (w, v, sim)]
            held = rows[-REACH:]
            if out:
                yield edges(*map(np.array, zip(*out)))

    coded = points.select("v", "x").mapInArrow(code, "v long, x binary, code long")
    return coded.repartitionByRange("code", "v").sortWithinPartitions("code", "v").mapInArrow(near, EDGE)


def edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], names=["u", "v", "sim"])


def shortened(found: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """The nearest of ``found`` (u, v, sim) per u; a saturated list (all full above the threshold) has grown."""
    best = found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    if lists is None:
        return best.withColumn("rank", rank).where(F.col("rank") <= LIST).withColumn("room", F.lit(LIST))
    room = lists.groupBy("u").agg(F.max("room").alias("room"), F.sum((F.col("sim") >= threshold).cast("int")).alias("full"))
    room = room.select("u", F.when(F.col("full") >= F.col("room"), F.least(F.col("room") * GROWTH, F.lit(LIST_MOST))).otherwise(F.col("room")).alias("room"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= LIST_MOST)
    return best.join(room, "u", "left").withColumn("room", F.coalesce("room", F.lit(LIST))).where(F.col("rank") <= F.col("room"))


def descend(lists: DataFrame, points: DataFrame, round_: int) -> DataFrame:
    """Edges between neighbours of a common vector that are closer than the worst of their lists."""
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= F.max("room"), F.min("sim")).otherwise(F.lit(-1.0)).alias("worst"))
    both = lists.select("u", "v").union(lists.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    # a vector that very many hold as a neighbour is joined in parts, other ones each round
    sizes = both.groupBy("u").agg(F.expr(f"CAST((count(*) + {JOINED - 1}) div {JOINED} AS INT)").alias("parts"))
    facts = points.select("v", "x").join(worst.withColumnRenamed("u", "v"), "v", "left").select("v", "x", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    rows = both.join(sizes, "u").withColumn("part", F.expr(f"CAST(pmod(xxhash64(v, {round_}), parts) AS INT)")).select("u", "part", "v").join(facts, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("u", "part", "v", "x", "worst"))):
                if row[:2] != last:
                    if len(group) > 1:
                        yield joined(group)
                    last, group = row[:2], []
                group.append(row[2:])
        if len(group) > 1:
            yield joined(group)

    def joined(group: list[tuple]) -> pa.RecordBatch:
        length = max(len(g[1]) for g in group)
        group = [g for g in group if len(g[1]) == length]
        v, worst_ = np.array([g[0] for g in group]), np.array([g[2] for g in group])
        x = np.array([np.frombuffer(g[1]) for g in group])
        sim = x @ x.T
        np.fill_diagonal(sim, -2.0)
        a, b = np.nonzero(sim > worst_[:, None])
        return edges(v[a], v[b], sim[a, b])

    return rows.repartition("u", "part").sortWithinPartitions("u", "part").mapInArrow(run, EDGE)


def unsettled(lists: DataFrame, new: DataFrame, threshold: float) -> tuple[int, int]:
    """Neighbours at the threshold or above that a round has brought, and all of them.

    Lists with all the room there is, full of such neighbours, only swap one link for
    another of the same class; they count as settled.
    """
    old = lists.select("u", "v", F.lit(True).alias("old"))
    rows = new.where(F.col("sim") >= threshold).join(old, ["u", "v"], "left")
    full = rows.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("old").isNull()).alias("fresh"))
    return full.agg(F.coalesce(F.sum(F.when(F.col("n") < LIST_MOST, F.col("fresh"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()


def truth(points: DataFrame, threshold: float, queries: int = AUDIT) -> DataFrame:
    """u, v: all links of some query vectors, by brute force.

    The queries are the ``queries`` vectors with the smallest hashed ids; they and their
    neighbours are all that is compared, whatever the number of vectors.
    """
    chosen = points.orderBy(F.xxhash64("v"), "v").limit(queries).select("v", "x").collect()
    shared = points.sparkSession.sparkContext.broadcast(([r["v"] for r in chosen], [bytes(r["x"]) for r in chosen]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in set(map(len, vectors)):
            own = [i for i, x in enumerate(vectors) if len(x) == size]
            by_length[size] = np.array([ids[i] for i in own]), np.array([np.frombuffer(vectors[i]) for i in own])
        for batch in batches:
            v, x = batch.column("v").to_numpy(), batch.column("x").to_pylist()
            for size, (q, y) in by_length.items():
                own = [i for i, one in enumerate(x) if len(one) == size]
                if own:
                    sim = y @ np.array([np.frombuffer(x[i]) for i in own]).T
                    a, b = np.nonzero(sim >= threshold)
                    other = q[a] != v[own][b]
                    yield edges(q[a][other], v[own][b][other], sim[a, b][other])

    return stored(points.select("v", "x").mapInArrow(run, EDGE).select("u", "v"), "audit")


def audit(links: DataFrame, labels: DataFrame) -> float:
    """Recall: the share of ``links`` (u, v) within one class, of all or in the mean of the vectors u, whichever is less.

    No list's room limits what is owed: a link between two classes is a miss.
    """
    rows = links.join(labels.select(F.col("v").alias("u"), F.col("label").alias("a")), "u", "left")
    rows = rows.join(labels.select("v", F.col("label").alias("b")), "v", "left")
    per = rows.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("found"))
    whole, mean = per.agg(F.sum("found") / F.sum("n"), F.avg(F.col("found") / F.col("n"))).first()
    return 1.0 if whole is None else min(whole, mean)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal keys, which follow each other."""
    last, group = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in keys + rest)):
            if row[: len(keys)] != last:
                if group:
                    yield last, group
                last, group = row[: len(keys)], []
            group.append(row[len(keys) :])
    if group:
        yield last, group


def across(lists: DataFrame, points: DataFrame, labels: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame | None:
    """Links (a, b) between classes of saturated vectors: one at least for any two groups that have some; None for a single class.

    A group are the saturated vectors with a common leader, of themselves and their
    lists the vector with the smallest hashed id. It lies within the threshold's angle of its
    leader, so leaders farther apart than both radii and that angle need no comparison.
    """
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    hashed = [F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v")) for c in ("u", "v")]
    full = lists.groupBy("u").agg(
        F.max("room").alias("room"), F.count_if(F.col("sim") >= threshold).alias("n"), F.least(F.min(hashed[0]), F.min(hashed[1]))["v"].alias("leader")
    )
    full = full.where("n >= room").select(F.col("u").alias("v"), "leader").join(labels, "v")
    if full.select("label").distinct().limit(2).count() < 2:
        return None
    full = full.join(points.select("v", "x"), "v").join(points.select(F.col("v").alias("leader"), F.col("x").alias("y")), "leader")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            cosine = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in pairs], dtype=float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=[*batch.schema.names, "angle"])

    full = full.select("label", "leader", "v", "x", "y")
    full = stored(full.mapInArrow(measure, "label long, leader long, v long, x binary, y binary, angle double"), "saturated")
    groups = stored(full.groupBy("leader").agg(F.min("label").alias("label"), F.min("y").alias("y"), F.max("angle").alias("radius")), "groups")
    blocks = (groups.count() + block - 1) // block
    dealt = groups.withColumn("own", F.expr(f"CAST(pmod(xxhash64(leader), {blocks}) AS INT)"))
    dealt = dealt.withColumn("other", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "leader", "label", "y", "radius")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), rows in runs(batches, ("i", "j"), ("own", "leader", "label", "radius", "y")):
            for size in {len(r[4]) for r in rows}:  # unlike lengths never link
                own, leader, label, radius = (np.array([r[k] for r in rows if len(r[4]) == size]) for k in range(4))
                y = np.array([np.frombuffer(r[4]) for r in rows if len(r[4]) == size])
                for at in range(0, len(y), 256):
                    part = slice(at, at + 256)
                    angle = np.arccos(np.clip(y[part] @ y.T, -1, 1))
                    # arccos is steep near one: the slack is larger than its rounding
                    close = (angle <= radius[part, None] + radius + limit + 1e-6) & (label[part, None] != label)
                    close &= leader[part, None] < leader
                    if i != j:
                        close &= own[part, None] != own
                    a, b = np.nonzero(close)
                    yield pa.RecordBatch.from_pydict({"g": leader[part][a], "h": leader[b]})

    pairs = stored(dealt.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(near, "g long, h long"), "near-groups")
    sides = pairs.withColumn("leader", F.explode(F.array("g", "h"))).join(full.select("leader", "v", "x"), "leader")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, _), rows in runs(batches, ("g", "h"), ("leader", "v", "x")):
            left, right = ([r for r in rows if (r[0] == g) == side] for side in (True, False))
            y = np.array([np.frombuffer(r[2]) for r in right])
            for at in range(0, len(left), 256):
                a, b = np.nonzero(np.array([np.frombuffer(r[2]) for r in left[at : at + 256]]) @ y.T >= threshold)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": [left[at + a[0]][1]], "b": [right[b[0]][1]]})
                    break

    return sides.repartition("g", "h").sortWithinPartitions("g", "h").mapInArrow(first, "a long, b long")


def classes(lists: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """v and label: components of the lists' edges and of the links between saturated vectors."""
    close = lists.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    labels = stored(components(close), "labels").select(F.col("id").alias("v"), F.col("component_id").alias("label"))
    more = across(lists, points, labels, threshold)
    if more is None:
        return labels
    whole = components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).union(more))
    return stored(whole, "labels").select(F.col("id").alias("v"), F.col("component_id").alias("label"))


def counted(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """v and n: vectors (with copies) of its class at the threshold or above, itself excluded. ``members``: label, v, x, copies."""
    sizes = members.groupBy("label").agg(F.expr(f"CAST((count(*) + {block - 1}) div {block} AS INT)").alias("blocks"))
    rows = members.join(sizes, "label").withColumn("own", F.expr("CAST(pmod(xxhash64(v), blocks) AS INT)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "x", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j", "own", "v", "x", "copies"))):
                if row[:3] != last:
                    if group:
                        yield links(last, group)
                    last, group = row[:3], []
                group.append(row[3:])
        if group:
            yield links(last, group)

    def links(at: tuple, group: list[tuple]) -> pa.RecordBatch:
        own, v, copies = (np.array([g[i] for g in group]) for i in (0, 1, 3))
        x = np.array([np.frombuffer(g[2]) for g in group])
        n = np.zeros(len(group), dtype=np.int64)
        for start in range(0, len(group), 256):
            part = slice(start, start + 256)
            close = x[part] @ x.T >= threshold
            close &= v[part, None] != v
            if at[1] != at[2]:
                close &= own[part, None] != own
            n[part] = close @ copies
        return pa.RecordBatch.from_pydict({"v": v, "n": n})

    spread = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return spread.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.99, rounds: int = 8
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept, and recall, the last audit's; less than ``recall`` is an error."""
    ship_package(vectors.sparkSession)
    rows = stored(units(vectors, id, vector), "units")
    copies = rows.where("v IS NOT NULL AND x IS NOT NULL").groupBy("x").agg(F.min("v").alias("v"), F.count("*").alias("copies"))
    points = stored(copies, "points")
    start = points.select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(0.0).alias("sim")).where("false")
    for seed in range(SORTS):
        start = start.union(adjacent(points, seed))
    lists = stored(shortened(start, None, threshold), "lists")
    links, reached, round_ = truth(points, threshold), 0.0, 0
    while reached < 1 and round_ < rounds:
        more = descend(lists, points, round_)
        if round_ % 2:  # a new sort brings together what no list connects
            more = more.union(adjacent(points, SORTS + round_))
        new = stored(shortened(lists.select("u", "v", "sim").union(more), lists, threshold), "lists")
        changed, close = unsettled(lists, new, threshold)
        lists, round_ = new, round_ + 1
        if changed <= 0.01 * close or round_ == rounds:
            labels = classes(lists, points, threshold)
            reached = audit(links, labels)
    if reached < recall:
        raise RuntimeError(f"near duplicates: recall {reached:.4f} of {recall} after {rounds} rounds")
    # classes of one length only, as unlike lengths never link
    counts = stored(counted(points.join(labels, "v"), threshold), "counts")
    named = points.join(labels, "v", "left").join(counts, "v", "left")
    named = stored(named.select("x", F.coalesce("label", "v").alias("label"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "named")
    placed = rows.join(named, "x", "left")
    return placed.select(
        F.col("v").alias(id),
        F.when(F.col("v").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("v").isNotNull(), F.coalesce("label", "v")).alias("component_id"),
        (F.col("v") == F.coalesce("label", "v")).alias("kept"),
        F.lit(reached).alias("recall"),
    )
