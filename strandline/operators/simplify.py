"""Simplification by significance.

Where an interval of a line is split does not depend on the tolerance.  So each
vertex gets one number, its *significance*: the smallest squared offset along
the chain of splits leading to it.  A vertex survives a tolerance t exactly
when its significance exceeds t squared.

Lines of at most ``WHOLE_ROWS`` vertices come whole to one task, many at once.
Of longer lines, intervals longer than ``LOCAL_SPAN`` vertices are split by
distributed rounds (a combining aggregate finds the farthest vertex of each
interval, then the rows learn their new interval on (line, chunk)).  Shorter
intervals are bounded groups and are finished inside one task each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.lines import CHUNK, LINE, WHOLE_ROWS, attach, chunk_number, map_whole, spread_out
from strandline.operators.crossings import split_lines
from strandline.operators.geometry import project_local
from strandline.session import cut_lineage

LOCAL_SPAN = 20_000
HALVINGS = 24
# squared offsets in the same step of 1 / TIE_STEPS square metres tie; the earlier vertex splits
TIE_STEPS = 1000
ROUNDS_PER_CUT = 4


def significance(lines: DataFrame, keys: Sequence[str] = LINE, local_span: int = LOCAL_SPAN) -> DataFrame:
    """Add ``significance`` to every vertex; end vertices get infinity."""
    return _scored(lines, keys, local_span).drop("x", "y")


def _scored(lines: DataFrame, keys: Sequence[str], local_span: int = LOCAL_SPAN) -> DataFrame:
    """``significance`` with the projected vertices."""
    keys = list(keys)
    short, others = split_lines(lines, keys, min(WHOLE_ROWS, local_span))
    scored = _score_whole(short, keys)
    return scored if others is None else scored.unionByName(_score_parts(others, keys, local_span))


def _turned() -> Column:
    """East metres from ``ref_lat`` and ``ref_lon``.

    One factor after the other: products in another order differ in the last bits, and offsets near a step of ties with them.
    """
    turn, east = F.cos(F.radians("ref_lat")), F.col("lon") - F.col("ref_lon")
    flat = F.abs(turn * geo.METERS_PER_DEG_LAT) < 1e-9
    return F.when(flat, east * geo.meters_per_deg_lon(F.col("ref_lat"))).otherwise(east * geo.METERS_PER_DEG_LAT * turn)


def _score_whole(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Short lines: the mean vertex (summed along ``seq``), the projection and all splits in one shuffle."""
    along = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    means = {f"ref_{c}": F.sum(c).over(along) / F.count(c).over(along) for c in ("lat", "lon")}
    y = (F.col("lat") - F.col("ref_lat")) * geo.METERS_PER_DEG_LAT
    projected = spread_out(lines, keys).withColumns(means).select(*keys, "seq", "lat", "lon", _turned().alias("x"), y.alias("y"))
    types = {f.name: f.dataType.simpleString() for f in projected.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", significance double"

    def work(batch: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        found = interval_significance(x, y, first, np.full(len(first), np.inf))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "significance"])

    return map_whole(projected, keys, work, schema)


def _score_parts(lines: DataFrame, keys: list[str], local_span: int) -> DataFrame:
    """Longer lines, by intervals."""
    projected = project_local(lines.select(*keys, "seq", "lat", "lon"), keys).select(
        *keys, "seq", "lat", "lon", _turned().alias("x"), "y"
    )
    xy = F.struct("x", "y")
    whole = projected.groupBy(*keys).agg(
        F.min("seq").alias("s"),
        F.max("seq").alias("e"),
        F.min_by(xy, F.col("seq")).alias("a"),
        F.max_by(xy, F.col("seq")).alias("b"),
    )
    whole = whole.withColumn("chain", F.lit(float("inf")))
    state = attach(projected, whole, keys, lo="s", hi="e")
    ends = state.where((F.col("seq") == F.col("s")) | (F.col("seq") == F.col("e"))).select(
        *keys, "seq", "lat", "lon", "x", "y", F.lit(float("inf")).alias("significance")
    )
    todo = state.where((F.col("seq") > F.col("s")) & (F.col("seq") < F.col("e")))
    done: list[DataFrame] = [ends]

    if not whole.where(F.col("e") - F.col("s") > local_span).isEmpty():
        todo, decided = _split_long(todo, keys, local_span)
        done.append(decided)

    done.append(_finish_local(todo, keys))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _split_long(todo: DataFrame, keys: list[str], local_span: int) -> tuple[DataFrame, DataFrame]:
    """Distributed rounds until every interval is short."""
    decided: list[DataFrame] = []
    short: list[DataFrame] = []
    rounds = 0
    current = cut_lineage(todo)
    while True:
        rounds += 1
        is_long = F.col("e") - F.col("s") > local_span
        short.append(current.where(~is_long))
        active = current.where(is_long)
        if active.isEmpty():
            break
        offset = geo.segment_distance_sq(
            F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")
        )
        measured = active.withColumn("d2", offset)
        split = F.struct(F.floor(F.col("d2") * TIE_STEPS), -F.col("seq"))
        splits = measured.groupBy(*keys, "s", "e").agg(
            F.max_by(F.struct("seq", "x", "y"), split).alias("m"),
            F.least(F.max_by("d2", split), F.max("chain")).alias("new_chain"),
        )
        spans = splits.withColumn(
            "_chunk",
            F.explode(F.sequence(F.floor(F.col("s") / F.lit(CHUNK)), F.floor(F.col("e") / F.lit(CHUNK)))),
        ).drop("e")
        moved = (
            active.withColumn("_chunk", chunk_number("seq"))
            .join(spans, [*keys, "_chunk", "s"])
            .drop("_chunk")
        )
        mseq = F.col("m.seq")
        pivot = F.struct(F.col("m.x").alias("x"), F.col("m.y").alias("y"))
        nxt = moved.select(
            *keys,
            "seq",
            "lat",
            "lon",
            "x",
            "y",
            F.when(F.col("seq") > mseq, mseq).otherwise(F.col("s")).alias("s"),
            F.when(F.col("seq") < mseq, mseq).otherwise(F.col("e")).alias("e"),
            F.when(F.col("seq") > mseq, pivot).otherwise(F.col("a")).alias("a"),
            F.when(F.col("seq") < mseq, pivot).otherwise(F.col("b")).alias("b"),
            F.col("new_chain").alias("chain"),
            (F.col("seq") == mseq).alias("hit"),
        )
        if rounds % ROUNDS_PER_CUT == 0:
            nxt = cut_lineage(nxt)
        decided.append(
            nxt.where("hit").select(*keys, "seq", "lat", "lon", "x", "y", F.col("chain").alias("significance"))
        )
        current = nxt.where(~F.col("hit")).drop("hit")
    rest, hits = short[0], decided[0]
    for part in short[1:]:
        rest = rest.unionByName(part)
    for part in decided[1:]:
        hits = hits.unionByName(part)
    return rest, hits


def _finish_local(todo: DataFrame, keys: list[str]) -> DataFrame:
    """Short intervals, which come one after the other in a task and are finished there."""
    fields = {f.name: f.dataType.simpleString() for f in todo.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + (
        f", seq {fields['seq']}, lat double, lon double, x double, y double, significance double"
    )
    flat = todo.select(
        *keys, "seq", "lat", "lon", "x", "y", "s", "e", "chain",
        F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"),
    )
    group = [*keys, "s"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        new = (pdf[group] != pdf[group].shift()).any(axis=1).to_numpy()
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(pdf)))
        ends = np.repeat(np.arange(len(first)), 2)
        # every interval with its two ends
        at = np.stack([first, first + size], axis=1).ravel()
        px, py = (
            np.insert(pdf[c].to_numpy(), at, np.where(np.arange(len(at)) % 2 == 0, pdf["a" + c].to_numpy()[first][ends], pdf["b" + c].to_numpy()[first][ends]))
            for c in ("x", "y")
        )
        start = first + 2 * np.arange(len(first))
        found = interval_significance(px, py, start, pdf.chain.to_numpy()[first])
        found = np.delete(found, np.concatenate([start, start + size + 1]))
        return pdf[[*keys, "seq", "lat", "lon", "x", "y"]].assign(significance=found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = (batch[group] != batch[group].iloc[-1]).any(axis=1).to_numpy()
            start = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            same = not held or (held[-1][group].iloc[-1] == batch[group].iloc[0]).all()
            if not same or start:  # the interval at the end goes on in the next batch
                whole = pd.concat([*held, batch.iloc[:start]], ignore_index=True)
                if len(whole):
                    yield finish(whole)
                held = []
            held.append(batch.iloc[start:])
        if held:
            yield finish(pd.concat(held, ignore_index=True))

    return spread_out(flat, group).sortWithinPartitions(*group, "seq").mapInPandas(run, schema)


def interval_significance(x: np.ndarray, y: np.ndarray, first: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Significance of the vertices of bounded intervals, one after the other from ``first``; ends are infinite.

    All intervals are split at once, one level of splits after the other.
    """
    out = np.full(len(x), np.inf)
    last = np.append(first[1:], len(x)) - 1
    inner = np.ones(len(x), dtype=bool)
    inner[first] = inner[last] = False
    at = np.flatnonzero(inner)
    part = np.searchsorted(first, at, side="right") - 1  # interval of every vertex
    new = np.flatnonzero(np.diff(part, prepend=-1))
    low, high, limit = first[part[new]], last[part[new]], chain[part[new]].astype(float)
    while len(at):
        part = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
        ax, ay = x[low], y[low]
        dx, dy = x[high] - ax, y[high] - ay
        span = dx * dx + dy * dy
        point = span == 0
        ax, ay, dx, dy, px, py = ax[part], ay[part], dx[part], dy[part], x[at], y[at]
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(point, 1.0, span)[part], 0.0, 1.0)
        t = np.where(point[part], 0.0, t)
        ex, ey = px - (ax + t * dx), py - (ay + t * dy)
        d2 = ex * ex + ey * ey
        step = np.floor(d2 * TIE_STEPS)
        step[np.isnan(step)] = np.inf
        top = np.flatnonzero(step == np.maximum.reduceat(step, new)[part])
        top = top[np.flatnonzero(np.diff(part[top], prepend=-1))]  # the earliest of each interval
        limit = np.where(d2[top] < limit, d2[top], limit)
        split = at[top]
        out[split] = limit
        rest = np.ones(len(at), dtype=bool)
        rest[top] = False
        child = (2 * part + (at > split[part]))[rest]
        at = at[rest]
        new = np.flatnonzero(np.diff(child, prepend=-1))
        of, right = child[new] >> 1, (child[new] & 1).astype(bool)
        low, high, limit = np.where(right, split[of], low[of]), np.where(right, high[of], split[of]), limit[of]
    return out


def simplify_to_tolerance(scored: DataFrame, tolerance_m: float) -> DataFrame:
    """Vertices that survive a tolerance."""
    if tolerance_m <= 0:
        return scored
    return scored.where(F.col("significance") > tolerance_m * tolerance_m)


def simplify_to_budget(
    lines: DataFrame, max_points: int, keys: Sequence[str] = LINE, rings: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Simplify each line to at most ``max_points`` vertices.

    Lines that end where they start are rings; without ``rings`` all lines are open, also those that meet their
    start by chance.

    Returns the surviving vertices and one record per line.  The 24 halvings
    between zero and the box diagonal only ask whether more than the wanted
    number of vertices survive, so one order statistic per line decides them.
    """
    keys = list(keys)
    point = F.struct("lat", "lon")
    heads = lines.groupBy(*keys).agg(
        F.count("*").alias("original_count"),
        F.min("seq").alias("lo_seq"),
        F.max("seq").alias("hi_seq"),
        (F.min_by(point, F.col("seq")) == F.max_by(point, F.col("seq"))).alias("closed"),
    ).withColumn("closed", F.lit(rings) & F.col("closed") & (F.col("original_count") >= 2))
    ring = F.col("closed")
    work_n = F.col("original_count") - F.when(ring, 1).otherwise(0)
    target = F.when(ring, F.greatest(F.lit(max_points - 1), F.lit(3))).otherwise(F.greatest(F.lit(max_points), F.lit(2)))
    wanted = (
        (F.col("original_count") >= 3)
        & (F.lit(max_points) > 0)
        & (F.col("original_count") > max_points)
        & ~(ring & ((F.col("original_count") <= 4) | (F.lit(max_points) <= 4)))
        & (work_n > target)
    )
    heads = heads.withColumn("wanted", wanted)
    work = attach(lines.select(*keys, "seq", "lat", "lon"), heads, keys).where(
        ~(F.col("closed") & (F.col("seq") == F.col("hi_seq")))
    )
    scored = cut_lineage(_scored(work.where("wanted").select(*keys, "seq", "lat", "lon"), keys))

    # the deciding order statistics, cut down per salt before the per-line step
    depth = max(max_points, 3) + 1
    by_sig = F.col("significance").desc()
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(256)))
    cut = (
        salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(by_sig, "seq")))
        .where(F.col("_r") <= depth)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by_sig, "seq")))
        .where(F.col("_rank") <= depth)
    )
    extent = scored.groupBy(*keys).agg(
        geo.length2d(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diagonal")
    )
    flags = heads.select(*keys, "closed", target.alias("target"))
    order = (
        cut.join(flags, keys)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_rank") == F.col("target") + 1, F.col("significance"))).alias("beyond"),
            F.max(F.when(F.col("closed") & (F.col("_rank") == 3), F.col("significance"))).alias("least_kept"),
        )
    )
    start = F.struct(F.lit(0.0).alias("lo"), F.col("diagonal").alias("hi"), F.lit(-1.0).alias("best"))

    def halve(z, _):
        mid = (z["lo"] + z["hi"]) / 2
        too_many = F.coalesce(F.col("beyond") > mid * mid, F.lit(False))
        too_few = F.coalesce(F.col("least_kept") <= mid * mid, F.lit(False))
        return F.struct(
            F.when(too_many, mid).otherwise(z["lo"]).alias("lo"),
            F.when(too_many, z["hi"]).otherwise(mid).alias("hi"),
            F.when(too_many | too_few, z["best"]).otherwise(mid).alias("best"),
        )

    searched = order.join(extent, keys).select(
        *keys, F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)["best"].alias("best")
    )
    plan = heads.join(searched, keys, "left").withColumn("best", F.coalesce("best", F.lit(-1.0)))
    limit = F.when(F.col("best") > 0, F.col("best") * F.col("best"))
    kept_work = attach(scored, plan.where("wanted"), keys).where(limit.isNull() | (F.col("significance") > limit))
    counts = kept_work.groupBy(*keys).agg(F.count("*").alias("kept"))
    record = (
        plan.join(counts, keys, "left")
        .withColumn("applied", F.col("wanted") & (F.col("best") >= 0) & (F.coalesce("kept", F.lit(0)) < work_n))
        .select(
            *keys,
            "original_count",
            F.when(F.col("applied"), F.col("kept") + F.when(ring, 1).otherwise(0))
            .otherwise(F.col("original_count"))
            .alias("simplified_count"),
            F.when(F.col("applied"), F.col("best")).otherwise(F.lit(0.0)).alias("tolerance_m"),
            "applied",
            "closed",
        )
    )
    untouched = attach(lines.select(*keys, "seq", "lat", "lon"), heads, keys).where(
        ~F.col("wanted") | (F.col("closed") & (F.col("seq") == F.col("hi_seq")))
    )
    kept = kept_work.select(*keys, "seq", "lat", "lon").unionByName(untouched.select(*keys, "seq", "lat", "lon"))
    return kept, record
