"""Merkle manifest of a dataset, trees in van Emde Boas layout (operator 13).

Every row is a leaf, the hash of its fields. Leaves of a group (``tree``) stand in the order
of their ids; every two neighbours are hashed into their parent, a last one without a
neighbour by itself, until one node is left, the group's subroot; subroots make a tree
of their own in the order of the groups, whose last node is the root.

No tree is held in one place. A tree is cut into aligned subtrees of ``2 ** bits`` leaves, each
built in a task of its own; their roots are the leaves of the next tier, and so on until one block is
left. A block's nodes are stored in van Emde Boas order: the upper half of
its levels first, then the subtrees below, each laid out likewise, so that a path
from leaf to root touches few lines of memory whatever their size. ``address`` gives the place of a
node by halving the height; construction and retrieval of siblings both go by it.
Paths are handed down from the top tier: what stands above a block is the path of its root.

Null groups are a group of their own, before all others. Null ids come first; rows that
repeat an id stand in the order of their leaf hashes (equal rows are equal leaves). An
empty table gives an empty manifest. Texts of any length are hashed where they are read.
Carried columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from strandline.llm.common import numbered
from strandline.session import ship_package, stored

OWN = ("leaf", "subroot", "root", "proof", "sides")


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a row: each field as `-` if null, else its bytes' number, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes ``index`` at ``depth`` (0: the root) in a tree of ``levels`` levels."""
    index = np.asarray(index, dtype=np.int64)
    base = np.zeros(len(index), dtype=np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        base += (1 << upper) - 1 + (index >> (depth - upper)) * ((1 << lower) - 1)
        index = index & ((1 << (depth - upper)) - 1)
        depth, levels = depth - upper, lower
    return base


def node_hash(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def height_of(size: int, bits: int) -> int:
    """Levels above the leaves of a block, in a tier of ``size`` nodes."""
    return bits if size > 1 << bits else (size - 1).bit_length()


def built(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(root, nodes in van Emde Boas order) of a block, from the hashes of its leaves as hex text."""
    nodes = np.zeros(((1 << height + 1) - 1, 32), dtype=np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        raw = np.frombuffer(bytes.fromhex(b"".join(level).decode()), dtype=np.uint8).reshape(-1, 32)
        nodes[address(height + 1, depth, np.arange(len(level)))] = raw
        if depth:
            level = [node_hash(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], nodes.tobytes()


def paths(nodes: bytes, height: int, count: int, at: np.ndarray) -> tuple[list[list[str]], list[str]]:
    """Siblings (hex) and sides of the leaves ``at`` of a block of ``count`` leaves, from below; `-` for no sibling."""
    held = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32)
    proofs: list[list[str]] = [[] for _ in at]
    sides = np.full((len(at), height), ord("-"), dtype=np.uint8)
    for level in range(height):
        index = at >> level
        beside = index ^ 1
        there = np.flatnonzero(beside < (count + (1 << level) - 1) >> level)
        found = held[address(height + 1, height - level, beside[there])]
        for i, digest in zip(there.tolist(), found):
            proofs[i].append(digest.tobytes().hex())
        sides[there, level] = np.where(index[there] & 1, ord("L"), ord("R"))
    return proofs, [s.tobytes().decode() for s in sides]


BLOCK = "tree string, block long, size long, height int, hash string, nodes binary"


def blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Blocks of one tier (tree, pos, size, hash)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size, block = table.column("size")[0].as_py(), table.column("block")[0].as_py()
        height = height_of(size, bits)
        root, held = built([h.encode() for h in table.column("hash").to_pylist()], height)
        row = {"tree": table.column("tree")[0].as_py(), "block": block, "size": size, "height": height, "hash": root.decode(), "nodes": held}
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types)})

    dealt = nodes.select("tree", "pos", "size", "hash", F.call_function("shiftright", F.col("pos"), F.lit(bits)).alias("block"))
    return dealt.groupBy("tree", "block").applyInArrow(run, BLOCK)


def forest(nodes: DataFrame, bits: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of blocks of trees of at most ``most`` leaves, from below, and the trees' roots (tree, hash)."""
    tiers, size = [], max(most, 1)
    while True:
        tiers.append(stored(blocks(nodes, bits), f"tier-{len(tiers)}"))
        if size <= 1 << bits:
            break
        upper = F.expr(f"(size + {(1 << bits) - 1}) div {1 << bits}")
        nodes = tiers[-1].where(F.col("size") > 1 << bits).select("tree", F.col("block").alias("pos"), upper.alias("size"), "hash")
        size = -(-size // (1 << bits))
    roots = [t.where(F.col("size") <= 1 << bits).select("tree", "hash") for t in tiers]
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    return tiers, out


def handed_down(nodes: DataFrame, tier: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (tree, pos and others) with proof and sides, from their block and what stands above it.

    ``upper``: tree, block, proof and sides of every block's root.
    """
    held = tier.join(upper, ["tree", "block"]).select("tree", "block", "size", "height", "nodes", "proof", "sides")
    dealt = nodes.withColumn("block", F.call_function("shiftright", F.col("pos"), F.lit(bits)))
    names = nodes.columns
    schema = StructType([*nodes.schema.fields]).add("proof", ArrayType(StringType())).add("sides", "string")

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        if not rows.num_rows:
            empty = rows.select(names).append_column("proof", pa.array([], pa.list_(pa.string())))
            return empty.append_column("sides", pa.array([], pa.string()))
        one = above.slice(0, 1).to_pylist()[0]
        start = one["block"] << bits
        count = min(one["size"] - start, 1 << bits)
        proofs, sides = paths(one["nodes"], one["height"], count, rows.column("pos").to_numpy() - start)
        proofs = [p + one["proof"] for p in proofs]
        out = rows.select(names).append_column("proof", pa.array(proofs, pa.list_(pa.string())))
        return out.append_column("sides", pa.array([s + one["sides"] for s in sides], pa.string()))

    return dealt.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(run, schema)


def descended(leaves: DataFrame, tiers: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """``leaves`` (tree, pos and others) with their paths; ``tops``: tree, proof and sides of every tree's root."""
    above = None
    for n in range(len(tiers) - 1, -1, -1):
        tier = tiers[n]
        upper = tier.where(F.col("size") <= 1 << bits).select("tree", "block").join(tops, "tree")
        if above is not None:
            upper = upper.unionByName(above)
        nodes = leaves
        if n:
            nodes = tiers[n - 1].where(F.col("size") > 1 << bits).select("tree", F.col("block").alias("pos"))
        found = handed_down(nodes, tier, upper, bits)
        above = stored(found, f"paths-{n}").withColumnRenamed("pos", "block") if n else found
    return above


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    id: str = "doc_id",
    carry: tuple[str, ...] = ("doc_id",),
    bits: int = 10,
) -> DataFrame:
    """``carry`` columns of every row with leaf, subroot, root, proof and sides.

    ``proof``: the siblings from the leaf up to the root; ``sides``: for every level whether the
    sibling stands left (L) or right (R), or there is none (-). ``folded`` goes up by them.
    """
    ship_package(docs.sparkSession)
    carry = tuple(c for c in carry if c not in OWN)
    # trees by text that sorts null before all
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("-"))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(key.alias("tree"), F.col(f"`{id}`").alias("id"), leaf_hash([F.col(f"`{c}`") for c in fields]).alias("hash"), *own)
    rows = numbered(rows, [F.col("tree"), F.col("id").asc_nulls_first(), F.col("hash")], "at", "leaves")
    trees = stored(rows.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("size")), "trees")
    most, n_trees = trees.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    leaves = rows.join(trees, "tree").select("tree", (F.col("at") - F.col("first")).alias("pos"), "size", "hash", *[f"c{i}" for i in range(len(carry))])

    tiers, roots = forest(leaves, bits, most)
    subroots = numbered(roots, [F.col("tree")], "pos", "subroots")
    crown = subroots.select(F.lit("").alias("tree"), "pos", F.lit(n_trees).cast("long").alias("size"), "hash", F.col("tree").alias("name"))
    top, root = forest(crown, bits, n_trees)
    none = root.select("tree", F.array().cast("array<string>").alias("proof"), F.lit("").alias("sides"))
    tops = descended(crown.select("tree", "pos", "name"), top, none, bits).select(F.col("name").alias("tree"), "proof", "sides")

    found = descended(leaves.drop("size"), tiers, stored(tops, "tops"), bits)
    both = stored(roots.select("tree", F.col("hash").alias("subroot")), "roots")
    found = found.join(both, "tree").withColumn("root", root.select("hash").scalar())
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return found.select(*names, F.col("hash").alias("leaf"), "subroot", "root", "proof", "sides")


def folded(leaf: Column, proof: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings give; a changed leaf gives another than the manifest's."""
    start = F.struct(leaf.alias("h"), F.lit(1).alias("k"))

    def up(a: Column, side: Column) -> Column:
        beside = F.coalesce(F.get(proof, a["k"] - 1), F.lit(""))
        text = F.when(side == "L", F.concat(beside, a["h"])).when(side == "R", F.concat(a["h"], beside)).otherwise(a["h"])
        return F.struct(F.sha2(text, 256).alias("h"), (a["k"] + (side != "-").cast("int")).alias("k"))

    steps = F.filter(F.split(sides, ""), lambda s: s != "")
    return F.aggregate(steps, start, up)["h"]
