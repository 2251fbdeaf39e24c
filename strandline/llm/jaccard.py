"""N-gram Jaccard join, size-aware with a light and a heavy side (operator 6).

Sets of word shingles link when their Jaccard similarity reaches ``num / den``. The
join returns the classes that links connect.

Light sets: two sets of sizes s <= t link when they share a subset of the size
c(s, t) that the threshold asks for. A small set enumerates its subsets of that
fixed size; meeting in one *proves* the link.

Heavy sets: sets are entered into inverted lists and the lists are scanned. A list
belongs to a cell instead of a single shingle: hashes cut a set into cells, linked
sets differ in at most d shingles, so of any d + 1 cells of one set the other holds
one unchanged. A set enters its d + 1 fullest cells (a rule on contents, so that both
sides choose alike). Phrases that a third of all documents share do not make long
lists, as a cell mixes them with a document's own words.

The boundary is the size with the least total cost over the histogram of sizes: a
subset costs one list entry, a cell costs an entry and the comparison it can lead to,
which reads the set.

Lists are never expanded into all their pairs. A first scan compares each list's members
with its two most central ones; members found linked share a class. A second scan
compares, block by block within tasks, what is left: pairs of *different* classes. They
must pass a parity sketch (its bits give a lower bound of the difference, so nothing is
lost), and only those that do leave the task, to have their full sets fetched and compared
exactly.

Equal sets are one set from the start. Texts without words link with nothing; so do
rows without an id (their class is null). Rows that repeat an id count as one document
per text. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import GOLDEN, ROWS, components, distinct_sorted, fold, lean, mix64, word_hashes
from strandline.session import ship_package, stored

HEAVY, EQUAL, SMALLER, LARGER = 0, 1, 2, 3
ENTRY = "key long, role byte, set long, n long"
#: Members of a list that one task compares with as many others.
BLOCK = 2048
#: Bytes of the short sketches that pairs carry first, and that members of lists carry.
BRIEF, WIDE = 64, 256
#: Sizes above this are never light: their subsets alone would outgrow any text.
LIGHT_MOST = 60


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; all words as one if they are fewer."""
    run = word_hashes(text.encode("utf-8").lower()) if text else np.empty(0, np.uint64)
    return distinct_sorted(fold(run, min(width, len(run)))) if len(run) else run


class Threshold:
    """Integer arithmetic of a Jaccard threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def most(self, s: int) -> int:
        """Largest size that can link with size s."""
        return s * self.den // self.num

    def least(self, s: int) -> int:
        return -(-s * self.num // self.den)

    def differ(self, s: int, t: int) -> int:
        """Most shingles in which linked sets of these sizes differ."""
        return (s + t) * (self.den - self.num) // (self.den + self.num)

    def overlap(self, s: int, t: int) -> int:
        return -(-(s + t) * self.num // (self.den + self.num))

    def links(self, common: int, s: int, t: int) -> bool:
        return self.den * common >= self.num * (s + t - common)

    @cache
    def bands(self, s: int) -> tuple[tuple[int, int, int], ...]:
        """(band, cells of the band, entries) for a set of size s.

        A band holds sizes from a power of two to the next, and what can link above; a
        pair meets in the band of its smaller set.
        """
        out, band = [], s.bit_length() - 1
        while band >= 0:
            top = self.most((2 << band) - 1)  # largest size in the band
            if s > top:
                break
            small = min(s, (2 << band) - 1)
            need = self.differ(small, min(top, self.most(small)) if s == small else s) + 1
            cells = (5 * (self.differ((2 << band) - 1, top) + 1) + 3) // 4
            out.append((band, max(cells, need), need))
            band -= 1
        return tuple(out)

    @cache
    def partners(self, s: int, light: int) -> tuple[tuple[int, int], ...]:
        """(other size, subset size) of the light pairs of a set of size s."""
        return tuple((t, self.overlap(s, t)) for t in range(self.least(s), min(self.most(s), light) + 1))

    def boundary(self, sizes: dict[int, int]) -> int:
        """Largest light size: least entries plus reads over a histogram of set sizes."""
        small = {s: n for s, n in sizes.items() if 0 < s <= self.most(LIGHT_MOST)}

        def cost(light: int) -> int:
            total = 0
            for s, n in small.items():
                if s <= light:
                    total += n * sum(comb(s, c) for _, c in self.partners(s, light))
                if self.most(s) > light:
                    total += n * sum(need for _, _, need in self.bands(s)) * (1 + s)
            return total

        return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def describe(docs: DataFrame, width: int, rule: Threshold) -> DataFrame:
    """doc, n, set (64-bit name of the set; null if empty) and parity sketch of every (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                sizes.append(len(own))
                names.append(name(own) if len(own) else None)
                sketches.append(sketch(own, rule) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc", "n", "set", "sketch"],
            )

    return docs.mapInArrow(lean(run, ROWS), "doc long, n long, set long, sketch binary")


def name(own: np.ndarray) -> int:
    return int(mix64(np.array([np.add.reduce(mix64(own ^ GOLDEN)) ^ np.uint64(len(own))])).view(np.int64)[0])


def sketch(own: np.ndarray, rule: Threshold) -> bytes:
    """Parities of the numbers of shingles per bucket; differing bits are differing shingles at least."""
    width = 64
    while width < 16 * rule.differ(len(own), len(own)):
        width *= 2
    counts = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # buckets of the wider sketch fold onto those of the other
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def entries(own: np.ndarray, rule: Threshold, light: int) -> tuple[np.ndarray, np.ndarray]:
    """List keys of a set and the set's role in each."""
    s, keys, roles = len(own), [], []
    if s <= light:
        for t, c in rule.partners(s, light):
            role = EQUAL if t == s else SMALLER if s < t else LARGER
            salt = np.uint64((min(s, t) << 20) + (max(s, t) << 4) + 1)
            mixed = mix64(own)
            if s - c <= c:  # leave out, instead of choose, the few
                gone = np.array([np.add.reduce(mixed[list(some)], initial=0) for some in combinations(range(s), s - c)], dtype=np.uint64)
                sums = np.add.reduce(mixed) - gone
            else:
                sums = np.array([np.add.reduce(mixed[list(some)]) for some in combinations(range(s), c)], dtype=np.uint64)
            keys.append(mix64(sums ^ mix64(np.array([salt]))))
            roles.append(np.full(len(sums), role, np.int8))
    if rule.most(s) > light:
        high = own >> np.uint64(32)
        mixed = mix64(own ^ GOLDEN)
        for band, cells, need in rule.bands(s):
            cell = (high * np.uint64(cells)) >> np.uint64(32)  # grows with the hash, so cells are runs
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            count = np.diff(np.append(starts, s))
            content = np.add.reduceat(mixed, starts)
            salt = (cell[starts] << np.uint64(8)) + np.uint64(band)
            if len(starts) < need:  # too few cells hold shingles: empty ones count as cells, too
                empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), cell[starts])
                count = np.concatenate([count, np.zeros(len(empty), count.dtype)])
                content = np.concatenate([content, empty])
                salt = np.concatenate([salt, (empty << np.uint64(8)) + np.uint64(band)])
            full = mix64(content ^ mix64(salt + GOLDEN))
            fullest = np.lexsort((full, count))[-need:]
            keys.append(full[fullest])
            roles.append(np.full(len(fullest), HEAVY, np.int8))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    return np.concatenate(keys), np.concatenate(roles)


def listed(docs: DataFrame, width: int, rule: Threshold, light: int) -> DataFrame:
    """Entries (key, role, set, n) of the lists with two different sets or more."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                if not len(own):
                    continue
                keys, roles = entries(own, rule, light)
                parts.append((keys, roles, np.full(len(keys), name(own)), np.full(len(keys), len(own), np.int64)))
                held += len(keys)
                if held > 200_000:
                    yield packed(parts)
                    parts, held = [], 0
            if parts:
                yield packed(parts)

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        key, role, own, n = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(role), pa.array(own), pa.array(n)], names=["key", "role", "set", "n"])

    return meeting(docs.mapInArrow(lean(enter, ROWS), ENTRY))


def meeting(entries_: DataFrame) -> DataFrame:
    """Distinct entries of the lists that hold two different sets or more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and set, the distinct ones whose key has another; one row is held back."""
        held = None  # the last row, and whether the row before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held[0], batch]).combine_chunks()
            key, own = rows.column("key").to_numpy(), rows.column("set").to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            rows, key = rows.filter(pa.array(new)), key[new]
            follows = np.concatenate([[held is not None and held[1]], key[1:] == key[:-1]])
            led = np.append(key[1:] == key[:-1], False)
            keep = follows | led
            keep[-1] = False
            yield from rows.filter(pa.array(keep)).to_batches()
            held = (rows.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(follows[-1]))
        if held is not None and held[1]:
            yield held[0]

    return entries_.repartition("key").sortWithinPartitions("key", "set").mapInArrow(lean(meet), ENTRY)


def proven(lists: DataFrame) -> DataFrame:
    """Links that light lists prove: all members of a list, if both of its sizes are there."""
    light = lists.where(F.col("role") != HEAVY)
    firsts = light.where(F.col("role") != LARGER).groupBy("key").agg(F.min("set").alias("first"))
    return light.join(firsts, "key").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))


def pivot_pairs(lists: DataFrame, rule: Threshold) -> DataFrame:
    """Pairs of each list's members with its two most central ones.

    Central is who meets most others over all lists: the original of a group of edited copies
    rather than one of its copies.
    """
    meets = lists.groupBy("key").agg(F.count("*").alias("m"))
    weight = lists.join(meets, "key").groupBy("set").agg(F.sum("m").alias("weight"))
    rows = lists.join(weight, "set").select("key", "set", "n", (-F.col("weight")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivots = None, []
        for batch in batches:
            a, b = [], []
            for key, own, n in zip(*(batch.column(c).to_numpy().tolist() for c in ("key", "set", "n"))):
                if key != last:
                    last, pivots = key, []
                for pivot, m in pivots:
                    if rule.least(max(n, m)) <= min(n, m):
                        a.append(min(own, pivot))
                        b.append(max(own, pivot))
                if len(pivots) < 2:
                    pivots.append((own, n))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.repartition("key").sortWithinPartitions("key", "at", "set").mapInArrow(lean(run), "a long, b long").distinct()


def unlike_pairs(members: DataFrame, rule: Threshold, block: int = BLOCK) -> DataFrame:
    """Pairs of unlike classes that meet in a list and pass the sketches.

    ``members``: key, set, n, label, sketch. A list is cut into blocks, and every two blocks
    meet in a task; pairs are compared there by their (short) sketches and only those that pass leave it.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.where("low <> high").select("key", F.expr(f"CAST((m + {block - 1}) div {block} AS INT)").alias("blocks"))
    rows = members.join(sizes, "key").withColumn("own", F.expr("CAST(pmod(xxhash64(set), blocks) AS INT)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "n", "label", "sketch")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "own", "set", "n", "label", "sketch"))):
                if row[:3] != last:
                    if last:
                        yield from near(last, group)
                    last, group = row[:3], []
                group.append(row[3:])
        if last:
            yield from near(last, group)

    def near(at: tuple, group: list[tuple]) -> Iterator[pa.RecordBatch]:
        own, name_, n, label = (np.array(x) for x in list(zip(*group))[:4])
        bits = folded([g[4] for g in group])
        a, b = [], []
        for start in range(0, len(group), 128):
            part = slice(start, start + 128)
            small, large = np.minimum(n[part, None], n), np.maximum(n[part, None], n)
            keep = (name_[part, None] < name_) & (label[part, None] != label) & (large * rule.num <= small * rule.den)
            if at[1] != at[2]:
                keep &= own[part, None] != own
            x, y = np.nonzero(keep)
            for step in range(0, len(x), 50_000):
                u, v = x[step : step + 50_000] + start, y[step : step + 50_000]
                apart = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1)
                close = apart <= (n[u] + n[v]) * (rule.den - rule.num) // (rule.den + rule.num)
                a.append(name_[u[close]])
                b.append(name_[v[close]])
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the narrowest width."""
    width = min(map(len, sketches)) // 8
    out = np.zeros((len(sketches), width), dtype=np.uint64)
    for i, one in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(one, np.uint64).reshape(-1, width), axis=0)
    return out


def both_sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` with the other columns of ``facts`` (set, ...) for a (suffix _a) and b (suffix _b)."""
    for side in ("a", "b"):
        own = facts.select(F.col("set").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != "set"])
        pairs = pairs.join(own, side)
    return pairs


def passing(pairs: DataFrame, rule: Threshold, left: str, right: str, test) -> DataFrame:
    """Pairs (a, b) for which ``test(value of left, value of right)`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # whole sets of few pairs at once
                part = batch.slice(at, 256)
                keep = [test(x, y) for x, y in zip(part.column(left).to_pylist(), part.column(right).to_pylist())]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", left, right).mapInArrow(lean(run), "a long, b long")


def brief(sets: DataFrame, most: int = BRIEF) -> DataFrame:
    """set and a struct of n and the sketch folded to ``most`` bytes.

    Folding by XOR never adds to the distance of two sketches, so pairs that are too far apart
    in the short ones are in the whole ones, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [x if len(x) <= most else folded([x, bytes(most)])[0].tobytes() for x in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("n"), pa.array(short, pa.binary())], names=["set", "n", "sketch"])

    short = sets.select("set", "n", "sketch").mapInArrow(lean(run), "set long, n long, sketch binary")
    return short.select("set", F.struct("n", "sketch").alias("s"))


def compared(pairs: DataFrame, docs: DataFrame | Callable[[DataFrame], DataFrame], sets: DataFrame, width: int, rule: Threshold) -> DataFrame:
    """Pairs that link, by short sketches first, then by whole ones, and by whole sets at last.

    ``docs`` (doc, text) may be a function of the wanted sets, which must give these and may give others.
    """

    def near(x: dict, y: dict) -> bool:
        return parity_distance(x["sketch"], y["sketch"]) <= rule.differ(x["n"], y["n"])

    pairs = stored(passing(both_sides(pairs, brief(sets)), rule, "s_a", "s_b", near), "brief")
    sketches = sets.select("set", F.struct("n", "sketch").alias("s"))
    left = stored(passing(both_sides(pairs, sketches), rule, "s_a", "s_b", near), "near")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owns = [shingles(t, width) for t in part.column("text").to_pylist()]
                same = pa.array([len(o) > 0 and name(o) == s for o, s in zip(owns, part.column("set").to_pylist())], pa.bool_())
                blobs = pa.array([o.tobytes() for o in owns], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("set"), blobs], names=["set", "whole"]).filter(same)

    wanted = left.select(F.col("a").alias("set")).union(left.select(F.col("b").alias("set"))).distinct()
    facts = [c for c in ("set", "doc", "home") if c in sets.columns]
    wanted = stored(wanted.join(sets.select(*facts), "set"), "wanted")
    texts = docs(wanted) if callable(docs) else docs
    texts = texts.join(wanted, "doc").dropDuplicates(["doc", "set", "text"]).select("set", "text")
    wholes = stored(texts.mapInArrow(lean(whole), "set long, whole binary"), "whole")

    def linked(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return rule.links(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))

    return stored(passing(both_sides(left, wholes), rule, "whole_a", "whole_b", linked), "linked")


def linked_classes(lists: DataFrame, docs: DataFrame | Callable[[DataFrame], DataFrame], sets: DataFrame, width: int, rule: Threshold) -> DataFrame:
    """(set, label) of all sets that link: pairs from ``lists`` (key, role, set, n), compared exactly.

    ``docs``: doc, text (see ``compared``); ``sets``: set, doc (one that holds it), n, sketch.
    """
    heavy = lists.where(F.col("role") == HEAVY)
    pairs = stored(pivot_pairs(heavy, rule), "pairs")
    links = stored(proven(lists), "proven").union(compared(pairs, docs, sets, width, rule))
    labels = stored(components(links), "labels").withColumnRenamed("id", "set").withColumnRenamed("component_id", "label")
    short = stored(brief(sets, WIDE), "short").select("set", F.col("s.sketch").alias("sketch"))
    members = heavy.join(labels, "set", "left").join(short, "set")
    members = members.select("key", "set", "n", F.coalesce("label", "set").alias("label"), "sketch")
    others = stored(unlike_pairs(members, rule), "others").join(pairs, ["a", "b"], "left_anti")
    links = links.union(compared(others, docs, sets, width, rule))
    return stored(components(links), "labels").withColumnRenamed("id", "set").withColumnRenamed("component_id", "label")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id (the smallest id that links reach).

    A document without words is a class of its own; a row without an id has a null class.
    """
    ship_package(docs.sparkSession)
    rule = Threshold(num, den)
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    described = stored(describe(docs, width, rule), "described")
    known = described.where("set IS NOT NULL AND doc IS NOT NULL")
    sets = stored(known.groupBy("set").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "sets")

    small = known.where(F.col("n") <= rule.most(LIGHT_MOST)).groupBy("n").count().collect()  # at most so many sizes
    light = rule.boundary({r["n"]: r["count"] for r in small})
    lists = stored(listed(docs.where("doc IS NOT NULL"), width, rule, light), "lists")
    labels = linked_classes(lists, docs, sets, width, rule)
    placed = described.select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("set")).alias("set"))
    placed = stored(placed.join(labels, "set", "left").select("doc", "n", F.coalesce("label", "set").alias("label")), "placed")
    firsts = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc").alias("first"), F.count("*").alias("m")).where("m > 1")
    firsts = stored(firsts.select("label", "first"), "firsts")
    return placed.join(firsts, "label", "left").select(
        F.col("doc").alias(id), F.col("n").alias("n_shingles"), F.coalesce("first", "doc").alias("component_id")
    )


def kept(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` without all but the first (smallest id) of every class; rows without an id stay, rows that repeat the first's id stay."""
    gone = classes(docs, id, text, **limits).where(F.col(id) != F.col("component_id")).select(F.col(id).alias("_gone")).distinct()
    gone = stored(gone, "gone")
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")
