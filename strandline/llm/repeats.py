"""Substring dedup of paragraphs by MinHash banding (operator 9).

A text is cut into paragraphs at line ends; those of ``min_words`` words or more take
part. Shorter lines that follow each other (verse, lists, code, dialogue) are joined to
paragraphs of at least ``min_words`` words, which begin at lines whose hash is the least
among the ``min_words`` words on either side. That depends on near lines only, so copies
are cut alike but for the pieces at the ends of a run. Equal paragraphs are one from the start. Of the others, MinHash signatures are
cut into bands tuned for recall (the most rows per band that still find a pair at the
threshold with ``recall``); paragraphs that collide in a band are compared exactly, by
the Jaccard similarity of their word shingles. Links make clusters by connected
components, and of every cluster the first occurrence (smallest doc_id, then place)
stays while all others are removed. Long bands are never expanded into pairs (see the
scans of ``jaccard``).

Passages that repeat within paragraphs that are otherwise different are found by winnowing: of the
hashes of all runs of half of ``PASSAGE`` words those are kept that are least among as many
neighbours as make every run of ``PASSAGE`` words hold one. What lies between the first and the
last kept run that an earlier document has, too, is removed; fewer than half of ``PASSAGE`` words
at either end can stay, and shared runs of half to all of ``PASSAGE`` words can be found, too.

Null and empty texts have no paragraphs; rows without an id take no part; rows that
repeat an id are occurrences like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import BLANK, GOLDEN, ROWS, fold, lean, mix64, word_hashes
from strandline.llm.jaccard import HEAVY, Threshold, linked_classes, meeting, shingles
from strandline.session import ship_package, stored


def bands(threshold: float, hashes: int = 64, recall: float = 0.999) -> tuple[int, int]:
    """(bands, rows per band): the longest bands that find a pair at the threshold with ``recall``."""
    for rows in range(hashes, 0, -1):
        n = hashes // rows
        if 1 - (1 - threshold**rows) ** n >= recall:
            return n, rows
    return hashes, 1


def paragraphs(text: str | None, min_words: int) -> list[tuple[int, int, str]]:
    """(start, end, paragraph) in code points, of ``min_words`` words or more."""
    out, at, run = [], 0, []
    text = text or ""
    for line in text.split("\n"):
        n = len(line.split())
        if n >= min_words:
            out += [(a, b, text[a:b]) for a, b in joined(run, min_words)]
            out.append((at, at + len(line), line))
            run = []
        elif n:
            run.append((at, line, n))
        at += len(line) + 1
    return out + [(a, b, text[a:b]) for a, b in joined(run, min_words)]


def joined(run: list[tuple[int, str, int]], min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the paragraphs that consecutive short lines (start, line, words) make; none below ``min_words``."""
    total = sum(n for *_, n in run)
    if total < min_words:
        return []
    hashes = [zlib.crc32(" ".join(line.split()).encode("utf-8", "replace")) for _, line, _ in run]
    before = [0]
    for *_, n in run:
        before.append(before[-1] + n)
    firsts = [0]
    for i in range(1, len(run)):
        if not min_words <= before[i] <= total - min_words:
            continue
        low, high = i, i + 1
        while low and before[i] - before[low - 1] < min_words:
            low -= 1
        while high < len(run) and before[high] - before[i] < min_words:
            high += 1
        # of equal lines the first
        if all(h > hashes[i] for h in hashes[low:i]) and all(h >= hashes[i] for h in hashes[i + 1 : high]):
            firsts.append(i)
    lasts = [i - 1 for i in firsts[1:]] + [len(run) - 1]
    return [(run[a][0], run[b][0] + len(run[b][1])) for a, b in zip(firsts, lasts)]


def shingle_table(parts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of many paragraphs at once: their sorted distinct hashes one after the other, and the size of each."""
    data = b" ".join(p.encode("utf-8", "replace").lower() for p in parts)
    inside = np.frombuffer(data.translate(BLANK), dtype=np.uint8) != 32
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    of = np.searchsorted(np.cumsum([len(p.encode("utf-8", "replace")) + 1 for p in parts]), first, side="right")
    if np.bincount(of, minlength=len(parts)).min() < width:  # fewer words than a shingle has
        sets = [shingles(p, width) for p in parts]
        return np.concatenate(sets), np.array([len(x) for x in sets], dtype=np.int64)
    runs = fold(word_hashes(data), width)
    whole = of[width - 1 :] == of[: len(runs)]
    flat, of = runs[whole], of[: len(runs)][whole]
    order = np.lexsort((flat, of))
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])])
    return flat[new], np.bincount(of[new], minlength=len(parts))


def names_of(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``name`` of every set of a table."""
    sums = np.add.reduceat(mix64(flat ^ GOLDEN), np.cumsum(sizes) - sizes)
    return mix64(sums ^ sizes.astype(np.uint64)).view(np.int64)


def sketches_of(flat: np.ndarray, sizes: np.ndarray, rule: Threshold) -> list[bytes]:
    """``sketch`` of every set of a table: sets of one width are one matrix of parities."""
    widths = np.full(len(sizes), 64, dtype=np.int64)
    need = 16 * (2 * sizes * (rule.den - rule.num) // (rule.den + rule.num))
    while (narrow := widths < need).any():
        widths[narrow] *= 2
    out: list[bytes] = [b""] * len(sizes)
    of_width = np.repeat(widths, sizes)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), max(1, 8_000_000 // width)):
            part = rows[at : at + max(1, 8_000_000 // width)]
            chosen = np.zeros(len(sizes), dtype=bool)
            chosen[part] = True
            own = flat[np.repeat(chosen, sizes) & (of_width == width)]
            place = np.repeat(np.arange(len(part)), sizes[part]) * width + (own & np.uint64(width - 1)).astype(np.int64)
            bits = np.packbits((np.bincount(place, minlength=len(part) * width) & 1).astype(np.uint8), bitorder="little")
            for row, blob in zip(part.tolist(), bits.reshape(len(part), -1)):
                out[row] = blob.tobytes()
    return out


def stretches(batch: pa.RecordBatch, min_words: int, most: int = 1_000_000) -> Iterator[tuple[list[tuple[int, int, int]], list[str]]]:
    """(doc, start, end) and text of the paragraphs of a batch, about ``most`` characters at a time."""
    rows, parts, held = [], [], 0
    for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
        for start, end, part in paragraphs(text.as_py(), min_words):
            rows.append((doc, start, end))
            parts.append(part)
            held += len(part)
            if held > most:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def cut(docs: DataFrame, width: int, rule: Threshold, min_words: int) -> DataFrame:
    """Paragraphs of ``docs`` (doc, text): doc, start, end, n, words, set and sketch."""
    schema = "doc long, start int, `end` int, words int, n long, set long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, parts in stretches(batch, min_words):
                flat, sizes = shingle_table(parts, width)
                doc, start, end = zip(*rows)
                columns = [
                    pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                    pa.array([len(p.split()) for p in parts], pa.int32()), pa.array(sizes, pa.int64()),
                    pa.array(names_of(flat, sizes)), pa.array(sketches_of(flat, sizes, rule), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "end", "words", "n", "set", "sketch"])

    return docs.mapInArrow(run, schema)


def bits_of(keys: DataFrame, most: int = 1 << 27) -> np.ndarray:
    """Words of a bitmap of the low bits of hashes (column h): 16 bits or more for each, ``most`` (16 MB) at most."""
    size = 1 << min(most.bit_length() - 1, max(10, (16 * keys.count()).bit_length()))
    at = keys.select(F.expr(f"h & {size - 1}").alias("at"))
    set_ = at.selectExpr("at div 64 AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = set_.toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set: all that were put in, and few others."""
    at = hashes.view(np.int64) & np.int64(len(bits) * 64 - 1)
    return (bits[at // 64] >> (at % 64)) & 1 == 1


def pieces(docs: DataFrame, width: int, min_words: int, wanted: DataFrame) -> DataFrame:
    """(doc, text) of the paragraphs of the sets of ``wanted`` (set, home: a document that has it), where doc is the set's name.

    Bitmaps of a bounded size leave out nearly all other documents and paragraphs before they are shuffled.
    """
    sc = docs.sparkSession.sparkContext
    homes = sc.broadcast(bits_of(wanted.select(F.xxhash64("home").alias("h")).distinct()))
    sets = sc.broadcast(bits_of(wanted.select(F.col("set").alias("h"))))
    docs = docs.withColumn("h", F.xxhash64("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(homes.value, batch.column("h").to_numpy())))
            for _, parts in stretches(batch, min_words):
                names, at = np.unique(names_of(*shingle_table(parts, width)), return_index=True)
                own = marked(sets.value, names)
                names, at = names[own], at[own]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([parts[i] for i in at], pa.string())], names=["doc", "text"])

    return docs.mapInArrow(lean(run, ROWS), "doc long, text string")


def banded(docs: DataFrame, width: int, min_words: int, n_bands: int, rows: int) -> DataFrame:
    """Band entries (key, role, set, n) of the paragraphs' sets; a stretch of text gives those of a set once."""
    seeds = mix64(np.arange(1, n_bands * rows + 1, dtype=np.uint64) * GOLDEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, parts in stretches(batch, min_words):
                flat, sizes = shingle_table(parts, width)
                names, at = np.unique(names_of(flat, sizes), return_index=True)
                once = np.zeros(len(sizes), dtype=bool)
                once[at] = True
                flat, names, sizes = flat[np.repeat(once, sizes)], names_of(flat, sizes)[once], sizes[once]
                yield keys(flat, names, sizes)

    def keys(flat: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        starts = np.cumsum(sizes) - sizes
        out = []
        for band in range(n_bands):
            key = np.full(len(names), band, dtype=np.uint64)
            for seed in seeds[band * rows : (band + 1) * rows]:
                key = mix64((key + GOLDEN) ^ np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), starts))
            out.append(key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(out).view(np.int64)),
                pa.array(np.full(len(names) * n_bands, HEAVY, np.int8)),
                pa.array(np.tile(names, n_bands)),
                pa.array(np.tile(sizes, n_bands)),
            ],
            names=["key", "role", "set", "n"],
        )

    return docs.mapInArrow(run, "key long, role byte, set long, n long")


def repeated(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    num: int = 8,
    den: int = 10,
    min_words: int = 20,
    hashes: int = 64,
    recall: float = 0.999,
) -> DataFrame:
    """Every occurrence to be removed: id, start and end (code points), words, and kept_<id>, the document whose occurrence stays."""
    ship_package(docs.sparkSession)
    rule = Threshold(num, den)
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("doc IS NOT NULL")
    found = stored(cut(docs, width, rule, min_words), "paragraphs")
    sets = found.groupBy("set").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("doc").alias("home")).withColumn("doc", F.col("set"))
    sets = stored(sets, "sets")
    n_bands, rows = bands(num / den, hashes, recall)
    lists = stored(meeting(banded(docs, width, min_words, n_bands, rows)), "lists")
    labels = linked_classes(lists, lambda wanted: pieces(docs, width, min_words, wanted), sets, width, rule)

    places = found.select("doc", "start", "end", "words", "set").join(labels, "set", "left")
    places = stored(places.select("doc", "start", "end", "words", F.coalesce("label", "set").alias("label")), "places")
    firsts = places.groupBy("label").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("m")).where("m > 1")
    firsts = stored(firsts.select("label", "first"), "firsts")
    gone = places.join(firsts, "label").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return gone.select(F.col("doc").alias(id), "start", "end", "words", F.col("first.doc").alias(f"kept_{id}"))


#: Runs of so many words that repeat in other documents are found wherever they stand.
PASSAGE = 50
#: An odd factor and its inverse: sums of words times its powers give the hash of any run by one difference.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, dtype=np.uint64)]), dtype=np.uint64)[:n]


def anchors(text: str | None, words: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, start, end in code points) of the kept runs of ``words`` // 2 words."""
    k, none = words // 2, np.empty(0, np.int64)
    data = (text or "").encode("utf-8", "replace").lower()
    hashes = word_hashes(data)
    n = len(hashes) - k + 1
    if n < words - k + 1:
        return none, none, none, none
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(FACTOR, len(hashes)), dtype=np.uint64)])
    runs = mix64((sums[k:] - sums[:-k]) * powers(INVERSE, n))
    # the least of every window of neighbours, by doubling
    width, span, least = words - k + 1, 1, runs
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    # a run is kept that is the least of a window that holds it
    most = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    span = 1
    while 2 * span <= width:
        most, span = np.maximum(most[:-span], most[span:]), 2 * span
    if rest := width - span:
        most = np.maximum(most[:-rest], most[rest:])
    at = np.flatnonzero(most == runs)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.frombuffer(data.translate(BLANK), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first, last = points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]
    return runs[at].view(np.int64), at, first[at], last[at + k - 1]


def passages(docs: DataFrame, gone: DataFrame, id: str = "doc_id", text: str = "text", words: int = PASSAGE) -> DataFrame:
    """Passages, outside of the spans of ``gone``, that an earlier document has outside of them, too: rows as of ``repeated``."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("doc IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t, words) for t in batch.column("text").to_pylist()]
            doc = np.repeat(batch.column("doc").to_numpy(), [len(f[0]) for f in found])
            key, at, start, end = (np.concatenate(x) for x in zip(*found))
            columns = [pa.array(key), pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (at, start, end))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "at", "start", "end"])

    def shared(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
        return rows.join(keys.drop("last"), "key")

    found = stored(docs.mapInArrow(lean(run, ROWS), "key long, doc long, at int, start int, `end` int"), "anchors")
    met = stored(shared(found).drop("first"), "met")
    spans = gone.select(F.col(id).alias("of"), F.col("start").alias("from"), F.col("end").alias("to"))
    free = met.join(spans, (F.col("doc") == F.col("of")) & (F.col("start") < F.col("to")) & (F.col("end") > F.col("from")), "left_anti")
    hits = shared(stored(free, "free")).where("doc > first")
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    hits = hits.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = hits.groupBy("doc", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("at") + words // 2 - F.min("at")).cast("int").alias("words"), F.min("first").alias("first"),
    )
    return merged.select(F.col("doc").alias(id), "start", "end", "words", F.col("first").alias(f"kept_{id}"))


def without(docs: DataFrame, removals: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed paragraphs (their line ends go, too); rows without removals stay as they are."""
    spans = removals.groupBy(F.col(id).alias("_of")).agg(F.collect_set(F.struct("start", "end")).alias("_gone"))
    joined = docs.join(spans, docs[id] == spans["_of"], "left").drop("_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, gone in zip(batch.column(text).to_pylist(), batch.column("_gone").to_pylist()):
                for span in sorted(gone or [], key=lambda s: -s["start"]):
                    t = t[: span["start"]] + t[span["end"] + 1 :]
                texts.append(t)
            names = [c for c in batch.schema.names if c != "_gone"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return joined.mapInArrow(run, joined.drop("_gone").schema)
