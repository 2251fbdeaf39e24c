"""Importance resampling towards a target distribution (operator 12).

Features of a text are its words and its pairs of neighbouring words, hashed into
``buckets`` by CRC-32. The documents' and the target's counts per bucket give every
bucket a gain (a log likelihood ratio in thousandths); a document's weight is the mean
gain of its features, and adding Gumbel noise from a hash of its id and taking the
highest scores draws without replacement in proportion to the importance weights.

Hashing works on whole columns: the distinct features of a stretch of text are grouped
by length, each group is a matrix of bytes with one feature a row, and the checksums
of all its rows advance together, a column at a time. The buckets are then scattered
back to the occurrences. Very long features (junk without blanks) are cut into blocks that
are rows of one matrix; their checksums are combined by the linear step over zero bytes.

Words: A-Z in lower case, runs of digits, letters a-z and everything beyond ASCII.
Texts are read whole, in bounded stretches. Null and empty texts have no features and
weight 0. A null id is hashed as ``null`` and comes last among equal scores; rows that
repeat an id have the same noise and are drawn each on its own. An empty table gives no rows;
an empty target leaves only the documents' own counts. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SEGMENT, numbered, segments
from strandline.session import ship_package, stored

OWN = ("n_words", "n_features", "weight", "score", "rank")
#: Lower case, and a blank for every byte that is in no word.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Features longer than this are cut into blocks of BLOCK bytes.
LONG, BLOCK = 1024, 256


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


TABLE = _table()


def advance(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """CRC states of the rows of ``matrix`` (uint8) after all its columns."""
    for column in matrix.T:
        state = TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _over_zeros() -> np.ndarray:
    """For every byte of a state, what it becomes over BLOCK zero bytes (the step is linear)."""
    bits = np.arange(256, dtype=np.uint32)
    states = np.concatenate([bits << np.uint32(8 * k) for k in range(4)])
    return advance(states, np.zeros((1024, BLOCK), dtype=np.uint8)).reshape(4, 256)


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row."""
    n, length = matrix.shape
    state = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    if length <= LONG:
        return advance(state, matrix) ^ np.uint32(0xFFFFFFFF)
    head = length % BLOCK
    state = advance(state, matrix[:, :head])
    count = (length - head) // BLOCK
    blocks = advance(np.zeros(n * count, np.uint32), matrix[:, head:].reshape(n * count, BLOCK)).reshape(n, count)
    zeros = _over_zeros()
    for k in range(count):
        moved = zeros[0][state & np.uint32(255)]
        for byte in range(1, 4):
            moved = moved ^ zeros[byte][(state >> np.uint32(8 * byte)) & np.uint32(255)]
        state = moved ^ blocks[:, k]
    return state ^ np.uint32(0xFFFFFFFF)


def crc32_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of slices of ``data``: a matrix for each length, results back in the given order."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    borders = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, borders) if len(order) else []:
        length = int(lengths[group[0]])
        most = max(1, 8_000_000 // length)  # bytes of a matrix
        for at in range(0, len(group), most):
            rows = group[at : at + most]
            out[rows] = crc32_rows(data[starts[rows][:, None] + np.arange(length)])
    return out


def hashed(parts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every part, and the buckets of all words and of all pairs with the part that each is in.

    Returns (words per part, word buckets, part of a word, pair buckets, part of a pair).
    """
    none = np.empty(0, np.int64)
    raw = np.frombuffer(b" ".join(parts).translate(WORDS) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    inside = raw != 32
    after = np.zeros(len(raw), dtype=bool)
    after[1:] = inside[:-1] & ~inside[1:]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    of = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(of, minlength=len(parts))
    if not len(first):
        return n_words, none, none, none, none
    line = raw[inside | after]  # words with one blank after each
    sizes = np.flatnonzero(after) - first
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    words = words.dictionary_encode()
    ids, distinct = words.indices.to_numpy().astype(np.int64), len(words.dictionary)

    def once(codes: np.ndarray, n: int) -> np.ndarray:
        place = np.empty(n, np.int64)
        place[codes[::-1]] = np.arange(len(codes))[::-1]  # the first occurrence stays
        return place

    at = once(ids, distinct)
    of_word = crc32_slices(line, begin[at], sizes[at]) % np.uint32(buckets)
    near = np.flatnonzero(of[1:] == of[:-1])
    pairs = pa.array(ids[near] * distinct + ids[near + 1]).dictionary_encode()
    codes = pairs.indices.to_numpy()
    at = near[once(codes, len(pairs.dictionary))] if len(near) else near
    of_pair = crc32_slices(line, begin[at], sizes[at] + 1 + sizes[at + 1]) % np.uint32(buckets)
    return n_words, of_word[ids].astype(np.int64), of, of_pair[codes].astype(np.int64), of[near]


def stretches(texts: pa.Array) -> Iterator[tuple[list[int], list[bool], list[bytes]]]:
    """(row, whether its first word was seen, part) of all texts, about SEGMENT bytes at a time; null texts are left out."""
    rows, more, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        data = text.as_buffer()
        if data is None:
            continue
        for part, again in segments(data.to_pybytes().translate(WORDS), overlap=True):
            rows.append(i)
            more.append(again)
            parts.append(part)
            held += len(part)
            if held >= SEGMENT:
                yield rows, more, parts
                rows, more, parts, held = [], [], [], 0
    if parts:
        yield rows, more, parts


def occurrences(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words of each, (row, bucket) of every feature) of all texts, a stretch at a time."""
    for rows, more, parts in stretches(texts):
        rows, more = np.array(rows), np.array(more)
        n_words, words, of_words, pairs, of_pairs = hashed(parts, buckets)
        if more.any():  # the first word of a part that goes on was counted before
            first = np.searchsorted(of_words, np.flatnonzero(more & (n_words > 0)))
            words, of_words = np.delete(words, first), np.delete(of_words, first)
            n_words = n_words - (more & (n_words > 0))
        at = np.concatenate([rows[of_words], rows[of_pairs]])
        yield rows, n_words, np.stack([at, np.concatenate([words, pairs])])


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all ``docs`` per bucket; tasks add up their own before the shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in occurrences(batch.column(0), buckets):
                counts += np.bincount(found[1], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    texts = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """bucket, gain for every bucket: thousandths of the log of (t + 1)(S + B) / ((s + 1)(T + B)), rounded down."""
    both = bucket_counts(docs, text, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.union(bucket_counts(target, text, buckets).select("bucket", F.lit(0).cast("long"), "n"))
    both = both.union(docs.sparkSession.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    both = stored(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_ = both.agg(F.struct(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).alias("x")).scalar()
    ratio = ((F.col("t") + 1).cast("double") * (all_["s"] + buckets)) / ((F.col("s") + 1).cast("double") * (all_["t"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, text: str = "text", buckets: int = 10_000, keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text, if it is not to be kept) with n_words, n_features and weight."""
    ship_package(docs.sparkSession)
    values = np.zeros(buckets, dtype=np.int64)
    for row in gain.collect():  # one short row per bucket
        values[row["bucket"]] = row["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(values)
    kept = [c for c in docs.columns if c not in OWN and c != "_rs_text" and (keep_text or c != text)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").cast("binary").alias("_rs_text"))
    schema = frame.drop("_rs_text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, sums = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for rows, n_words, (at, bucket) in occurrences(batch.column(len(kept)), buckets):
                np.add.at(words, rows, n_words)
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                if len(own):
                    sums[own] += np.add.reduceat(shared.value[bucket[order]], first)
                    features[own] += np.diff(np.append(first, len(at)))
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(c) for c in (words, features, weight)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "n_features", "weight"])

    return frame.mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    percent: int = 25,
    buckets: int = 10_000,
    min_words: int = 20,
    seed: int = 7,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank (1, 2, ... of the drawn rows, else null).

    Of the rows with at least ``min_words`` words, floor(percent / 100) of their number are
    drawn, highest scores first, ties to the smaller id. All rows come back.
    """
    weighed = weigh(docs, gains(docs, target, text, buckets), text, buckets, keep_text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)
    # rows that can be drawn come first
    out = (F.col("n_words") < min_words).cast("int")
    rows = numbered(scored, [out, F.col("score").desc(), F.col(f"`{id}`").asc_nulls_last()], "rank", "scores")
    eligible = rows.agg(F.sum((F.col("n_words") >= min_words).cast("long")).alias("n"))
    eligible = eligible.select(F.expr(f"coalesce(n, 0) * {percent} div 100").alias("n"))
    return rows.withColumn("rank", F.when(F.col("rank") < eligible.scalar(), F.col("rank") + 1))
