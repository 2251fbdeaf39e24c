"""Language-model scores by stupid backoff (operator 2).

The model is the corpus: counts of all word n-grams up to ``order`` over all documents.
A word scores f(context + word) / f(context) in the longest context with a count, times
``alpha`` per context given up; a word never seen elsewhere counts as one. Scores are
held out: a document's own occurrences are taken off every count, else each text would
find itself. A document's score is the mean log score of its words.

Count tables are partitioned by hash. Documents are spread over chunks of bounded size;
a chunk sends its distinct n-grams (sorted hashes of up to 64 bits, as differences) with their
counts to the partitions that own them, the partitions add up and send the totals back in
the same order, and the chunk joins them to its n-grams position by position and sums
per document. What is gathered grows with the corpus; no table is broadcast, and an
n-gram however frequent is one entry per chunk.

Null and empty texts have no words: n_words 0 and a null score. Repeated rows are
documents of their own, so copies raise each other's score. Texts are scored whole.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fold, mix64, word_hashes
from strandline.session import ship_package

#: Characters per chunk, and per partition of the count tables.
CHUNK, PART = 8_000_000, 8_000_000
#: Bits of a hash beyond those of the corpus size.
SPARE = 24


def packed(values: np.ndarray) -> bytes:
    """64-bit words by planes of bytes, compressed: high planes of small numbers are nearly empty."""
    planes = values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return b"".join(len(z).to_bytes(4, "big") + z for z in (zstandard.compress(p.tobytes(), 1) for p in planes))


def unpacked(data: bytes) -> np.ndarray:
    planes, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        planes.append(np.frombuffer(zstandard.decompress(data[at + 4 : end]), np.uint8))
        at = end
    return np.ascontiguousarray(np.stack(planes, axis=1)).view(np.uint64).ravel()


def hash_bits(size: int) -> int:
    """Bits of an n-gram's hash for a corpus of ``size`` bytes.

    They grow with the corpus, so that an n-gram meets a foreign one of the same hash
    with a chance of about one in 2 ** SPARE at every size up to 64 bits (1 TB).
    """
    return min(64, size.bit_length() + SPARE)


def ngrams(text: str | None, order: int, bits: int = 64) -> list[np.ndarray]:
    """Hashes (``bits`` high bits) of the text's n-grams for n = 1 .. order; equal n-grams of unlike n differ."""
    run = word_hashes(text.lower().encode("utf-8")) if text else np.empty(0, np.uint64)
    return [fold(run ^ mix64(np.array([n], np.uint64)), n) >> np.uint64(64 - bits) for n in range(1, order + 1)]


def distinct(grams: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    flat = [g for doc in grams for g in doc if len(g)]
    return np.unique(np.concatenate(flat), return_counts=True) if flat else (np.empty(0, np.uint64), np.empty(0, np.int64))


def others(grams: list[list[np.ndarray]], totals: np.ndarray) -> np.ndarray:
    """Per n-gram, document after document, the total count less its document's own; ``totals`` follow the sorted distinct n-grams."""
    flat = np.concatenate([g for doc in grams for g in doc])
    if not len(flat):
        return np.empty(0, np.int64)
    of = np.repeat(np.arange(len(grams), dtype=np.int32), [sum(map(len, doc)) for doc in grams])
    order = np.argsort(flat, kind="stable")  # keeps a document's equal n-grams together
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    starts = np.flatnonzero(new | np.concatenate([[True], of[1:] != of[:-1]]))
    own = np.diff(np.append(starts, len(flat)))
    del flat, of
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(totals[np.cumsum(new[starts]) - 1] - own, own)
    return out


def word_scores(counts: list[np.ndarray], total: int, alpha: float) -> np.ndarray:
    """Log scores of a document's words from the held-out counts of its n-grams per order."""
    n = len(counts[0])
    score = np.log(np.maximum(counts[0], 1) / max(total, 1))
    for k in range(2, min(len(counts), n) + 1):
        # n-gram i ends at word i + k - 1; its context is (k-1)-gram i
        whole, context = counts[k - 1], counts[k - 2][: n - k + 1]
        seen = whole > 0
        longer = np.where(seen, np.log(np.maximum(whole, 1)) - np.log(np.maximum(context, 1)), np.log(alpha) + score[k - 1 :])
        score = np.concatenate([score[: k - 1], longer])
    return score


def score(docs: DataFrame, text: str = "text", order: int = 3, alpha: float = 0.4, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """``docs`` (without the text) with n_words, log_score (sum) and mean_score; input columns of these names are replaced."""
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "n_words", "log_score", "mean_score", "_lm_chunk", "_lm_text")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_lm_text"))
    size = rows.agg(F.sum(F.octet_length("_lm_text"))).first()[0] or 0
    bits = hash_bits(size)
    chunks, parts = max(1, -(-size // chunk)), max(1, -(-size // part))
    # any even spread will do; repeated rows must not meet in one chunk
    spread = F.pmod(F.xxhash64("_lm_text", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    rows = rows.withColumn("_lm_chunk", spread).repartition("_lm_chunk")

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        grams = [ngrams(t, order, bits) for t in group.column("_lm_text").to_pylist()]
        found, n = distinct(grams)
        words = sum(len(g[0]) for g in grams)
        owner = ((found >> np.uint64(max(0, bits - 32))) * np.uint64(parts)) >> np.uint64(min(32, bits))  # grows with the hash
        edges = np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))
        out = [
            {"part": p, "chunk": key[0].as_py(), "words": words, "grams": packed(np.diff(found[a:b], prepend=np.uint64(0))), "n": packed(n[a:b])}
            for p, a, b in zip(range(parts), edges[:-1], edges[1:])
        ]
        return pa.Table.from_pylist(out, ASK)

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        asked = [np.cumsum(unpacked(g), dtype=np.uint64) for g in group.column("grams").to_pylist()]
        table, where = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(where, weights=np.concatenate([unpacked(n).astype(np.float64) for n in group.column("n").to_pylist()]), minlength=len(table))
        parts_of = np.split(totals.astype(np.uint64)[where], np.cumsum([len(a) for a in asked])[:-1])
        words = sum(group.column("words").to_pylist())
        out = [
            {"part": key[0].as_py(), "chunk": c, "words": words, "n": packed(own)} for c, own in zip(group.column("chunk").to_pylist(), parts_of)
        ]
        return pa.Table.from_pylist(out, ANSWER)

    def join(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        grams = [ngrams(t, order, bits) for t in group.column("_lm_text").to_pylist()]
        answers = answers.sort_by("part")
        totals = np.concatenate([unpacked(n) for n in answers.column("n").to_pylist()]).astype(np.int64)
        total = answers.column("words")[0].as_py()
        counts = others(grams, totals)
        n_words, sums, at = [], [], 0
        for doc in grams:
            n = len(doc[0])
            n_words.append(n)
            held_out = []
            for g in doc:
                held_out.append(counts[at : at + len(g)])
                at += len(g)
            sums.append(float(word_scores(held_out, total - n, alpha).sum()) if n else None)
        columns = [group.column(c) for c in kept]
        means = [None if s is None else s / n for s, n in zip(sums, n_words)]
        return pa.Table.from_arrays(
            [*columns, pa.array(n_words, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())],
            names=[*kept, "n_words", "log_score", "mean_score"],
        )

    asks = rows.groupBy("_lm_chunk").applyInArrow(ask, "part int, chunk int, words long, grams binary, n binary")
    answers = asks.groupBy("part").applyInArrow(answer, "part int, chunk int, words long, n binary")
    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_words", "long").add("log_score", "double").add("mean_score", "double")
    return rows.groupBy("_lm_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, schema)


ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("words", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())])
ANSWER = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("words", pa.int64()), ("n", pa.binary())])
