"""Language ID with hyperdimensional profiles (operator 7).

Every letter has a pseudo-random vector of +1 and -1. A run of three letters is bound
into one vector: the product of its letters' vectors, each rotated by its place.
A language's prototype is the bundle (sum) of the vectors of all its runs in the
labelled documents; a document is the bundle of its own, and takes the language of the
prototype with the largest cosine.

Bundling is linear, so neither side is summed run by run: training adds up how often
each run occurs per language (a pre-aggregated shuffle over all labelled documents)
and weights each run's vector once; a document's dot product with a prototype is the
sum of its runs' dot products, which a task computes once per distinct run. The length
of a document's bundle is taken from its run counts, sqrt(dim * sum(count ** 2)),
which differs from the summed vector's by the noise of random vectors only and not
between languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import GOLDEN, ROWS, lean, mix64
from strandline.session import ship_package

UNKNOWN = "und"
#: Dimensions of a letter vector.
DIM = 2048
#: Distinct runs that a task remembers, and runs of texts that it holds at once (a single text may have more).
REMEMBERED, HELD = 150_000, 200_000


@dataclass
class Profiles:
    """Unit prototypes, one row per language; a few kilobytes per language."""

    languages: list[str]
    vectors: np.ndarray


class _Letters:
    """Folded code point of every character; 32 for all that is not a letter."""

    def __init__(self):
        self.table = np.full(0x110000, 32, dtype=np.int64)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                self.table[cp] = cp

    def runs(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three (64-bit codes) and their counts; words are padded by one space."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = self.table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        if len(codes) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


_LETTERS: list[_Letters] = []


def letters() -> _Letters:
    if not _LETTERS:
        _LETTERS.append(_Letters())
    return _LETTERS[0]


def run_vectors(runs: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors (+1, -1 as int8) of coded runs."""

    def of(cp: np.ndarray) -> np.ndarray:
        lanes = np.arange(dim // 64, dtype=np.uint64) * GOLDEN
        words = mix64(mix64(cp.astype(np.uint64) + np.uint64(1))[:, None] + lanes[None, :])
        return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1

    mask = (1 << 21) - 1
    first, second, third = ((runs >> s) & mask for s in (42, 21, 0))
    return np.roll(of(first), 2, axis=1) * np.roll(of(second), 1, axis=1) * of(third)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> Profiles:
    """Prototypes from all rows with a text and a language."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where(
        "t IS NOT NULL AND l IS NOT NULL"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flush():
            for name, parts in seen.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(codes), pa.string()), "run": codes, "n": n})
            seen.clear()

        for batch in batches:
            for t, name in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                got = letters().runs(t)
                seen.setdefault(name, []).append(got)
                held += len(got[0])
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("l").to_pylist(), dtype=object)
            runs, n = batch.column("run").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            for at in range(0, len(runs), 4096):
                part = slice(at, at + 4096)
                vectors = run_vectors(runs[part], dim)
                for name in set(names[part]):
                    own = names[part] == name
                    sums[name] = sums.get(name, 0) + n[part][own] @ vectors[own].astype(np.float64)
        yield pa.RecordBatch.from_pydict(
            {"l": pa.array(list(sums), pa.string()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())}
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch.column("l").to_pylist(), batch.column("v").to_pylist()):
                sums[name] = sums.get(name, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_pydict(
            {"l": pa.array(list(sums), pa.string()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())}
        )

    counts = rows.mapInArrow(lean(count, ROWS), "l string, run long, n long").groupBy("l", "run").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(bundle, "l string, v binary").repartition("l").mapInArrow(add, "l string, v binary")
    found = sorted((r["l"], np.frombuffer(r["v"])) for r in sums.collect())  # one short row per language
    vectors = np.array([v / max(np.linalg.norm(v), 1e-12) for _, v in found]).reshape(len(found), dim)
    return Profiles([name for name, _ in found], vectors)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the largest cosine, 0 to 1).

    A text that is null or has no letter, and any text when no language was learned,
    gets ``und`` and 0. Equal cosines go to the language that sorts first. Texts of
    any length are read whole; rows are neither dropped nor merged. Input columns named
    lang_pred or score are replaced.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_hd_text")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_hd_text"))
    schema = frame.drop("_hd_text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value.languages, shared.value.vectors.T
        known, values = np.empty(0, np.int64), np.empty((0, len(names)))

        def judge(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[str, float]]:
            nonlocal known, values
            new = np.setdiff1d(np.concatenate([c for c, _ in found]), known)
            if len(new) and names:
                if len(known) > REMEMBERED:
                    known, values = known[:0], values[:0]
                    new = np.unique(np.concatenate([c for c, _ in found]))
                dots = [run_vectors(new[at : at + 4096], prototypes.shape[0]) @ prototypes for at in range(0, len(new), 4096)]
                known, values = np.concatenate([known, new]), np.concatenate([values, *dots])
                order = np.argsort(known)
                known, values = known[order], values[order]
            for codes, n in found:
                if not len(codes) or not names:
                    yield UNKNOWN, 0.0
                    continue
                cos = (n @ values[np.searchsorted(known, codes)]) / np.sqrt(prototypes.shape[0] * float(n @ n))
                at = int(np.argmax(cos))
                yield names[at], min(1.0, max(0.0, float(cos[at])))

        for batch in batches:
            judged, found, held = [], [], 0
            for t in batch.column("_hd_text"):
                found.append(letters().runs(t.as_py()))
                held += len(found[-1][0])
                if held > HELD:
                    judged += judge(found)
                    found, held = [], 0
            if found:
                judged += judge(found)
            best, cosine = [x for x, _ in judged], np.array([x for _, x in judged], dtype=np.float64)
            columns = [batch.column(c) for c in kept] + [pa.array(best, pa.string()), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return frame.mapInArrow(lean(score), schema)


