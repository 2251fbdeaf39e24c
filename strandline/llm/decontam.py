"""Benchmark decontamination with a generalised suffix automaton (operator 8).

The normalised words of all benchmark items go into one suffix automaton. A
document's words stream through it once; at every word the automaton tells the
longest run of words, ending there, that occurs in some item. Where that run reaches
a window (``window`` words, or all words of a shorter item), its words are hit, and
the state names the items.

The items are broadcast as text, in shards of at most ``shard_words`` words, a bound
that does not grow with the documents nor with the benchmark; a larger benchmark
adds narrow passes over the documents, one per shard. No shuffle, no join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ROWS, lean
from strandline.session import ship_package

# bytes: lower-case A-Z, keep digits, letters and all bytes above 7F, blank the rest
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8").translate(NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of ``items`` [(id, words)]."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: State that ends the last ``window`` words of a state's runs (0 if they are shorter), and its items.
        self.ends: list[int] = []
        self.owners: dict[int, set[int]] = {}
        self.shorts: dict[int, list[tuple[int, int]]] = {}  # state -> whole short items that end its runs
        ids = [(i, w) for i, w in items if w]
        for item, run in ids:
            last = 0
            for word in run:
                last = self._add(word, last)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.ends = [0] * len(self.link)
        for state in order:
            if self.length[state] >= window:
                self.ends[state] = self.ends[self.link[state]] or state
        for item, run in ids:
            state = 0
            for word in run:
                state = self.next[state][word]
                if end := self.ends[state]:
                    self.owners.setdefault(end, set()).add(item)
            if len(run) < window:
                self.shorts.setdefault(state, []).append((item, len(run)))
        for state in order:  # what ends the suffix ends the run
            if above := self.shorts.get(self.link[state]):
                self.shorts[state] = [*above, *self.shorts.get(state, [])]

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        self.link[to] = copy
        return copy

    def _add(self, word: bytes, last: int) -> int:
        if (to := self.next[last].get(word)) is not None:  # an earlier item has this run
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def scan(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (start, end; merged) and the items found."""
        spans: list[list[int]] = []
        items: set[int] = set()
        next_, link, length, shorts, window = self.next, self.link, self.length, self.shorts, self.window
        root, state, matched = next_[0], 0, 0
        for i, word in enumerate(run):
            if not state:
                state = root.get(word, 0)
                matched = 1 if state else 0
            else:
                to = next_[state].get(word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = next_[state].get(word)
                state, matched = (to, matched + 1) if to is not None else (0, 0)
            if not state:
                continue
            reach = window if matched >= window else 0
            if reach:
                items |= self.owners[self.ends[state]]
            for item, size in shorts.get(state, ()):
                if size <= matched:
                    items.add(item)
                    reach = max(reach, size)
            if reach:
                if spans and spans[-1][1] >= i + 1 - reach:
                    spans[-1][1] = i + 1
                    while len(spans) > 1 and spans[-2][1] >= i + 1 - reach:
                        spans[-2][1] = spans.pop()[1]
                    spans[-1][0] = min(spans[-1][0], i + 1 - reach)
                else:
                    spans.append([i + 1 - reach, i + 1])
        return [(a, b) for a, b in spans], items


def shards(benchmark: DataFrame, item: str, text: str, shard_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most ``shard_words`` words (an item of more is a list of its own)."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    shard, held = [], 0
    for row in rows.orderBy("i", "t").toLocalIterator():
        n = len(words(row["t"]))
        if shard and held + n > shard_words:
            yield shard
            shard, held = [], 0
        shard.append((row["i"], row["t"]))
        held += n
    if shard:
        yield shard


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shard_words: int = 200_000,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word numbers, end exclusive; disjoint) and hit_items (sorted).

    A null or empty text has no words and no hits; null items and items without words
    find nothing; repeated items and repeated rows each count. Input columns of the
    added names are replaced.
    """
    return _marked(docs, benchmark, text, item, item_text, window, shard_words)


def _marked(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shard_words: int = 200_000,
    cut: bool = False,
) -> DataFrame:
    """``mark``; with ``cut`` the last pass takes the hit words out of the text, in the same Python worker."""
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("hit_spans", "hit_items", "n_words")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(text, F.col(f"`{text}`").cast("string"))
    out = frame.selectExpr(
        *[f"`{c}`" for c in kept],
        "CAST(array() AS ARRAY<STRUCT<start:INT,`end`:INT>>) AS hit_spans",
        "CAST(array() AS ARRAY<BIGINT>) AS hit_items",
        "CAST(0 AS BIGINT) AS n_words",
    )
    schema, sc = out.schema, docs.sparkSession.sparkContext
    all_ = [*shards(benchmark, item, item_text, shard_words)] or [[]]
    for i, shard in enumerate(all_, 1):
        out = out.mapInArrow(lean(_pass(sc.broadcast(shard), uuid.uuid4().hex, text, window, cut and i == len(all_)), ROWS), schema)
    return out


_BUILT: dict[str, Automaton] = {}


def automaton(key: str, items: list[tuple[int, str]], window: int) -> Automaton:
    """The last automaton a worker built, as its tasks follow each other on one shard."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton([(i, words(t)) for i, t in items], window)
    return _BUILT[key]


def _pass(shard, key: str, text: str, window: int, cut: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(key, shard.value, window)
        for batch in batches:
            spans, items, sizes, texts = [], [], [], []
            earlier = zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())
            for t, (old, known) in zip(batch.column(text).to_pylist(), earlier):
                run_words = words(t)
                new, found = machine.scan(run_words)
                both = union([(s["start"], s["end"]) for s in old] + new) if old else new
                spans.append([{"start": a, "end": b} for a, b in both])
                items.append(sorted(found.union(known)))
                sizes.append(len(run_words))
                if cut:
                    texts.append(without_hits(t, both))
            put = {"hit_spans": pa.array(spans, spans_type), "hit_items": pa.array(items, pa.list_(pa.int64())), "n_words": pa.array(sizes, pa.int64())}
            if cut:
                put[text] = pa.array(texts, pa.string())
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([put.get(c, batch.column(c)) for c in names], names=names)

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_hits(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the hit words; what stood between two hit words goes too."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8")
    blank = raw.translate(NORMAL)
    starts, ends, at = [], [], 0
    for word in blank.split():
        at = blank.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    coverage: float = 0.5,
    n_chars: str | None = "n_chars",
    **limits,
) -> DataFrame:
    """``docs`` without hit spans, and without documents of which ``coverage`` or more of the words are hit.

    Columns stay as they are; the text loses its hit words, and ``n_chars`` (if there)
    is counted anew where it did. Documents without a hit are untouched.
    """
    names = docs.columns
    marked = _marked(docs, benchmark, text, **limits, cut=True)
    hit = F.aggregate("hit_spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    out = marked.where((F.size("hit_spans") == 0) | (hit < coverage * F.col("n_words")))
    if n_chars in names:
        out = out.withColumn(n_chars, F.when(F.size("hit_spans") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars)))
    return out.select(*[F.col(f"`{c}`") for c in names])
