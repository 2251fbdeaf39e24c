"""Best-fit packing of tokenised documents by swap-based local search (operator 11).

Documents become token ids and an end id; one longer than a sequence is cut into pieces.
Pieces are dealt at random into groups of bounded size, and every group is packed in
a task of its own: best fit, longest first, then a local search between underfull bins
that moves a piece, or exchanges one for one, two for one or one for two, whenever this
increases the sum of squared fills. That drains the emptiest bins into the others until
they are empty. What a group leaves with more than a small gap is dealt into fewer
groups with the leavings of the others and packed again, so gaps do not add up over
groups. Pieces of any number with the same length, text or id are spread by the
place where they were read.

Tokenising works on distinct strings: text is cut at white space and between ASCII letters and
marks, where the tokenizer cuts, too; every distinct string is tokenised once per
worker (a bounded memory) and ids are gathered. This holds for tokenizers
that work on words with a word-end suffix, white space dropped and ASCII letters in
lower case; texts that contain a string of the tokenizer's added tokens are tokenised whole.

Null and empty texts are the end id alone. Rows that repeat an id are pieces like any
other. An empty table gives no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from strandline.llm.common import segments
from strandline.session import ship_package, stored

OWN = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
#: Strings whose ids a task remembers, and bytes of text that it cuts at once.
REMEMBERED = 300_000
SEGMENT = 1_000_000
#: White space, ASCII letter, ASCII mark (but the apostrophe), anything else.
KIND = np.array(
    [
        0 if b == 32 or 9 <= b <= 13 else 1 if chr(b).isalpha() and b < 128 else 2 if 33 <= b < 127 and not 48 <= b <= 57 and b != 39 else 3
        for b in range(256)
    ],
    dtype=np.uint8,
)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Tokens:
    """Ids of texts by a tokenizer file; number 0 of the known strings is the end id."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task, and one heap
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.array([self.end], dtype=np.uint32)
        self.starts = np.array([0], dtype=np.int64)
        self.sizes = np.array([1], dtype=np.int64)
        self.uses = np.zeros(1, dtype=np.int32)  # stretches of text that had the string

    def thin(self, most: int) -> None:
        """Forget all strings but the ``most`` used that were used more than once."""
        often = np.flatnonzero(self.uses > 1)
        kept = np.sort(often[np.argsort(-self.uses[often], kind="stable")[:most]])
        number = np.zeros(len(self.uses), dtype=np.int64)
        number[kept] = np.arange(1, len(kept) + 1)
        self.known = {s: int(number[n]) for s, n in self.known.items() if number[n]}
        kept = np.concatenate([[0], kept])
        sizes = self.sizes[kept]
        starts = np.cumsum(sizes) - sizes
        self.flat = self.flat[np.repeat(self.starts[kept] - starts, sizes) + np.arange(sizes.sum())]
        self.starts, self.sizes, self.uses = starts, sizes, self.uses[kept] // 2

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings, joined, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, strings: list[bytes]) -> None:
        """Tokenise strings; those of ASCII letters are one word each and go in together."""
        words = [s for s in strings if s.isalpha()]
        others = [s for s in strings if not s.isalpha()]
        flat, sizes = [], []
        for at in range(0, len(words), 200):
            ids, _ = self.encode([b" ".join(words[at : at + 200]).decode()])
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))  # a word ends where its last token does
        for at in range(0, len(others), 1000):
            ids, counts = self.encode([s.decode() for s in others[at : at + 1000]])
            flat.append(ids)
            sizes.append(counts)
        self.known.update(zip(words + others, range(len(self.sizes), len(self.sizes) + len(strings))))
        counts = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(counts), dtype=np.int32)])
        self.flat = np.concatenate([self.flat, *flat])

    def of(self, parts: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of texts, joined, and how many each has; parts that end a text get the end id."""
        raw = np.frombuffer(b" ".join(p for p, _ in parts).translate(LOWER) + b" ", dtype=np.uint8)
        kind = KIND[raw]
        first = np.ones(len(raw), dtype=bool)
        first[1:] = (kind[:-1] == 0) | ((kind[1:] != kind[:-1]) & (kind[1:] != 3) & (kind[:-1] != 3))
        inside = kind != 0
        place = np.flatnonzero(first & inside)
        offsets = np.append((np.cumsum(inside) - 1)[place], inside.sum()).astype(np.int32)
        strings = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        strings = strings.dictionary_encode()
        distinct = strings.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.thin(REMEMBERED // 2)
        found = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            self.learn([distinct[i] for i in new])
            found[new] = [self.known[distinct[i]] for i in new]
        self.uses[found] += 1
        codes = found[strings.indices.to_numpy()] if distinct else found
        until = np.searchsorted(place, np.cumsum([len(p) + 1 for p, _ in parts]))  # strings up to the end of each part
        last = np.array([end for _, end in parts])
        codes = np.insert(codes, until[last], 0)
        until = until + np.cumsum(last)
        sizes = self.sizes[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[codes] - before[:-1], sizes) + np.arange(before[-1])
        return self.flat[at], np.diff(before[until], prepend=0)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every text in turn; long ones are tokenised in stretches."""
        parts: list[tuple[bytes, bool]] = []
        rows: list[int] = []
        held, pending = 0, []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal held, pending
            if not parts:
                return
            ids, counts = self.of(parts)
            for row, (_, end), own in zip(rows, parts, np.split(ids, np.cumsum(counts)[:-1])):
                pending.append(own)
                if end:
                    yield row, np.concatenate(pending) if len(pending) > 1 else own
                    pending = []
            parts.clear()
            rows.clear()
            held = 0

        for row, text in enumerate(texts):
            buffer = text.as_buffer()
            data = b"" if buffer is None else buffer.to_pybytes()
            if any(a in data for a in self.added):
                yield from flush()
                yield row, np.append(self.encode([data.decode()])[0], np.uint32(self.end))
                continue
            stretches = [part for part, _ in segments(data, overlap=False, most=SEGMENT)]
            for k, part in enumerate(stretches, 1):
                parts.append((part, k == len(stretches)))
                rows.append(row)
                held += len(part)
                if held >= SEGMENT:
                    yield from flush()
        yield from flush()


def tokenized(
    docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = 2048, end: int = 0, keep_ids: bool = False
) -> DataFrame:
    """Pieces of ``docs``: its columns but the text, with piece, start, length and ids_crc32, and ids if they are to be kept.

    ``tokenizer``: path of a tokenizer file that every task can read.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c not in OWN and c not in (text, "_pk_text")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").cast("binary").alias("_pk_text"))
    schema = frame.drop("_pk_text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if keep_ids:
        schema = schema.add("ids", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer, end)
        for batch in batches:
            rows, pieces, starts, lengths, sums, ids, held = [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(kept))]
                columns += [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for row, found in tokens.batches(batch.column(len(kept))):
                for n, at in enumerate(range(0, len(found), capacity)):
                    part = found[at : at + capacity]
                    rows.append(row)
                    pieces.append(n)
                    starts.append(at)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if keep_ids:
                        ids.append(part.astype(np.int64))
                        held += len(part)
                if held > 2_000_000:
                    yield out()
                    rows, pieces, starts, lengths, sums, ids, held = [], [], [], [], [], [], 0
            if rows:
                yield out()
            pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)


class Bins:
    """Bins of pieces (numbers into ``lengths``) in one group."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.members: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that it fits."""
        gaps: list[tuple[int, int]] = []  # (gap, bin), ascending
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            at = bisect.bisect_left(gaps, (n, -1))
            if at < len(gaps):
                gap, b = gaps.pop(at)
                self.members[b].append(i)
                self.fill[b] += n
            else:
                gap, b = self.capacity, len(self.members)
                self.members.append([i])
                self.fill.append(n)
            if gap > n:
                bisect.insort(gaps, (gap - n, b))

    def arrays(self, bins: list[int]) -> None:
        """Pieces of the receiving bins as columns."""
        self.item = np.array([i for b in bins for i in self.members[b]], dtype=np.int64)
        self.bin = np.array([b for b in bins for _ in self.members[b]], dtype=np.int64)
        self.long = np.array(self.lengths, dtype=np.int64)[self.item] if len(self.item) else self.item
        self.bins = np.array(bins, dtype=np.int64)
        self.fills = np.array(self.fill, dtype=np.int64)

    def step(self, donor: int) -> bool:
        """The exchange of the donor with a fuller bin that adds most to the squared fills, if one adds."""
        out = sorted({self.lengths[i]: i for i in self.members[donor]}.items(), reverse=True)
        own = self.fill[donor]
        rest = self.bins[self.bins != donor]
        rest = rest[self.fills[rest] >= own]
        if not len(rest):
            return False
        # move: the largest piece into the fullest bin it fits
        gaps = self.capacity - self.fills[rest]
        best = (0, None)
        for n, i in out:
            fits = np.flatnonzero(gaps >= n)
            if len(fits):
                b = int(rest[fits[np.argmin(gaps[fits])]])
                best = max(best, (2 * n * (self.fill[b] - own + n), ([i], b, [])), key=lambda x: x[0])
        if best[1]:
            return self.swap(donor, *best[1])
        ok = (self.bin != donor) & (self.fills[self.bin] >= own)
        item, bin_, long = self.item[ok], self.bin[ok], self.long[ok]
        room = self.capacity - self.fills[bin_]
        pairs = [(a[0] + b[0], [a[1], b[1]]) for k, a in enumerate(out) for b in out[k + 1 :]]
        same = [n for n, _ in out if sum(self.lengths[i] == n for i in self.members[donor]) > 1]
        pairs += [(2 * n, [i for i in self.members[donor] if self.lengths[i] == n][:2]) for n in same]
        # one for one, two for one
        for n, given in [(n, [i]) for n, i in out] + pairs:
            d = n - long
            good = np.flatnonzero((d > 0) & (d <= room))
            if len(good):
                gain = 2 * d[good] * (self.fills[bin_[good]] - own + d[good])
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (int(gain[k]), (given, int(bin_[good[k]]), [int(item[good[k]])]))
        if best[1]:
            return self.swap(donor, *best[1])
        # one for two: a pair of one of the fullest bins that makes room
        for b in rest[np.argsort(gaps, kind="stable")][:256]:
            held = sorted({self.lengths[i]: i for i in self.members[b]}.items())
            gap = self.capacity - self.fill[b]
            sizes = np.array([n for n, _ in held])
            both = np.triu(sizes[:, None] + sizes[None, :], 1)
            for n, i in out:
                d = np.where(both > 0, n - both, 0)
                d = np.where(d <= gap, d, 0)
                k = int(np.argmax(d))
                if d.flat[k] > 0:
                    return self.swap(donor, [i], int(b), [held[k // len(held)][1], held[k % len(held)][1]])
        return False

    def swap(self, donor: int, given: list[int], b: int, taken: list[int]) -> bool:
        d = sum(self.lengths[i] for i in given) - sum(self.lengths[i] for i in taken)
        self.members[donor] = [i for i in self.members[donor] if i not in given] + taken
        self.members[b] = [i for i in self.members[b] if i not in taken] + given
        self.fill[donor] -= d
        self.fill[b] += d
        self.fills[donor], self.fills[b] = self.fill[donor], self.fill[b]
        gone, come = np.isin(self.item, given), np.isin(self.item, taken)
        self.bin[gone], self.bin[come] = b, donor
        return True

    def search(self, donors: int = 32) -> None:
        """Drain the emptiest bin, or the next ones up to ``donors``, as long as an exchange adds to the squared fills.

        The sum is a whole number and every exchange adds to it, so the search ends. Where
        the gaps come to less than a bin, no bin can be emptied, and only the emptiest is drained.
        """
        bins = [b for b in range(len(self.fill)) if self.fill[b] < self.capacity]
        self.arrays(bins)
        while bins:
            fills = self.fills[self.bins]
            spare = (self.capacity - fills).sum() >= self.capacity
            order = self.bins[np.argsort(fills, kind="stable")[: donors if spare else 1]].tolist()
            donor = next((b for b in order if self.step(b)), None)
            if donor is None:
                break
            if not self.members[donor]:
                bins.remove(donor)
                self.arrays(bins)


def packed(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, gap of the bin) of every piece."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    out = np.zeros((3, len(lengths)), dtype=np.int64)
    for n, members in enumerate(m for m in bins.members if m):
        at = 0
        for i in members:
            out[0, i], out[1, i] = n, at
            at += lengths[i]
        out[2, members] = capacity - at
    return out[0], out[1], out[2]


def group_packer(capacity: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        bin_, offset, gap = packed(table.column("length").to_pylist(), capacity)
        group = table.column("_pk_group")[0].as_py()
        table = table.append_column("sequence_id", pa.array(bin_ + (group << 24) + (turn << 57)))
        return table.append_column("offset", pa.array(offset)).append_column("_pk_gap", pa.array(gap))

    return run


def pack(pieces: DataFrame, capacity: int = 2048, group: int = 16_384) -> DataFrame:
    """``pieces`` (column length, 1 to ``capacity``) with sequence_id and offset, gapless from 0 in every sequence.

    ``group``: pieces of a group, on average. Every round deals what is left with a gap
    above 1/64 of the capacity into fewer groups, until one group takes all, nothing could
    be won, or a round settles less than half of its pieces (those keep their places).
    """
    ship_package(pieces.sparkSession)
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("_pk_row"))
    rows = stored(rows, "pieces")
    n = rows.count()
    done, turn = [], 0
    while True:
        groups = max(1, -(-n // group))
        dealt = rows.withColumn("_pk_group", F.pmod(F.xxhash64("_pk_row", F.lit(turn)), F.lit(groups)))
        schema = StructType([*dealt.schema.fields]).add("sequence_id", "long").add("offset", "long").add("_pk_gap", "long")

        placed = stored(dealt.groupBy("_pk_group").applyInArrow(group_packer(capacity, turn), schema), "packed").drop("_pk_group")
        left = placed.where(F.col("_pk_gap") > capacity // 64)
        facts = left.agg(F.count("*").alias("n"), F.sum(F.when(F.col("offset") == 0, F.col("_pk_gap"))).alias("gap")).first()
        if groups == 1 or (facts["gap"] or 0) < capacity or 2 * facts["n"] > n:
            done.append(placed)
            break
        done.append(placed.where(F.col("_pk_gap") <= capacity // 64))
        rows, n, turn = left.drop("sequence_id", "offset", "_pk_gap"), facts["n"], turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*[F.col(f"`{c}`") for c in keep], "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_ids and ids of every sequence, from placed pieces with their ids."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    found = placed.groupBy("sequence_id").agg(members.alias("m")).select("sequence_id", F.flatten("m.ids").alias("ids"))
    return found.select("sequence_id", F.size("ids").cast("long").alias("n_ids"), "ids")
