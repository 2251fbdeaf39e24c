"""Packing, importance resampling and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, merkle, packing, resampling
from tests.llm.test_operators import DOCS, corpus, frame

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Don't STOP, it's 'quoted' (x.y) foo's BAR'S 3.14 a1b2 snake_case",
    "é É ß ΑΣ. K kelvin. ä. ̈b ≮  x y z　w 漢字,かな 👍🏽 Å",
    "<|endoftext|> in a text, and <|STARTOFTEXT|>x",
    "tab\tline\nfeed\x0bv\x0cf\rc\x1cfs \x00nul \x7fdel x\x85y",
    "'s 't'll ''s a'sb 'S",
    "</w> a</w> w> &amp; !!! ?!. ...a... -- _",
    "x" * 300 + " " + "." * 200,
]


def plain(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_segments():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "d" * 30, " ", "  ", " " * 25]) for _ in range(rng.randint(0, 40))).encode()
        assert b"".join(s for s, _ in common.segments(text, False, 10)) == text
        seen = []
        for part, again in common.segments(text, True, 10):
            words = part.split()
            if again:
                assert words[0] == seen[-1]
            seen += words[again:]
        assert seen == text.split()


def test_tokens_equal_the_tokenizer(spark, monkeypatch, tokenizer):
    texts = corpus(5, 30) + ODD + ["word " * 900, " ".join(f"w{i}" for i in range(1200))]
    for most in (2_000_000, 40):
        monkeypatch.setattr(common, "SEGMENT", most)
        monkeypatch.setattr(packing, "SEGMENT", most)
        monkeypatch.setattr(packing, "REMEMBERED", 50)
        import pyarrow as pa

        column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
        found = dict((row, ids.tolist()) for row, ids in packing.Tokens(TOKENIZER, 0).batches(column))
        for i, t in enumerate(texts):
            assert found[i] == plain(t, tokenizer), t


def test_packing(spark, tokenizer):
    texts = corpus(1, 80) + ODD + [" ".join(f"word{i}" for i in range(n)) for n in (30, 700, 3000)]
    docs = frame(spark, texts + texts[:5]).withColumn("length", F.lit("own"))  # a clashing name goes
    pieces = packing.tokenized(docs.select("doc_id", "text", "length", "source"), TOKENIZER, capacity=64, keep_ids=True)
    got = packing.pack(pieces, capacity=64, group=40).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append(r)
    assert set(parts) == set(range(len(texts) + 5))
    for i, t in enumerate(texts + texts[:5]):
        own = sorted(parts[i], key=lambda r: r["piece"])
        ids = plain(t, tokenizer)
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 64)))
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["length"] == 64 for r in own[:-1]) and all(r["start"] == 64 * r["piece"] for r in own)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 4  # groups of about forty pieces
    joined = packing.sequences(packing.pack(pieces, capacity=64, group=40)).collect()
    assert sum(r["n_ids"] for r in joined) == sum(r["length"] for r in got) and max(r["n_ids"] for r in joined) <= 64
    assert packing.pack(packing.tokenized(docs.where("false").select("doc_id", "text"), TOKENIZER)).collect() == []


def test_packing_of_copies_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "same text here")] * 500 + [(7, None)] * 3, "doc_id long, text string").repartition(4)
    got = packing.pack(packing.tokenized(rows, TOKENIZER, capacity=10), capacity=10, group=50)
    assert got.count() == 503
    worst = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("m"))
    assert worst.where("n > 10 OR k <> m").isEmpty()
    assert worst.count() <= 252  # two documents of four ids, and the short ones


def optimum(lengths, capacity):
    """Least number of bins, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def put(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + lengths[i] <= capacity and fills[k] not in fills[:k]:
                put(i + 1, fills[:k] + [fills[k] + lengths[i]] + fills[k + 1 :])
        put(i + 1, fills + [lengths[i]])

    put(0, [])
    return best[0]


def test_local_search_empties_bins():
    rng = random.Random(2)
    lost = 0
    for _ in range(150):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 11))]
        n = len(set(packing.packed(lengths, 100)[0].tolist()))
        lost += n - optimum(lengths, 100)
        assert n >= optimum(lengths, 100)
    assert lost <= 2
    # first fits that only exchanges can mend
    bins = packing.Bins([40, 36, 35, 28, 21, 20, 16, 14, 12, 11, 4, 3], 60)
    bins.best_fit()
    before = len(bins.members), sum(f * f for f in bins.fill)
    bins.search()
    after = sum(1 for m in bins.members if m), sum(f * f for f in bins.fill)
    assert (before[0], after[0]) == (5, 4) and after[1] > before[1]
    for _ in range(200):
        capacity = rng.choice([50, 100, 1000])
        bins = packing.Bins([rng.randint(1, capacity // rng.choice([1, 2, 3])) for _ in range(rng.randint(2, 60))], capacity)
        bins.best_fit()
        squares = [sum(f * f for f in bins.fill)]
        live = [b for b in range(len(bins.fill)) if bins.fill[b] < capacity]
        bins.arrays(live)
        while len(live) > 1 and bins.step(min(live, key=lambda b: bins.fill[b])):
            squares.append(sum(f * f for f in bins.fill))
            assert squares[-1] > squares[-2] and max(bins.fill) <= capacity
            live = [b for b in live if bins.members[b]]
            bins.arrays(live)
        assert sorted(i for m in bins.members for i in m) == list(range(len(bins.lengths)))


def test_crc_rows():
    rng = np.random.default_rng(0)
    for length in (0, 1, 2, 7, 64, 1024, 1025, 1300, 5000):
        matrix = rng.integers(0, 256, (5, length), dtype=np.uint8)
        assert resampling.crc32_rows(matrix).tolist() == [zlib.crc32(row.tobytes()) for row in matrix]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("segment", [2_000_000, 50])
def test_resampling(spark, monkeypatch, segment):
    monkeypatch.setattr(common, "SEGMENT", segment)
    monkeypatch.setattr(resampling, "SEGMENT", segment)
    texts = corpus(4, 60) + ODD + ["?" * 300, "a" + "!" * 200 + "b", "é" * 700, "long " * 500]
    target = corpus(9, 30) + [None, ""]
    rows = [(i, t, 5, "mine") for i, t in enumerate(texts)] + [(None, texts[20], 5, "mine")] * 2 + [(3, texts[30], 5, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, _rs_text string").repartition(5)
    found = [features(t) for _, t, *_ in rows]
    s = Counter(zlib.crc32(f.encode()) % 97 for _, fs in found for f in fs)
    t = Counter(zlib.crc32(f.encode()) % 97 for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 97) / ((s[b] + 1) * (T + 97)))) for b in range(97)]
    want = []
    for (i, *_), (words, fs) in zip(rows, found):
        weight = sum(gain[zlib.crc32(f.encode()) % 97] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((i, len(words), len(fs), weight, score))
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], math.inf if w[0] is None else w[0]))
    drawn = len(able) * 40 // 100
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=40, buckets=97).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, drawn + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(w[0], w[4]) for w in able[:drawn]]


def test_resampling_of_empty_tables(spark):
    docs = frame(spark, ["a b c"] * 3)
    none = docs.where("false")
    assert resampling.resample(none, docs).collect() == []
    got = resampling.resample(docs, none.select("text"), min_words=1, percent=100, keep_text=True).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and {r["text"] for r in got} == {"a b c"}
    one = resampling.resample(spark.createDataFrame([(1, None)], "doc_id long, text string"), docs).collect()
    assert [(r["n_features"], r["weight"], r["rank"]) for r in one] == [(0, 0, None)]


def test_layout():
    for levels in range(1, 11):
        seen = np.concatenate([merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)])
        assert sorted(seen.tolist()) == list(range((1 << levels) - 1))
    # four levels: the root's three nodes, then four subtrees of three nodes
    assert merkle.address(4, 0, [0]).tolist() == [0] and merkle.address(4, 1, [0, 1]).tolist() == [1, 2]
    assert merkle.address(4, 2, [0, 1, 2, 3]).tolist() == [3, 6, 9, 12]
    assert merkle.address(4, 3, [0, 1, 6, 7]).tolist() == [4, 5, 13, 14]


def tree(level):
    """Root and the siblings (side, hash) of every leaf."""
    own = [[i] for i in range(len(level))]
    proof = [[] for _ in level]
    while len(level) > 1:
        up, members = [], []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            for side, one, other in (("R", i, i + 1), ("L", i + 1, i)):
                if one < len(level):
                    for leaf in own[one]:
                        proof[leaf].append((side, level[other]) if other < len(level) else ("-", None))
            up.append(hashlib.sha256("".join(pair).encode()).hexdigest())
            members.append([x for k in range(i, min(i + 2, len(level))) for x in own[k]])
        level, own = up, members
    return level[0], proof


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([None, *range(60)]), rng.choice(corpus(2, 30)), rng.choice([None, "", "en", "de", "é", "Z"]), "s", 3, "x") for _ in range(90)]
    rows += [(5, "same", "en", None, None, "x")] * 9 + [(6, "y" * 200_000, "one", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string").repartition(4)

    def leaf(r):
        text = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1]))
        return hashlib.sha256(text.encode()).hexdigest()

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for name in langs:
        groups[name].sort(key=lambda x: x[:3])
        subs[name] = tree([x[2] for x in groups[name]])
    root, upper = tree([subs[name][0] for name in langs])
    want = []
    for k, name in enumerate(langs):
        for x, proof in zip(groups[name], subs[name][1]):
            path = proof + upper[k]
            want.append((str(x[3]), x[2], subs[name][0], root, [h for _, h in path if h], "".join(s for s, _ in path)))
    found = merkle.manifest(docs, carry=("doc_id", "root"), bits=bits)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof", "sides"]
    got = [tuple([str(r[0]), *r[1:]]) for r in found.collect()]
    assert sorted(got) == sorted(want)
    up = found.withColumn("up", merkle.folded(F.col("leaf"), F.col("proof"), F.col("sides")))
    assert up.where("up <> root").isEmpty()
    bad = found.withColumn("up", merkle.folded(F.sha2("leaf", 256), F.col("proof"), F.col("sides")))
    assert bad.where("up = root").isEmpty()


def test_manifest_of_small_tables(spark):
    docs = spark.createDataFrame([(1, "t", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(docs.where("false")).collect() == []
    r = merkle.manifest(docs).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof"] == [] and r["sides"] == ""
    up = merkle.manifest(docs).select(merkle.folded(F.col("leaf"), F.col("proof"), F.col("sides")).alias("up")).first()["up"]
    assert up == r["root"]
