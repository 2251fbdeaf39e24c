"""Passages within paragraphs that are otherwise different."""

import random

from strandline.llm import repeats


def test_passages_inside_paragraphs(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghü") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    passages = [words(51) for _ in range(8)]
    texts = [None, "", " ".join(words(60))]
    for i in range(32):
        texts.append(" ".join(words(70) + passages[i % 8] + words(90)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = repeats.repeated(docs)
    assert gone.count() == 0  # no paragraph is like another
    found = repeats.passages(docs, gone).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(11, 35))
    for r in found:
        i = r["doc_id"] - 3
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert part in " ".join(passages[i % 8]) and len(part.split()) == r["words"] >= 25 and r["kept_doc_id"] == 3 + i % 8
    assert repeats.passages(docs, docs.selectExpr("doc_id", "0 AS start", "9999 AS `end`")).count() == 0


def test_only_wanted_paragraphs_leave_the_tasks(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(200)], "doc long, text string")
    names = {r["doc"]: r["set"] for r in repeats.cut(docs, 5, repeats.Threshold(8, 10), 20).collect()}
    wanted = spark.createDataFrame([(names[i], i) for i in (3, 77)], "set long, home long")
    got = {r["doc"] for r in repeats.pieces(docs, 5, 20, wanted).collect()}
    assert {names[3], names[77]} <= got and len(got) < 20
