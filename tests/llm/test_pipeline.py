"""The pipeline on a small corpus, against what its stages say in plain Python."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = text(30), text(100)
    near = base.split()
    near[50] = "changed"
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, "123 ... 456"), (5, "one"),
        (6, f"{text(80)} {passage} tail"), (7, f"x {passage} y"), (8, f"{text(40)} password = hunter2hunter2 {text(3)}"), (9, text(60)),
    ]
    docs = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # no language: 3, 4; near duplicates of 0: 1, 2; mostly benchmark: 7
    assert sorted(got) == [0, 5, 6, 8, 9]
    assert all(got[i]["text"] == t for i, t in rows if i in (0, 5, 9))
    assert passage not in got[6]["text"] and got[6]["text"].endswith("tail") and got[6]["n_chars"] == len(got[6]["text"])
    assert "hunter2" not in got[8]["text"] and "[SECRET]" in got[8]["text"]
    assert sorted(r["position"] for r in got.values()) == list(range(5))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "hide_secrets", "mix_sources"]
