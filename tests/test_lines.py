"""The chunked helpers against plain windows, with tiny chunks to force borders."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import lines as ln


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, float(v)) for k, n in ((1, 41), (2, 1), (3, 2), (4, 16)) for i, v in enumerate(rng.random(n))]
    return spark.createDataFrame(rows, "line_id BIGINT, seq INT, v DOUBLE").repartition(5).cache()



def by_seq():
    return Window.partitionBy("line_id").orderBy("seq")


def same(a, b, cols):
    return sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


@pytest.mark.parametrize("width", [2, 4, 5, 4096])
def test_neighbours(walk, width):
    cols = ["line_id", "seq", "p", "n"]
    got = ln.with_neighbours(walk, ["v"], width=width).select(
        "line_id", "seq", F.coalesce("prev.v", F.lit(-1.0)).alias("p"), F.coalesce("next.v", F.lit(-1.0)).alias("n")
    )
    want = walk.select(
        "line_id", "seq", F.lag("v", 1, -1.0).over(by_seq()).alias("p"), F.lead("v", 1, -1.0).over(by_seq()).alias("n")
    )
    assert same(got, want, cols)


@pytest.mark.parametrize("width", [2, 4, 5, 4096])
def test_neighbours_wrap(walk, width):
    full = by_seq().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = ln.with_neighbours(walk, ["v", "seq"], wrap=True, width=width).select(
        "line_id", "seq", F.col("prev.v").alias("p"), F.col("next.v").alias("n")
    )
    want = walk.select(
        "line_id", "seq",
        F.coalesce(F.lag("v").over(by_seq()), F.last("v").over(full)).alias("p"),
        F.coalesce(F.lead("v").over(by_seq()), F.first("v").over(full)).alias("n"),
    )
    assert same(got, want, ["line_id", "seq", "p", "n"])


@pytest.mark.parametrize("width", [3, 8, 1 << 20])
def test_running_and_previous_with_gaps(walk, width):
    sparse = walk.where(F.col("seq") % 3 != 1)
    got = ln.running(sparse, {"k": F.lit(1), "s": F.col("seq")}, width=width)
    want = sparse.select("line_id", "seq", F.row_number().over(by_seq()).alias("k"), F.sum("seq").over(by_seq()).alias("s"))
    assert same(got, want, ["line_id", "seq", "k", "s"])
    prev = ln.previous_row(sparse, ["seq"], ["line_id"], "seq", width=width).select(
        "line_id", "seq", F.coalesce("prev.seq", F.lit(-1)).alias("p")
    )
    assert same(prev, sparse.select("line_id", "seq", F.lag("seq", 1, -1).over(by_seq()).alias("p")), ["line_id", "seq", "p"])


def test_attach(walk):
    agg = walk.groupBy("line_id").agg(F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"), F.sum("v").alias("t"))
    got = ln.attach(walk, agg, width=3)
    assert same(got, walk.join(agg, "line_id"), ["line_id", "seq", "t"])


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("width", [1, 4, 4096])
def test_halo_of_two(spark, wrap, width):
    """Two steps to neighbours on one window, over chunk borders and round the ends of lines of any size."""
    from strandline.lines import with_halo

    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 23}
    rows = [(k, i + 1, float((i * 7) % 11)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "line_id string, seq int, v double").repartition(3)
    spread, along = with_halo(df, 2, wrap=wrap, width=width)
    step = spread.withColumn("s", F.lag("v").over(along) * 2 + F.lead("v").over(along))
    step = step.withColumn("t", F.lag("s").over(along) - F.lead("s").over(along)).where("_own")
    got = {(r.line_id, r.seq): r.t for r in step.collect()}
    assert len(got) == len(rows)
    for k, n in sizes.items():
        v = [x for name, _, x in rows if name == k]

        def at(values, i):
            return values[i % n] if wrap else (values[i] if 0 <= i < n else None)

        def both(a, b, f):
            return None if a is None or b is None else f(a, b)

        s = [both(at(v, i - 1), at(v, i + 1), lambda a, b: 2 * a + b) for i in range(n)]
        for i in range(n):
            assert got[k, i + 1] == both(at(s, i - 1), at(s, i + 1), lambda a, b: a - b)
