"""Retreat of a step without repeating the sizes of snapshots to their vertices."""

from pyspark.sql import functions as F

from strandline.operators.series import retreat_summary, retreats


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_retreat_summary(spark):
    rows = [(k, step, i, 40 + 0.01 * i + 0.001 * k * step, 20 + 0.02 * i) for k in range(4) for step in range(3) for i in range(5 + (k == 2 and step == 1))]
    snapshots = spark.createDataFrame(rows, "line_id BIGINT, step INT, seq INT, lat DOUBLE, lon DOUBLE")
    want = retreats(snapshots).groupBy("line_id", "step").agg(F.avg("retreat_km").alias("mean_retreat"), F.max("retreat_km").alias("max_retreat"))
    got = retreat_summary(snapshots)
    rounded = lambda df: sorted((r["line_id"], r["step"], round(r["mean_retreat"], 9), round(r["max_retreat"], 9)) for r in df.collect())
    assert rounded(got) == rounded(want) and {(r[0], r[1]) for r in rounded(got)} == {(k, s) for k in (0, 1, 3) for s in (1, 2)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(retreat_summary(snapshots)) < exchanges(retreats(snapshots).groupBy("line_id", "step").agg(F.max("retreat_km")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
