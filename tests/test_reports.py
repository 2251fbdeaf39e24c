import pytest
from golden_steps import step_frame
from pyspark.sql import functions as F

from strandline.operators import reports as r


@pytest.fixture(scope="module")
def steps(spark):
    return step_frame(spark).cache()


def by(df):
    return {row["scenario"]: row for row in df.collect()}


def test_basic_and_temporal(steps):
    b, t = by(r.basic_statistics(steps)), by(r.temporal_change(steps))
    assert b["erosion_metrics"].total_steps == 21
    assert (b["erosion_metrics"].initial_length_km, b["erosion_metrics"].final_length_km) == (6391.1, 5977.9)
    assert t["erosion_metrics"].simulated_years == 50.0
    assert t["erosion_metrics"].length_change_km == pytest.approx(-413.2)
    assert t["erosion_metrics"].length_change_percent == pytest.approx(-6.5, abs=0.05)
    assert t["scenario_low"].length_change_percent == pytest.approx(-2.25, abs=0.005)
    assert t["scenario_high"].length_change_percent == pytest.approx(-2.81, abs=0.005)
    assert t["scenario_low"].mean_annual_change_km == pytest.approx(-23.983, abs=5e-4)
    assert t["scenario_high"].mean_annual_change_km == pytest.approx(-29.967, abs=5e-4)


def test_totals_and_final(steps):
    e, f = by(r.erosion_totals(steps)), by(r.final_metrics(steps))
    assert e["erosion_metrics"].total_eroded_m3 == pytest.approx(413175.7)
    assert round(f["scenario_low"].total_erosion_m3) == 143836
    assert round(f["scenario_high"].total_erosion_m3) == 179771
    assert (f["scenario_low"].storm_count, f["scenario_high"].storm_count) == (1, 2)


def test_storms(steps):
    s, c = by(r.storm_split(steps)), by(r.storm_comparison(steps))
    assert s["erosion_metrics"].storm_erosion_m3 == pytest.approx(166675.0)
    assert s["erosion_metrics"].normal_erosion_m3 == pytest.approx(246500.7)
    sa = c["storm_analysis"]
    assert (sa.n_storm, sa.n_normal) == (11, 10)
    assert s["storm_analysis"].storm_frequency == pytest.approx(0.524, abs=5e-4)
    assert sa.storm_mean_length == pytest.approx(6041.67, abs=0.005)
    assert sa.normal_mean_length == pytest.approx(6076.72, abs=0.005)
    assert sa.storm_total == pytest.approx(388934.3)
    assert sa.normal_total == pytest.approx(102634.5)
    assert sa.storm_per_event == pytest.approx(35357.7, abs=0.05)
    assert sa.efficiency_ratio == pytest.approx(3.45, abs=0.005)


def test_storm_timing_and_impact(steps):
    t, i = by(r.storm_timing(steps))["storm_analysis"], by(r.storm_impact(steps))["storm_analysis"]
    assert t.storm_interval_mean == pytest.approx(3.8)
    assert t.storm_interval_std == pytest.approx(3.0, abs=0.05)
    assert i.max_single_storm == 110640.3 and i.min_single_storm == 12817.5
    assert i.length_change_mean == pytest.approx(-38.090, abs=5e-4)
    assert i.length_change_std == pytest.approx(25.504, abs=5e-4)
    assert i.storm_contribution_pct == pytest.approx(79.1, abs=0.05)


def test_trend_and_findings(steps):
    t, f = by(r.trend_class(steps)), by(r.findings(steps))
    assert t["erosion_metrics"].slope == pytest.approx(-17.788, abs=5e-4)
    assert t["erosion_metrics"].trend == "shrinking"
    assert "413.20" in f["erosion_metrics"].findings[0] and "6.5%" in f["erosion_metrics"].findings[0]


def test_series_shapes(steps):
    assert r.step_rates(steps).count() == steps.count() - 4
    m = r.step_matrix(steps, True)
    assert len(m.columns) == 22
    row = by(m)["scenario_low"]
    assert row["step_0"] == 100.0 and row["step_4"] is None
    cum = r.cumulative_net(steps).where("scenario = 'scenario_low' and step = 3").first()
    assert cum.cumulative_net_m3 == pytest.approx(143836.2)
    hist = r.storm_histogram(steps).where("scenario = 'storm_analysis'").collect()
    assert sum(h.storms for h in hist) == 11 and max(h.bucket for h in hist) == 40


def test_csv_round_trip(spark, steps, tmp_path):
    from strandline.sinks.tables import long_frame, write_long
    from strandline.sources.step_metrics import read_step_metrics

    one = steps.where("scenario = 'scenario_low'")
    flat = str(tmp_path / "scenario_low.csv")
    long_frame(one).drop("scenario").coalesce(1).write.option("header", True).csv(flat)
    import glob
    import shutil

    target = str(tmp_path / "csv" / "scenario_low.csv")
    (tmp_path / "csv").mkdir()
    shutil.copy(glob.glob(flat + "/part-*.csv")[0], target)
    back = read_step_metrics(spark, target).collect()
    assert {x.scenario for x in back} == {"scenario_low"} and len(back) == 4
    assert sorted(x.length_km for x in back)[0] == 6247.2
    write_long(steps, str(tmp_path / "long"))
    with pytest.raises(ValueError):
        read_step_metrics(spark, target, ["step", "no_such_column"])


def test_report_documents(spark, steps, tmp_path):
    from strandline.sinks.reports import report_documents, write_documents
    from strandline.sinks.tables import wide_frame

    doc = by(report_documents(steps))["erosion_metrics"]
    assert doc.summary.storm_events == 4 and len(doc.analysis.steps) == 21
    assert doc.analysis.steps[1].length_km == 6342.9
    write_documents(report_documents(steps), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 4
    wide = wide_frame(steps).where("scenario = 'scenario_low' and metric_name = 'storm_event'").first()
    assert [wide[f"step_{i}"] for i in range(4)] == ["false", "false", "true", "false"]


def test_metrics_by_column_name(spark, tmp_path):
    from strandline.sources.step_metrics import read_step_metrics, step_metrics_rejects

    files = {
        "a b+c": "﻿length_km, step ,year,extra\n10.5,0,0.0,\"x, y\"\n9.5,1,0.5,\n",
        "storms": "storm_event,step,net_change_m3,length_km\nTrue,0,5.5,3\nfalse,1,,2\nmaybe,2,1,2\nTrue,3\nTrue,4,1,2,9\n,5,1,\nTrue,x,1,2\n",
        "none": "step,length_km\n",
        "blank": "",
    }
    folder = tmp_path / "steps"
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    rows = read_step_metrics(spark, str(folder))
    assert rows.columns == ["year", "step", "length_km", "area_km2", "eroded_m3", "deposited_m3", "net_change_m3", "storm_event", "sea_level_m", "scenario"]
    got = {(r.scenario, r.step): (r.length_km, r.year, r.storm_event, r.net_change_m3) for r in rows.collect()}
    assert got == {
        ("a b+c", 0): (10.5, 0.0, None, None), ("a b+c", 1): (9.5, 0.5, None, None),
        ("storms", 0): (3.0, None, True, 5.5), ("storms", 1): (2.0, None, False, None),
    }
    bad = {r.record: r.reason for r in step_metrics_rejects(spark, str(folder)).collect()}
    assert bad == {
        "maybe,2,1,2": "storm_event is no boolean", "True,3": "wrong number of fields", "True,4,1,2,9": "wrong number of fields",
        ",5,1,": "no length_km", "True,x,1,2": "step is no int",
    }
    short = read_step_metrics(spark, str(folder), columns=["year"])
    assert short.columns == ["year", "step", "length_km", "scenario"]
    assert read_step_metrics(spark, str(folder / "blank.csv")).collect() == []
    with pytest.raises(ValueError, match="area_km2"):
        read_step_metrics(spark, str(folder), ["step", "length_km", "area_km2"])


def test_reports_on_steps_and_lengths_alone(steps):
    """What a file does not have is null, 0 storms, or no row; the rest is as with all columns."""
    bare = steps.select("scenario", "step", "length_km")
    full = by(r.basic_statistics(steps))
    for name, row in by(r.basic_statistics(bare)).items():
        assert (row.total_steps, row.initial_length_km, row.final_length_km) == full[name][1:4] and row.initial_area_km2 is None
    assert by(r.overview(bare)) == by(r.overview(steps))
    final = by(r.final_metrics(bare))["scenario_low"]
    assert final.total_erosion_m3 is None and final.storm_count == 0
    for table in (r.temporal_change, r.erosion_totals, r.storm_split):
        assert table(bare).collect() == []
    assert by(r.storm_comparison(bare))["scenario_low"].n_storm == 0
    assert by(r.storm_timing(bare))["scenario_low"].storm_interval_mean is None
    assert by(r.storm_impact(bare))["scenario_low"].max_single_storm is None
    assert r.step_details(bare).count() == steps.count()
    assert {x.storms for x in r.storm_histogram(bare).collect()} == {0}
    assert len(by(r.findings(bare))["scenario_low"].findings) == 2  # length and trend
    mixed = steps.withColumn("eroded_m3", F.when(F.col("scenario") != "scenario_low", F.col("eroded_m3")))
    assert set(by(r.erosion_totals(mixed))) == set(by(r.erosion_totals(steps))) - {"scenario_low"}
