"""Interpolation, exposure, sediment and document fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import exposure, quality, sediment, spatial
from strandline.sources import documents
from strandline.sources.lithology import default_classes


def bathy(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord BIGINT, lat DOUBLE, lon DOUBLE, depth DOUBLE")


SAMPLES = [(45.0, 30.0, -100.0), (45.0, 30.01, -150.0), (45.01, 30.0, -120.0), (45.01, 30.01, -180.0)]


def test_bilinear_depth(spark):
    at = spark.createDataFrame([(1, 45.0, 30.0), (2, 45.005, 30.005), (3, 50.0, 30.0)], "id INT, lat DOUBLE, lon DOUBLE")
    got = {r.id: r for r in spatial.interpolate_depth(at, bathy(spark, SAMPLES), 0.01).collect()}
    assert spatial.build_grid(bathy(spark, SAMPLES), 0.01).count() == 4
    assert got[1].depth == pytest.approx(-100.0, abs=0.01)
    assert got[2].depth == pytest.approx(-137.5, abs=0.1)
    assert got[3].status == "outside" and got[3].depth is None


def test_depth_factor_and_missing_depth(spark):
    df = spark.createDataFrame([(-2000.0,), (-10.0,), (0.0,), (10.0,), (None,)], "d DOUBLE")
    v = [r.f for r in df.select(spatial.depth_factor(F.col("d"), 1000.0).alias("f")).collect()]
    assert 0.8 < v[0] < 0.9 and 0 < v[1] < 0.05 and v[2] == 0 and v[3] == 0 and v[4] is None


def rocks(spark, rows):
    return spark.createDataFrame(
        [(i, a, o, c, r, "#1", c, "high") for i, (a, o, c, r) in enumerate(rows)],
        "ord BIGINT, lat DOUBLE, lon DOUBLE, lithology_class STRING, resistance DOUBLE, color STRING, description STRING, confidence STRING",
    )


def test_rock_idw(spark):
    pts = rocks(spark, [(45.0, 34.0, "limestone", 4.5), (44.5, 33.5, "clay", 1.2)])
    at = spark.createDataFrame([(1, 45.0, 34.0), (2, 44.5, 33.5), (3, 44.75, 33.75), (4, 10.0, 10.0)], "id INT, lat DOUBLE, lon DOUBLE")
    box = {"min_lat": 44.0, "max_lat": 46.0, "min_lon": 33.0, "max_lon": 35.0}
    got = {r.id: r for r in spatial.rock_at(at, pts, default_classes(spark), box).collect()}
    assert (got[1].rock, got[1].rock_resistance) == ("limestone", 4.5)
    assert (got[2].rock, got[2].rock_resistance) == ("clay", 1.2)
    assert got[3].rock == "limestone" and got[3].rock_resistance == pytest.approx(2.85)
    assert got[4].rock == "limestone" and got[4].rock_description == "default lithology"
    none = spatial.rock_at(at, pts.limit(0), default_classes(spark)).first()
    assert none.rock == "limestone" and none.rock_resistance == 4.0


def test_nearest_points_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(float(a), float(o)) for a, o in zip(rng.normal(44, 0.3, 150), rng.normal(34, 2.0, 150))] + [(44.0, 34.0)] * 40
    places = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(41, 47, 60), rng.uniform(27, 41, 60)))]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(pts)], "ord BIGINT, lat DOUBLE, lon DOUBLE")
    q = spark.createDataFrame(places, "id INT, lat DOUBLE, lon DOUBLE")
    got = {r.id: [n.ord for n in r.near] for r in spatial.nearest_points(q, p, 6).collect()}
    for i, a, o in places:
        order = sorted(range(len(pts)), key=lambda k: (np.sqrt((pts[k][0] - a) ** 2 + (pts[k][1] - o) ** 2), k))
        assert got[i] == order[:6]


def test_nearest_points_of_crowds_and_far_places(spark):
    """20 000 points in a speck, some far away; places inside, beside and far from everything."""
    rng = np.random.default_rng(7)
    crowd = [(44.0 + a * 1e-7, 34.0 + o * 1e-7) for a, o in rng.uniform(0, 1, (20_000, 2))]
    pts = crowd + [(a, o) for a, o in rng.uniform(40, 48, (30, 2))] + [(44.00000001, 34.00000001)] * 50
    places = [(44.00000005, 34.00000005), (44.3, 34.2), (-60.0, -150.0), (44.0000002, 34.0), (44.0, 34.0)] * 2 + [(None, 34.0)]
    p = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(pts)], "ord BIGINT, lat DOUBLE, lon DOUBLE")
    q = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(places)], "id INT, lat DOUBLE, lon DOUBLE").repartition(3)
    got = {r.id: r.near for r in spatial.nearest_points(q, p, 6).collect()}
    xy = np.array(pts)
    for i, (a, o) in enumerate(places[:10]):
        d = np.sqrt((xy[:, 0] - a) ** 2 + (xy[:, 1] - o) ** 2)
        assert [n.ord for n in got[i]] == np.lexsort((np.arange(len(d)), d))[:6].tolist()
    assert got[10] is None
    cells, found = spatial.candidate_cells(q, p, 6)
    per_place = cells.join(found.groupBy(*spatial.CELL).count(), spatial.CELL).groupBy("lat", "lon").agg(F.sum("count").alias("n"))
    assert per_place.agg(F.max("n")).first()[0] <= 400
    assert spatial.nearest_points(q, p.limit(0), 6).where("near IS NOT NULL").isEmpty()


M = 111194.9
HEADLAND = [
    (-300, -300), (-300, 300), (300, 300), (300, 220), (360, 220), (360, 180), (360, 140), (300, 140), (300, 80),
    (80, 80), (80, 0), (80, -80), (300, -80), (300, -300), (-300, -300),
]


def test_headland_retreats_more_than_bay(line):
    pts = [(a / M, o / M) for a, o in HEADLAND]
    p = exposure.WaveParams(strength_m=45, wind_dir_deg=0, wind_speed=14, max_fetch_m=1200, depth_scale_m=250)
    frames, ret = exposure.wave_pass(line({1: pts}), p)
    moved = {r.seq: r for r in exposure.moved_shore(frames, ret).collect()}
    assert len(moved) == len(pts)
    shift = lambda i: np.hypot(moved[i + 1].lat - pts[i][0], moved[i + 1].lon - pts[i][1])
    assert shift(5) > shift(10)
    assert (moved[1].lat, moved[1].lon) == (moved[15].lat, moved[15].lon)


def test_wind_factor(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 6, 12, 18, 24)], "v DOUBLE")
    assert [r.f for r in df.select(exposure.wind_factor(F.col("v")).alias("f")).collect()] == pytest.approx([0.1, 0.25, 1, 2.25, 4])


def test_ray_fetch_against_brute_force(line):
    rng = np.random.default_rng(9)
    pts = list(zip(43 + np.cumsum(rng.normal(0, 0.02, 40)), 34 + np.cumsum(rng.normal(0, 0.02, 40))))
    p = exposure.WaveParams(strength_m=10, wind_dir_deg=130, max_fetch_m=30_000)
    frames = exposure.vertex_frames(line({1: pts}))
    got = exposure.ray_fetch(frames, p).toPandas()
    f = frames.orderBy("seq").toPandas()
    xy = f[["x", "y"]].to_numpy()
    for row in got.itertuples():
        k = row.seq - 1
        d = np.array([row.dx, row.dy])
        o, best = xy[k] + d * 25, 30_000 - 25
        for s in range(39):
            if s in (k - 1, k):
                continue
            a, seg = xy[s], xy[s + 1] - xy[s]
            den = d[0] * seg[1] - d[1] * seg[0]
            if abs(den) < 1e-9:
                continue
            e = a - o
            t, u = (e[0] * seg[1] - e[1] * seg[0]) / den, (e[0] * d[1] - e[1] * d[0]) / den
            if t > 1e-6 and -1e-6 <= u <= 1 + 1e-6:
                best = min(best, t)
        assert row.fetch == pytest.approx(25 + best, rel=1e-9)


def shore(spark, rows):
    return spark.createDataFrame(
        [(1, i + 1, *r) for i, r in enumerate(rows)],
        "line_id BIGINT, seq INT, lat DOUBLE, lon DOUBLE, erosion_rate DOUBLE, energy DOUBLE, resistance DOUBLE",
    )


def test_sediment(spark):
    p = sediment.SedimentParams(0.7, 0.8, 0.5, 0.8, 0.0)
    rows, total = sediment.sediment_budget(
        shore(spark, [(45.0, 35.0 + i, 2.0, e, 4.0) for i, e in enumerate((0.8, 0.5, 0.2))]), p
    )
    third = rows.where("seq = 3").first()
    assert third.accumulating and third.modified_rate < third.erosion_rate
    p = sediment.SedimentParams(0.7, 0.6, 1.0, 0.8, 45.0)
    rates = [(45.0, 35.0, 2.0), (45.1, 35.1, 1.5), (45.2, 35.2, 1.0), (45.3, 35.3, 0.5)]
    _, total = sediment.sediment_budget(shore(spark, [(a, o, r, 0.5, k) for (a, o, r), k in zip(rates, (4.5, 1.2, 6.5, 2.5))]), p)
    assert total.first().balance_ratio <= 0.2
    few, _ = sediment.sediment_budget(shore(spark, [(45.0, 35.0, 1.0, 0.5, 1.0), (45.0, 36.0, 1.0, 0.5, 9.0)]), p)
    assert {r.incoming for r in few.collect()} == {0.0}
    df = spark.createDataFrame([(2.0, 0.0, False), (2.0, 1.5, True)], "erosion_rate DOUBLE, deposited DOUBLE, accumulating BOOLEAN")
    assert [r.m for r in df.select(sediment.modified_rate().alias("m")).collect()] == [2.0, 0.5]


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id STRING, payload STRING")


def test_point_array_keys(spark):
    got = documents.parse_points(docs(spark, '[{"Lat":46.48,"Lon":30.73},{"LAT":1,"lon":2},{"lat":3}]')).orderBy("seq").collect()
    assert [(r.lat, r.lon) for r in got] == [(46.48, 30.73), (1.0, 2.0), (3.0, 0.0)]
    bad = {r.doc_id: r.reason for r in documents.rejected_points(docs(spark, " ", "{}", "[1", "[]")).collect()}
    assert bad["0"] == "empty payload" and bad["1"] == "unsupported payload" and "3" not in bad


FC = (
    '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Name":"Black Sea","mrgid":3319},'
    '"geometry":{"type":"Polygon","coordinates":[[[30.73,46.48],[31,46],[31.5,45.5],[31,45],[30.73,46.48]]]}}]}'
)


def test_inspection(spark):
    r = documents.inspect_geojson(docs(spark, FC)).first()
    assert (r.format, r.root_type, r.name, r.region_id, r.feature_count) == ("GeoJSON", "FeatureCollection", "Black Sea", "3319", 1)
    assert r.geometry_types == ["Polygon"] and r.points == 5 and r.payload_bytes == len(FC)


def test_clip_and_best_run(spark):
    two = (
        '{"type":"MultiPolygon","coordinates":[[[[30.73,46.48,7],[31,46],[31.5,45.5],[32,45],[31,44],[30.73,46.48]]],'
        '[[[10,10],[11,11],[10,10]]]]}'
    )
    v = documents.geojson_vertices(documents.parse_geojson(docs(spark, two)))
    runs = quality.clip_runs(v, (40.5, 46.8, 27.0, 42.2), ["doc_id", "sequence_id"])
    assert runs.count() == 6 and runs.orderBy("seq").first().lat == 46.48


def test_nested_collections(spark):
    inner = '{"type":"LineString","coordinates":[[1,2],[3,4]]}'
    for _ in range(5):
        inner = '{"type":"GeometryCollection","geometries":[' + inner + "]}"
    deep = inner
    for _ in range(6):
        deep = '{"type":"GeometryCollection","geometries":[' + deep + "]}"
    parsed = documents.parse_geojson(docs(spark, inner, deep))
    assert documents.geojson_vertices(parsed).count() == 4
    assert documents.rejected(parsed).collect() == []
    texts = '{"type":"LineString","coordinates":[["1","2"],["3","4"]]}'
    assert documents.rejected(documents.parse_geojson(docs(spark, texts))).count() == 1


def test_point_arrays_with_other_members(spark):
    text = '[{"lat":1,"lon":2,"name":"a","tags":["x"],"at":{"z":1}},{"lat":3,"Lat":4.5,"lon":null}]'
    got = documents.parse_points(docs(spark, text)).orderBy("seq").collect()
    assert [(r.lat, r.lon) for r in got] == [(1.0, 2.0), (4.5, 0.0)]
    bad = docs(spark, '[{"lat":"1","lon":2}]', '[{"lat":1,"lon":[2]}]', text)
    assert documents.rejected_points(bad).count() == 2
    assert documents.parse_points(bad).select("doc_id").distinct().count() == 1


def test_depth_samples_of_any_spelling_and_rejects(spark):
    texts = ['[{"Lat":1,"LON":2,"Depth":-3,"note":"n"},{"lat":5}]', "", "{}x", "[]", '[{"lat":"a","lon":1,"depth":2}]']
    got = documents.parse_bathymetry(docs(spark, *texts)).orderBy("ord").collect()
    assert [(r.lat, r.lon, r.depth) for r in got] == [(1.0, 2.0, -3.0), (5.0, 0.0, 0.0)]
    reasons = sorted(r.reason for r in documents.rejected_bathymetry(docs(spark, *texts)).collect())
    assert reasons == ["empty payload", "no depth samples", "unreadable depth samples", "unreadable depth samples"]


def test_sediment_budget_over_a_table_of_parameters(spark):
    """Scenarios computed in one call equal calls with their parameters."""
    from strandline.operators import sediment as e

    rng = np.random.default_rng(3)
    rows = [(k, i + 1, *map(float, rng.uniform(0.1, 3, 5))) for k in (1, 2) for i in range(12)]
    shore = spark.createDataFrame(rows, "line_id int, seq int, lat double, lon double, erosion_rate double, resistance double, energy double")
    sets = {"a": e.SedimentParams(direction_deg=45.0, capacity_factor=0.25), "b": e.SedimentParams(deposition_rate=0.2, direction_deg=200.0)}
    params = spark.createDataFrame([{"scenario": k, **vars(p)} for k, p in sets.items()])
    rows, columns = e.for_parameters(shore, params)
    settled, totals = e.sediment_budget(rows, columns, ["scenario", "line_id"])
    names = ["line_id", "seq", "incoming", "deposited", "transported", "modified_rate"]
    for k, p in sets.items():
        one, total = e.sediment_budget(shore, p)
        assert sorted(settled.where(F.col("scenario") == k).select(names).collect()) == sorted(one.select(names).collect())
        figures = [c for c in total.columns if c != "warnings"]
        for x, y in zip(sorted(totals.where(F.col("scenario") == k).select(figures).collect()), sorted(total.select(figures).collect())):
            assert tuple(x) == pytest.approx(tuple(y))


def test_raster_axis_over_stretches(spark, monkeypatch):
    """Nearest source positions do not depend on where an axis is cut."""
    from strandline.sources import raster

    monkeypatch.setattr(raster, "STRETCH", 3)
    for values in ([0.1, 4.9, 5.1, 9.0, 9.0, 30.0], [12.0], []):
        source = spark.createDataFrame([(v,) for v in values], "lat double")
        got = {r.lat_out: r.lat for r in raster._axis_matches(source, 0.0, 20.0, 1.0, "lat").collect()}
        assert got == {float(t): min(values, key=lambda v: (abs(v - t), v)) if values else None for t in range(21)}
