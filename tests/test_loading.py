import json

import pytest

from strandline.operators import loading
from strandline.operators.quality import default_landmarks


def line(*pts):
    return json.dumps({"type": "LineString", "coordinates": [[o, a] for a, o in pts]})


def nested(depth, inner):
    for _ in range(depth):
        inner = {"type": "GeometryCollection", "geometries": [inner]}
    return json.dumps(inner)


SQUARE = [(44.0, 34.0), (44.0, 34.1), (44.1, 34.1), (44.1, 34.0), (44.0, 34.0)]
DOCS = {
    "ring": json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[o, a] for a, o in SQUARE]]}}),
    "array": '[{"lat":44,"lon":34},{"Lat":44.0000000001,"LON":34},{"lat":44.2,"lon":34.1},{"lat":44.3,"lon":34.2}]',
    "far": line((10.0, 10.0), (11.0, 11.0)),
    "one_inside": line((10.0, 10.0), (44.05, 34.05), (11.0, 11.0)),
    "array_far": '[{"lat":1,"lon":1},{"lat":2,"lon":2}]',
    "array_one": '[{"lat":1,"lon":1}]',
    "no_points": "[]",
    "north": '[{"lat":95,"lon":34},{"lat":44,"lon":34.5}]',
    "east": '[{"lat":45,"lon":-180.5},{"lat":44,"lon":34.5}]',
    "same": '[{"lat":44,"lon":34},{"lat":44,"lon":34},{"lat":44,"lon":34}]',
    "strings": '{"type":"LineString","coordinates":[["34","44"],["35","45"]]}',
    "deep": nested(12, {"type": "LineString", "coordinates": [[34.0, 44.0], [34.05, 44.05], [34.1, 44.05]]}),
    "wide": json.dumps({"type": "GeometryCollection", "geometries": [json.loads(nested(2, json.loads(line((44.0, 34.0), (44.0, 34.0 + i / 100)))) ) for i in range(1, 9)]}),
    "braces": json.dumps({"type": "GeometryCollection", "note": "}}}{\\\" geometrycollection", "geometries": [json.loads(nested(3, json.loads(line((44.0, 34.0), (44.05, 34.0)))))]}),
    "empty": "  ", "null": None, "text": '"x"', "broken": "[1", "other": '{"type":"Topology"}',
}
BOX = (43.9, 44.5, 33.9, 34.5)


@pytest.fixture(scope="module")
def loaded(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, payload string").repartition(3)
    got = loading.load_lines(docs, default_landmarks(spark), BOX)
    rows = {}
    for r in got.lines.orderBy("doc_id", "seq").collect():
        rows.setdefault(r.doc_id, []).append((r.lat, r.lon))
    return rows, {r.doc_id: r for r in got.reports.collect()}, [(r.doc_id, r.stage, r.reason) for r in got.rejects.collect()]


def test_each_document_ends_in_one_table(loaded):
    rows, reports, rejects = loaded
    assert sorted([*rows, *[d for d, *_ in rejects]]) == sorted(DOCS)
    assert set(rows) == set(reports)


def test_reasons(loaded):
    found = {d: (stage, reason) for d, stage, reason in loaded[2]}
    assert found == {
        "far": ("choose", loading.OUTSIDE), "one_inside": ("choose", loading.OUTSIDE),
        "array_one": ("choose", loading.SHORT), "no_points": ("choose", loading.SHORT),
        "north": ("range", "invalid latitude"), "east": ("range", "invalid longitude"), "same": ("order", loading.FEW),
        "strings": ("read", "unsupported or unreadable geometry"), "empty": ("read", "empty payload"), "null": ("read", "empty payload"),
        "text": ("read", "unsupported payload"), "broken": ("read", "unreadable point array"), "other": ("read", "unsupported root type"),
    }


def test_lines(loaded):
    rows, reports, _ = loaded
    assert rows["ring"][0] == rows["ring"][-1] and sorted(rows["ring"][:-1]) == sorted(SQUARE[:-1])
    assert rows["array"] == [(44.0, 34.0), (44.2, 34.1), (44.3, 34.2)] and reports["array"].removed == 1
    assert rows["array_far"] == [(1.0, 1.0), (2.0, 2.0)]  # bounds clip GeoJSON only
    assert len(rows["deep"]) == 3 and rows["braces"] == [(44.0, 34.0), (44.05, 34.0)]
    assert rows["wide"] == [(44.0, 34.0), (44.0, 34.08)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, payload string")
    got = loading.load_lines(docs, default_landmarks(spark))
    assert got.lines.collect() == [] and got.reports.collect() == [] and got.rejects.collect() == []
