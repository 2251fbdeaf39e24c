"""documents are made and parsed once."""

from strandline.operators.loading import chosen_sequences

GOOD = '{"type":"LineString","coordinates":[[34,43],[34.1,43.1],[34.2,43.2]]}'
FAR = '{"type":"LineString","coordinates":[[4,3],[4.1,3.1]]}'
TWO_RUNS = '{"type":"LineString","coordinates":[[34,43],[34.1,43],[9,9],[34,43],[34.1,43.1],[34.3,43.2],[9,9],[34,43]]}'


def test_documents_are_read_once(spark):
    """Rejects were parsed again, after all documents had been made again."""
    payloads = [GOOD, FAR, TWO_RUNS, "{oops", '{"type":"Point","coordinates":[1,2]}', '[{"lat":1,"lon":2},{"lat":3,"lon":4}]', "", "x"]
    docs = spark.createDataFrame(list(enumerate(payloads)), "doc_id INT, payload STRING").repartition(3).selectExpr("doc_id", "concat(payload, ' ') AS payload")
    lines, rejects = chosen_sequences(docs, (42.0, 44.0, 33.0, 35.0))
    plan = rejects._jdf.queryExecution().toString().lower()
    assert "parse_json" not in plan and "concat" not in plan
    kept = sorted((r.doc_id, r.seq, r.lat) for r in lines.collect())
    assert kept == [(0, 1, 43.0), (0, 2, 43.1), (0, 3, 43.2), (2, 1, 43.0), (2, 2, 43.1), (2, 3, 43.2), (5, 1, 1.0), (5, 2, 3.0)]
    got = sorted((r.doc_id, r.stage, r.reason) for r in rejects.collect())
    assert got == [
        (1, "choose", "no coordinates inside bounds"),
        (3, "read", "unreadable json"),
        (4, "read", "unsupported root type"),
        (6, "read", "empty payload"),
        (7, "read", "unsupported payload"),
    ]
