"""Data-quality queries V1-V23 on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import quality as q
from strandline.operators.crossings import self_intersections
from strandline.operators.geometry import line_summary
from strandline.operators.repair import repair_order
from strandline.operators.spatial import build_grid
from strandline.plans import adapters as a
from strandline.plans import geometry_queries  # noqa: F401  (defines shared tables)
from strandline.plans.registry import r6, register, s6
from strandline.plans.sql import define, hav, query

LONG_KM = 15.0
BOX = (42.8, 43.3, 33.7, 34.3)
BOX_SQL = f"lat BETWEEN {BOX[0]}e0 AND {BOX[1]}e0 AND lon BETWEEN {BOX[2]}e0 AND {BOX[3]}e0"


def crossing_sql(base: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c}=t.{c}" for c in keys)

    def o(a, b, c):
        return f"((({b}x)-({a}x))*(({c}y)-({a}y))-(({b}y)-({a}y))*(({c}x)-({a}x)))"

    def same(p, r):
        return f"(abs({p}y-{r}y)<=1e-9 AND abs({p}x-{r}x)<=1e-9)"

    def on_seg(p, m, r):
        return (
            f"({m}x<=greatest({p}x,{r}x)+1e-9 AND {m}x>=least({p}x,{r}x)-1e-9 AND "
            f"{m}y<=greatest({p}y,{r}y)+1e-9 AND {m}y>=least({p}y,{r}y)-1e-9)"
        )

    A, B, C, D = "s.a", "s.b", "t.a", "t.b"
    return f"""SELECT {', '.join('s.'+c for c in keys)}, s.i AS first_segment, t.i AS second_segment
FROM (SELECT {k}, seq AS i, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by FROM {base} WINDOW w AS (PARTITION BY {k} ORDER BY seq)) s
JOIN (SELECT {k}, seq AS i, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by FROM {base} WINDOW w AS (PARTITION BY {k} ORDER BY seq)) t
ON {on} AND t.i>=s.i+2 AND s.bx IS NOT NULL AND t.bx IS NOT NULL
WHERE NOT ({same(A,C)} OR {same(A,D)} OR {same(B,C)} OR {same(B,D)}) AND (
 ({o(A,B,C)}*{o(A,B,D)}<-1e-9 AND {o(C,D,A)}*{o(C,D,B)}<-1e-9)
 OR (abs({o(A,B,C)})<=1e-9 AND {on_seg(A,C,B)}) OR (abs({o(A,B,D)})<=1e-9 AND {on_seg(A,D,B)})
 OR (abs({o(C,D,A)})<=1e-9 AND {on_seg(C,A,D)}) OR (abs({o(C,D,B)})<=1e-9 AND {on_seg(C,B,D)}))"""


define(
    "spoiled",
    """SELECT line_id, seq, CASE WHEN src_id%97=0 THEN lat+100 ELSE lat END AS lat,
  CASE WHEN src_id%89=0 THEN lon-300 ELSE lon END AS lon FROM vertices""",
    "vertices",
)


@register(
    "v1_coordinate_range",
    query(
        f"""SELECT line_id, min(seq) AS seq, arg_min(CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude' ELSE 'longitude' END, seq) AS rule,
 {s6('arg_min(CASE WHEN lat NOT BETWEEN -90 AND 90 THEN lat ELSE lon END, seq)')} AS value
FROM spoiled WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 GROUP BY line_id""",
        "spoiled",
    ),
)
def v1(spark, sf):
    src = F.col("src_id")
    spoiled = a.vertices(spark, sf).select(
        "line_id",
        "seq",
        F.when(src % 97 == 0, F.col("lat") + 100).otherwise(F.col("lat")).alias("lat"),
        F.when(src % 89 == 0, F.col("lon") - 300).otherwise(F.col("lon")).alias("lon"),
    )
    return q.coordinate_violations(spoiled).select("line_id", "seq", "rule", r6("value"))


define(
    "bad_bathy",
    """SELECT ord, CASE WHEN ord%107=0 THEN lat+20 WHEN ord%113=0 THEN CAST('nan' AS DOUBLE) ELSE lat END AS lat,
  CASE WHEN ord%127=0 THEN lon-20 WHEN ord%131=0 THEN CAST('infinity' AS DOUBLE) ELSE lon END AS lon,
  CASE WHEN ord%101=0 THEN 5.0e0 WHEN ord%103=0 THEN depth-4000 WHEN ord%109=0 THEN CAST('nan' AS DOUBLE) ELSE depth END AS depth FROM bathy""",
    "bathy",
)


@register(
    "v2_bathymetry_rules",
    query(
        """SELECT ord, rule FROM (SELECT ord, CASE WHEN isnan(lat) OR isinf(lat) THEN 'latitude not finite'
 WHEN isnan(lon) OR isinf(lon) THEN 'longitude not finite' WHEN isnan(depth) OR isinf(depth) THEN 'depth not finite'
 WHEN lat NOT BETWEEN 39.9e0 AND 47.1e0 THEN 'latitude out of range' WHEN lon NOT BETWEEN 26.9e0 AND 42.6e0 THEN 'longitude out of range'
 WHEN depth>0 THEN 'positive depth' WHEN depth<-3000 THEN 'too deep' END AS rule FROM bad_bathy) WHERE rule IS NOT NULL""",
        "bad_bathy",
    ),
)
def v2(spark, sf):
    o = F.col("ord")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    bad = a.bathymetry(spark, sf).select(
        "ord",
        F.when(o % 107 == 0, F.col("lat") + 20).when(o % 113 == 0, nan).otherwise(F.col("lat")).alias("lat"),
        F.when(o % 127 == 0, F.col("lon") - 20).when(o % 131 == 0, inf).otherwise(F.col("lon")).alias("lon"),
        F.when(o % 101 == 0, F.lit(5.0))
        .when(o % 103 == 0, F.col("depth") - 4000)
        .when(o % 109 == 0, nan)
        .otherwise(F.col("depth"))
        .alias("depth"),
    )
    return q.bathymetry_violations(bad).select("ord", "rule")


@register(
    "v3_lithology_rules",
    query(
        """SELECT part, item, rule FROM (
 SELECT 'metadata' AS part, CASE WHEN n_nationkey%5=0 THEN '' ELSE n_name END AS item, CASE WHEN n_nationkey%5=0 THEN 'missing name'
   WHEN n_nationkey%7=0 THEN 'latitude bounds' WHEN n_nationkey%11=0 THEN 'longitude bounds' END AS rule FROM nation
 UNION ALL SELECT 'point', CAST(ord AS VARCHAR), CASE WHEN ord%19=0 THEN 'latitude' WHEN ord%23=0 THEN 'longitude'
   WHEN ord%29=0 OR resistance>9.5e0 THEN 'resistance' WHEN ord%31=0 THEN 'missing class' END FROM litho_points
 UNION ALL SELECT 'class', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey%13=0 THEN 'resistance' WHEN p_partkey%17=0 THEN 'missing color' END FROM part)
WHERE rule IS NOT NULL""",
        "litho_points",
    ),
)
def v3(spark, sf):
    n, o, p = F.col("n_nationkey"), F.col("ord"), F.col("p_partkey")
    meta = a.table(spark, sf, "nation").select(
        F.when(n % 5 == 0, F.lit("")).otherwise(F.col("n_name")).alias("name"),
        F.when(n % 7 == 0, F.lit(50.0)).otherwise(F.lit(40.0)).alias("min_lat"),
        F.lit(47.0).alias("max_lat"),
        F.when(n % 11 == 0, F.lit(42.0)).otherwise(F.lit(27.0)).alias("min_lon"),
        F.lit(42.0).alias("max_lon"),
    )
    points = a.litho_points(spark, sf).select(
        "ord",
        F.when(o % 19 == 0, F.col("lat") + 90).otherwise(F.col("lat")).alias("lat"),
        F.when(o % 23 == 0, F.col("lon") + 180).otherwise(F.col("lon")).alias("lon"),
        F.when(o % 29 == 0, -F.col("resistance")).when(F.col("resistance") > 9.5, F.lit(21.0))
        .otherwise(F.col("resistance")).alias("resistance"),
        F.when(o % 31 == 0, F.lit("")).otherwise(F.col("lithology_class")).alias("lithology_class"),
    )
    classes = a.table(spark, sf, "part").select(
        p.cast("string").alias("class"),
        F.when(p % 13 == 0, F.lit(0.0)).otherwise(F.lit(2.0)).alias("resistance"),
        F.when(p % 17 == 0, F.lit("")).otherwise(F.lit("#111")).alias("color"),
    )
    return q.lithology_violations(meta, points, classes)


@register(
    "v4_grid_rule",
    query(
        """SELECT resolution, count(DISTINCT (floor(lat/0.1e0), floor(lon/0.1e0))) AS cells,
 CASE WHEN resolution<=0 THEN 'invalid resolution' WHEN resolution>0.1e0 THEN 'too coarse' ELSE 'ok' END AS verdict
FROM bathy, (VALUES (-1.0e0),(0.01e0),(0.1e0),(0.25e0)) r(resolution) GROUP BY 1""",
        "bathy",
    ),
)
def v4(spark, sf):
    grid = build_grid(a.bathymetry(spark, sf), 0.1)
    return reduce(DataFrame.unionByName, [q.grid_verdict(grid, F.lit(x)) for x in (-1.0, 0.01, 0.1, 0.25)])


@register("v5_box_filter", query(f"SELECT line_id, seq, lat, lon FROM vertices WHERE {BOX_SQL}", "vertices"))
def v5(spark, sf):
    return a.vertices(spark, sf).where(q.in_box(F.col("lat"), F.col("lon"), BOX)).select("line_id", "seq", "lat", "lon")


define(
    "runs",
    f"""SELECT line_id, sum(CASE WHEN NOT b THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY seq) AS run_id, seq, lat, lon FROM
(SELECT *, coalesce(lag(i) OVER w,false) AS b, coalesce(lead(i) OVER w,false) AS n FROM (SELECT *, {BOX_SQL} AS i FROM vertices) WINDOW w AS (PARTITION BY line_id ORDER BY seq))
WHERE i AND (b OR n)""",
    "vertices",
)


@register("v6_clip_runs", query("SELECT line_id, CAST(run_id AS BIGINT) AS run_id, seq, lat, lon FROM runs", "runs"))
def v6(spark, sf):
    return q.clip_runs(a.vertices(spark, sf), BOX).select("line_id", "run_id", "seq", "lat", "lon")


@register(
    "v7_longest_sequence",
    query(
        f"""SELECT line_id//10 AS doc_id, arg_max(line_id, (length_km, points, -line_id)) AS line_id,
 arg_max(points, (length_km, points, -line_id)) AS points, {s6('max(length_km)')} AS length_km FROM summary GROUP BY 1""",
        "summary",
    ),
)
def v7(spark, sf):
    seqs = a.vertices(spark, sf).withColumn("doc_id", F.floor(F.col("line_id") / 10))
    return q.longest_sequence(seqs, ["doc_id"], "line_id").select("doc_id", "line_id", "points", r6("length_km"))


define(
    "near_rings",
    """SELECT r.line_id, r.seq, r.lat + CASE WHEN r.seq=m.n AND r.line_id%3=1 THEN 1e-8 WHEN r.seq=m.n AND r.line_id%3=2 THEN 0.01e0 ELSE 0e0 END AS lat, r.lon
FROM rings r JOIN (SELECT line_id, max(seq) AS n FROM rings GROUP BY 1) m USING (line_id)""",
    "rings",
)


def _near_rings(spark, sf):
    from strandline.lines import attach

    r = a.rings(spark, sf)
    n = r.groupBy("line_id").agg(F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"))
    at_end = F.col("seq") == F.col("hi_seq")
    kind = F.col("line_id") % 3
    off = F.when(at_end & (kind == 1), 1e-8).when(at_end & (kind == 2), 0.01).otherwise(0.0)
    return attach(r, n).select("line_id", "seq", (F.col("lat") + off).alias("lat"), "lon")


@register(
    "v8_ring_detection",
    query(
        """SELECT line_id, count(*) AS points, round(arg_min(lat,seq),6)=round(arg_max(lat,seq),6) AND round(arg_min(lon,seq),6)=round(arg_max(lon,seq),6) AS closed_6dp,
 arg_min(lat,seq)=arg_max(lat,seq) AND arg_min(lon,seq)=arg_max(lon,seq) AS closed_exact FROM near_rings GROUP BY line_id""",
        "near_rings",
    ),
)
def v8(spark, sf):
    return q.ring_flags(_near_rings(spark, sf)).select("line_id", "points", "closed_6dp", "closed_exact")


define(
    "ring_clean",
    """SELECT line_id, closed, CAST(row_number() OVER (PARTITION BY line_id ORDER BY seq) AS INTEGER) AS seq, lat, lon FROM (
 SELECT line_id, any_value(closed) AS closed, min(seq) AS seq, arg_min(lat,seq) AS lat, arg_min(lon,seq) AS lon FROM (
  SELECT r.*, f.closed, f.n FROM near_rings r JOIN (SELECT line_id, max(seq) AS n,
    round(arg_min(lat,seq),6)=round(arg_max(lat,seq),6) AND round(arg_min(lon,seq),6)=round(arg_max(lon,seq),6) AS closed FROM near_rings GROUP BY 1) f USING (line_id)
  WHERE NOT (f.closed AND r.seq=f.n)) GROUP BY line_id, round(lat,6), round(lon,6))""",
    "near_rings",
)


@register(
    "v9_ring_normalise",
    query(
        """SELECT line_id, seq, lat, lon, closed FROM ring_clean UNION ALL
SELECT line_id, CAST(max(seq)+1 AS INTEGER), arg_min(lat,seq), arg_min(lon,seq), true FROM ring_clean WHERE closed GROUP BY line_id""",
        "ring_clean",
    ),
)
def v9(spark, sf):
    return q.normalise_rings(_near_rings(spark, sf)).select(
        "line_id", "seq", "lat", "lon", F.col("closed_6dp").alias("closed")
    )


define(
    "dedup",
    """SELECT line_id, min(seq) AS seq, arg_min(lat,seq) AS lat, arg_min(lon,seq) AS lon, count(*) AS copies
FROM vertices GROUP BY line_id, round(lat,6), round(lon,6)""",
    "vertices",
)
define(
    "base",
    "SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY seq) AS INTEGER) AS seq, lat, lon FROM dedup",
    "dedup",
)


@register("v10_duplicate_removal", query("SELECT line_id, seq, lat, lon FROM dedup", "dedup"))
def v10(spark, sf):
    return q.drop_duplicate_vertices(a.vertices(spark, sf)).select("line_id", "seq", "lat", "lon")


@register(
    "v10_duplicate_counts",
    query("SELECT line_id, count(*) AS kept, CAST(sum(copies)-count(*) AS BIGINT) AS removed FROM dedup GROUP BY 1", "dedup"),
)
def v10c(spark, sf):
    return q.duplicate_counts(a.vertices(spark, sf))


define("crossings", crossing_sql("vertices", ["line_id"]), "vertices")


@register(
    "v11_order_score",
    query(
        f"""SELECT s.line_id, coalesce(c.n,0) AS intersections, l.n AS long_segments, {s6('s.max_km')} AS max_segment_km, {s6('s.length_km')} AS total_km
FROM summary s JOIN (SELECT line_id, count(*) FILTER (km>{LONG_KM}) AS n FROM segs GROUP BY 1) l USING (line_id)
LEFT JOIN (SELECT line_id, count(*) AS n FROM crossings GROUP BY 1) c USING (line_id)""",
        "summary",
        "segs",
        "crossings",
    ),
)
def v11(spark, sf):
    return q.order_score(a.vertices(spark, sf), long_km=LONG_KM).select(
        "line_id", "intersections", "long_segments", r6("max_segment_km"), r6("total_km")
    )


START_SQL = """SELECT line_id, position, start_seq FROM (
SELECT line_id, unnest(p) AS start_seq, unnest(range(len(p))) AS position FROM (
 SELECT line_id, list_transform(list_filter(list_transform(range(len(c)), lambda i: {{'i':i,'v':c[i+1]}}), lambda z: list_position(c,z.v)=z.i+1), lambda z: z.v) AS p FROM (
  SELECT line_id, [min(seq), arg_min(seq,(lat,seq)), arg_max(seq,(lat,-seq)), arg_min(seq,(lon,seq)), arg_max(seq,(lon,-seq))] AS c FROM {base} GROUP BY line_id)))"""
define("starts", START_SQL.format(base="base"), "base")
define("vstarts", START_SQL.format(base="vertices"), "vertices")


@register(
    "v12_candidate_starts",
    query("SELECT line_id, CAST(position AS INTEGER) AS position, start_seq FROM vstarts", "vstarts"),
)
def v12(spark, sf):
    return q.candidate_starts(a.vertices(spark, sf))


define(
    "rec_walk",
    f"""SELECT line_id, position, 1 AS k, start_seq AS cur, [start_seq] AS seen FROM starts
UNION ALL
SELECT line_id, position, k+1, nxt, list_append(seen, nxt) FROM (
 SELECT w.line_id, w.position, any_value(w.k) AS k, any_value(w.seen) AS seen,
  arg_min(p.seq, (round({hav('c.lat','c.lon','p.lat','p.lon')},9), p.seq)) AS nxt
 FROM rec_walk w JOIN base c ON c.line_id=w.line_id AND c.seq=w.cur JOIN base p ON p.line_id=w.line_id AND NOT list_contains(w.seen, p.seq)
 GROUP BY w.line_id, w.position)""",
    "base",
    "starts",
)
define(
    "orders_all",
    """SELECT line_id, 0 AS candidate, seq, lat, lon FROM base UNION ALL
SELECT w.line_id, CAST(w.position+1 AS INTEGER), CAST(w.k AS INTEGER), b.lat, b.lon FROM rec_walk w JOIN base b ON b.line_id=w.line_id AND b.seq=w.cur""",
    "rec_walk",
    "base",
)
define("cand_cross", crossing_sql("orders_all", ["line_id", "candidate"]), "orders_all")
define(
    "best",
    f"""SELECT line_id, arg_min(candidate, (coalesce(x,0), longs, round(mx,9), round(total,6), candidate)) AS candidate, arg_min(coalesce(x,0), (coalesce(x,0), longs, round(mx,9), round(total,6), candidate)) AS intersections FROM (
 SELECT line_id, candidate, count(*) FILTER (km>{LONG_KM}) AS longs, max(km) AS mx, sum(km) AS total FROM
  (SELECT line_id, candidate, {hav('plat','plon','lat','lon')} AS km FROM
   (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM orders_all WINDOW w AS (PARTITION BY line_id, candidate ORDER BY seq))) GROUP BY 1,2)
LEFT JOIN (SELECT line_id, candidate, count(*) AS x FROM cand_cross GROUP BY 1,2) USING (line_id, candidate) GROUP BY line_id""",
    "orders_all",
    "cand_cross",
)


@register(
    "v13_order_repair",
    query(
        "SELECT line_id, seq, lat, lon, candidate FROM orders_all JOIN best USING (line_id, candidate)", "orders_all", "best"
    ),
)
def v13(spark, sf):
    from strandline.lines import renumber

    base = renumber(q.drop_duplicate_vertices(a.vertices(spark, sf)))
    return repair_order(base, long_km=LONG_KM).select("line_id", "seq", "lat", "lon", "candidate")


@register("v14_self_intersections", query("SELECT * FROM crossings", "crossings"))
def v14(spark, sf):
    return self_intersections(a.vertices(spark, sf))


@register(
    "v15_long_segments",
    query(
        f"""SELECT line_id, CAST(start_seq AS INTEGER) AS start_index, seq AS end_index, plat AS start_lat, plon AS start_lon, lat AS end_lat, lon AS end_lon,
 {s6('km')} AS length_km FROM segs WHERE km>{LONG_KM}""",
        "segs",
    ),
)
def v15(spark, sf):
    return q.long_segments(a.vertices(spark, sf), long_km=LONG_KM).select(
        "line_id", "start_index", "end_index", "start_lat", "start_lon", "end_lat", "end_lon", r6("length_km")
    )


define(
    "named",
    """SELECT v.line_id, v.seq, coalesce(arg_min(l.name, (sqrt(power(v.lon-l.lon,2)+power(v.lat-l.lat,2)), l.ord)),'—') AS landmark
FROM vertices v LEFT JOIN landmarks l ON abs(v.lat-l.lat)<0.15e0 AND abs(v.lon-l.lon)<0.15e0 GROUP BY 1,2""",
    "vertices",
    "landmarks",
)


@register("v16_nearest_landmark", query("SELECT line_id, seq, landmark FROM named", "named"))
def v16(spark, sf):
    return q.nearest_landmark(a.vertices(spark, sf), a.landmarks(spark, sf))


define(
    "repeated",
    """SELECT line_id, landmark, count(*) AS vertices FROM named WHERE landmark<>'—'
GROUP BY 1,2 HAVING count(*)>1""",
    "named",
    "vertices",
)


@register("v17_repeated_landmarks", query("SELECT line_id, landmark, vertices FROM repeated", "repeated"))
def v17(spark, sf):
    return q.repeated_landmarks(a.vertices(spark, sf), a.landmarks(spark, sf))


@register(
    "v18_issue_summary",
    query(
        f"""SELECT line_id, 'long_segment' AS warning_type, count(*) FILTER (km>{LONG_KM}) AS issues, {LONG_KM}e0 AS threshold_km FROM
 (SELECT v.line_id, s.km FROM vertices v LEFT JOIN segs s USING (line_id, seq)) GROUP BY 1
UNION ALL SELECT line_id, 'duplicate_location', count(landmark), 0.0e0 FROM (SELECT DISTINCT line_id FROM vertices) LEFT JOIN repeated USING (line_id) GROUP BY 1""",
        "vertices",
        "segs",
        "repeated",
    ),
)
def v18(spark, sf):
    return q.issue_summary(a.vertices(spark, sf), a.landmarks(spark, sf), long_km=LONG_KM)


define(
    "ordered",
    "SELECT line_id, seq, lat, lon, candidate FROM orders_all JOIN best USING (line_id, candidate)",
    "orders_all",
    "best",
)


define(
    "verdict",
    f"""SELECT line_id, kept, removed, candidate>0 AS reordered, intersections,
 coalesce(longs,0) AS long_segments, coalesce(reps,0) AS repeated_landmarks,
 CASE WHEN kept<2 THEN 'fewer than 2 points' WHEN intersections>0 THEN 'self-intersection' END AS fatal,
 concat_ws(' | ', CASE WHEN removed>0 THEN printf('{q.MSG_REMOVED}', removed) END, CASE WHEN candidate>0 THEN '{q.MSG_REORDERED}' END) AS fixes,
 CASE WHEN kept<2 OR intersections>0 THEN 0 ELSE coalesce(longs,0)+coalesce(reps,0) END AS warnings
FROM (SELECT line_id, count(*) AS kept, CAST(sum(copies)-count(*) AS BIGINT) AS removed FROM dedup GROUP BY 1) JOIN best USING (line_id)
LEFT JOIN (SELECT line_id, count(*) AS longs FROM (SELECT line_id, {hav('plat','plon','lat','lon')} AS km FROM
   (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM ordered WINDOW w AS (PARTITION BY line_id ORDER BY seq))) WHERE km>{LONG_KM} GROUP BY 1) USING (line_id)
LEFT JOIN (SELECT line_id, count(*) AS reps FROM (SELECT line_id, landmark, count(*) AS c FROM
   (SELECT o.line_id, o.seq, arg_min(l.name, (sqrt(power(o.lon-l.lon,2)+power(o.lat-l.lat,2)), l.ord)) AS landmark
    FROM ordered o JOIN landmarks l ON abs(o.lat-l.lat)<0.15e0 AND abs(o.lon-l.lon)<0.15e0 GROUP BY 1,2) GROUP BY 1,2 HAVING count(*)>1) GROUP BY 1) USING (line_id)""",
    "dedup",
    "best",
    "ordered",
    "landmarks",
)


@register("v19_verdict", query("SELECT * FROM verdict", "verdict"))
def v19(spark, sf):
    from strandline.lines import renumber

    v = a.vertices(spark, sf)
    ordered = repair_order(renumber(q.drop_duplicate_vertices(v)), long_km=LONG_KM)
    return q.verdicts(v, ordered, a.landmarks(spark, sf), long_km=LONG_KM).select(
        "line_id", "kept", "removed", "reordered", "intersections", "long_segments", "repeated_landmarks", "fatal",
        F.array_join("fixes", " | ").alias("fixes"), "warnings",
    )


@register(
    "v20_length_plausibility",
    query(
        f"""SELECT line_id, dataset, {s6('length_km')} AS length_km, min_km IS NOT NULL AS checked,
 coalesce(length_km BETWEEN min_km*(1-0.4e0) AND max_km*(1+0.4e0), false) AS valid FROM
(SELECT line_id, length_km, CASE line_id%3 WHEN 0 THEN 'black-sea.json' WHEN 1 THEN 'walk' ELSE 'other' END AS dataset FROM summary)
LEFT JOIN (VALUES ('black-sea.json',4000e0,4987e0),('walk',600e0,700e0)) r(dataset,min_km,max_km) USING (dataset)""",
        "summary",
    ),
)
def v20(spark, sf):
    kind = F.col("line_id") % 3
    lengths = line_summary(a.vertices(spark, sf)).select(
        "line_id",
        "length_km",
        F.when(kind == 0, "black-sea.json").when(kind == 1, "walk").otherwise("other").alias("dataset"),
    )
    ref = q.length_reference(spark).unionByName(
        spark.createDataFrame([("walk", 600.0, 700.0)], "dataset STRING, min_km DOUBLE, max_km DOUBLE")
    )
    return q.length_plausibility(lengths, ref).select("line_id", "dataset", r6("length_km"), "checked", "valid")


define(
    "tparams",
    """SELECT scenario, target_years, CASE WHEN years_per_step<=0 THEN 1.0e0 ELSE years_per_step END AS years_per_step,
 least(greatest(storm_probability,0.0e0),1.0e0) AS storm_probability, least(CASE WHEN storm_intensity<=1 THEN 2.0e0 ELSE storm_intensity END,10.0e0) AS storm_intensity,
 greatest(sea_level_rise,0.0e0) AS sea_level_rise, least(greatest(seasonal_phase,0.0e0),6.283185307179586e0) AS seasonal_phase, seasonality,
 0.1e0 AS min_years_per_step, 10.0e0 AS max_years_per_step FROM scenario_params""",
    "scenario_params",
)


@register(
    "v21_parameter_rules",
    query(
        """SELECT scenario, concat_ws(' | ', CASE WHEN years_per_step<min_years_per_step THEN printf('YearsPerStep %.2f < minimum %.2f',years_per_step,min_years_per_step) END,
 CASE WHEN years_per_step>max_years_per_step THEN printf('YearsPerStep %.2f > maximum %.2f',years_per_step,max_years_per_step) END,
 CASE WHEN storm_probability>0.5e0 THEN printf('High storm probability %.2f (unrealistic for most climates)',storm_probability) END,
 CASE WHEN sea_level_rise>0.01e0 THEN printf('High sea level rise %.4f m/year (exceeds IPCC RCP8.5)',sea_level_rise) END) AS warnings FROM tparams""",
        "tparams",
    ),
)
def v21(spark, sf):
    p = q.temporal_warnings(q.normalise_temporal(a.scenario_params(spark, sf)))
    return p.select("scenario", F.array_join("warnings", " | ").alias("warnings"))


@register(
    "v22_temporal_defaults",
    query(
        f"""SELECT scenario, {', '.join(f'{s6(c)} AS {c}' for c in ['years_per_step','storm_probability','storm_intensity','sea_level_rise','seasonal_phase','min_years_per_step','max_years_per_step'])} FROM tparams""",
        "tparams",
    ),
)
def v22(spark, sf):
    cols = ["years_per_step", "storm_probability", "storm_intensity", "sea_level_rise", "seasonal_phase",
            "min_years_per_step", "max_years_per_step"]
    return q.normalise_temporal(a.scenario_params(spark, sf)).select("scenario", *[r6(c) for c in cols])


@register(
    "v22_sediment_defaults",
    """SELECT c_custkey, CASE WHEN t<=0 OR t>1 THEN 0.7e0 ELSE t END AS transport_coefficient, CASE WHEN d<=0 OR d>1 THEN 0.5e0 ELSE d END AS deposition_rate,
 CASE WHEN k<=0 THEN 1.0e0 ELSE k END AS capacity_factor, CASE WHEN l<=0 OR l>1 THEN 0.8e0 ELSE l END AS longshore_drift_coefficient FROM
(SELECT c_custkey, (c_custkey%15-2)/10.0e0 AS t, (c_custkey%14-1)/10.0e0 AS d, (c_custkey%5-1)*0.5e0 AS k, (c_custkey%13-1)/10.0e0 AS l FROM customer)""",
)
def v22s(spark, sf):
    c = F.col("c_custkey")
    p = a.table(spark, sf, "customer").select(
        "c_custkey",
        ((c % 15 - 2) / 10.0).alias("transport_coefficient"),
        ((c % 14 - 1) / 10.0).alias("deposition_rate"),
        ((c % 5 - 1) * 0.5).alias("capacity_factor"),
        ((c % 13 - 1) / 10.0).alias("longshore_drift_coefficient"),
    )
    return q.normalise_sediment(p)


@register(
    "v22_wave_defaults",
    """SELECT c_custkey, s AS strength_m, CASE WHEN w<=0 THEN 12.0e0 ELSE w END AS wind_speed, CASE WHEN f<=0 THEN 55.0e0 ELSE f END AS fetch_spread_deg,
 CASE WHEN n<=0 THEN 9 ELSE n END AS fetch_samples, CASE WHEN m<=0 THEN 150000.0e0 ELSE m END AS max_fetch_m, CASE WHEN d<=0 THEN 4000.0e0 ELSE d END AS depth_scale_m,
 CASE WHEN e<=0 THEN 1.5e0 ELSE e END AS exposure_power, CASE WHEN r<=0 THEN s ELSE r END AS max_retreat_m, CASE WHEN p<=0 THEN 25.0e0 ELSE p END AS probe_m,
 CASE WHEN b%360<0 THEN b%360+360 ELSE b%360 END AS wind_dir_deg FROM
(SELECT c_custkey, 1.0e0+c_custkey%50 AS s, c_custkey%9-1.0e0 AS w, c_custkey%70-5.0e0 AS f, CAST(c_custkey%12-2 AS INTEGER) AS n, (c_custkey%20-1)*10000.0e0 AS m,
 (c_custkey%8-1)*1000.0e0 AS d, (c_custkey%6-1)*0.5e0 AS e, c_custkey%30-4.0e0 AS r, c_custkey%40-3.0e0 AS p, c_custkey*37%1500-750.0e0 AS b FROM customer)""",
)
def v22w(spark, sf):
    c = F.col("c_custkey")
    p = a.table(spark, sf, "customer").select(
        "c_custkey",
        (1.0 + c % 50).alias("strength_m"),
        (c % 9 - 1.0).alias("wind_speed"),
        (c % 70 - 5.0).alias("fetch_spread_deg"),
        (c % 12 - 2).cast("int").alias("fetch_samples"),
        ((c % 20 - 1) * 10000.0).alias("max_fetch_m"),
        ((c % 8 - 1) * 1000.0).alias("depth_scale_m"),
        ((c % 6 - 1) * 0.5).alias("exposure_power"),
        (c % 30 - 4.0).alias("max_retreat_m"),
        (c % 40 - 3.0).alias("probe_m"),
        (c * 37 % 1500 - 750.0).alias("wind_dir_deg"),
    )
    return q.normalise_wave(p)


@register(
    "v23_alert_digest",
    query(
        f"""SELECT line_id, CASE WHEN len(m)=0 AND removed>0 THEN printf('{q.ALERT_FIXES}', 1) ELSE array_to_string(m, ' | ') END AS alerts FROM (
 SELECT d.line_id, d.removed, list_concat(coalesce(l.m, []), coalesce(r.m, []))[1:5] AS m FROM
 (SELECT line_id, CAST(sum(copies)-count(*) AS BIGINT) AS removed FROM dedup GROUP BY 1) d
 LEFT JOIN (SELECT line_id, list_prepend(printf('{q.ALERT_COUNT}', {LONG_KM}e0, count(*)), list(printf('{q.ALERT_SEGMENT}', start_seq, seq, km) ORDER BY seq)[1:3]) AS m FROM segs WHERE km>{LONG_KM} GROUP BY 1) l USING (line_id)
 LEFT JOIN (SELECT line_id, list(x ORDER BY x) AS m FROM (SELECT line_id, printf('{q.MSG_LANDMARK}', landmark, vertices) AS x FROM repeated) GROUP BY 1) r USING (line_id))""",
        "dedup",
        "segs",
        "repeated",
    ),
)
def v23(spark, sf):
    v = a.vertices(spark, sf)
    fixes = q.duplicate_counts(v).select("line_id", (F.col("removed") > 0).cast("int").alias("fixes"))
    digest = q.alerts(
        q.long_segments(v, long_km=LONG_KM), q.repeated_landmarks(v, a.landmarks(spark, sf)), fixes, long_km=LONG_KM
    )
    return digest.select("line_id", F.array_join("alerts", " | ").alias("alerts"))

