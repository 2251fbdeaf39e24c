"""Source and sink queries S1-S18 on documents derived from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators.spatial import build_grid
from strandline.plans import adapters as a
from strandline.plans import fractal_queries, quality_queries  # noqa: F401  (defines shared tables)
from strandline.plans.geometry_queries import simplified
from strandline.plans.registry import r6, register, s6
from strandline.plans.sql import define, hav, query
from strandline.sinks import reports as docs_out
from strandline.sinks import tables
from strandline.sources import documents as d
from strandline.sources import lithology as lit
from strandline.sources.naming import dataset_name, slug, snapshot_name
from strandline.sources.raster import resample
from strandline.session import shared_dir, stored
from strandline.sources.step_metrics import read_step_metrics, scenario_folder, step_metrics_rejects

LONG_KM = quality_queries.LONG_KM


@register("s1_point_array", query("SELECT doc_id, pos+1 AS seq, lat, lon FROM docs", "docs"))
def s1(spark, sf):
    return d.parse_points(a.point_documents(spark, sf)).select(
        "doc_id", "seq", r6("lat", digits=2), r6("lon", digits=2)
    )


define(
    "doc_seqs",
    """SELECT doc_id, line_id, CAST(CASE WHEN line_id%6 IN (2,4,5) AND pos>=n//2 THEN 1 ELSE 0 END AS INTEGER) AS sequence_id,
 CAST(CASE WHEN line_id%6 IN (2,4,5) AND pos>=n//2 THEN pos-n//2 ELSE pos END + 1 AS INTEGER) AS seq, lat, lon FROM docs""",
    "docs",
)


@register("s2_geojson", query("SELECT doc_id, sequence_id, seq, lat, lon FROM doc_seqs", "doc_seqs"))
def s2(spark, sf):
    return d.geojson_vertices(d.parse_geojson(a.geojson_documents(spark, sf))).select(
        "doc_id", "sequence_id", "seq", r6("lat", digits=2), r6("lon", digits=2)
    )


@register(
    "s2_rejected",
    """SELECT CAST(event_id AS VARCHAR) AS doc_id, CASE event_id%6 WHEN 0 THEN 'empty payload' WHEN 1 THEN 'unreadable json' WHEN 2 THEN 'unsupported root type'
 WHEN 3 THEN 'feature without geometry' WHEN 4 THEN 'unsupported or unreadable geometry' ELSE 'position with fewer than two ordinates' END AS reason FROM events""",
)
def s2r(spark, sf):
    k = F.col("event_id") % 6
    docs = a.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("doc_id"),
        F.when(k == 0, "  ")
        .when(k == 1, '{"type":')
        .when(k == 2, '{"type":"Topology"}')
        .when(k == 3, '{"type":"Feature","geometry":null}')
        .when(k == 4, '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}')
        .otherwise('{"type":"LineString","coordinates":[[1,2],[3]]}')
        .alias("payload"),
    )
    return d.rejected(d.parse_geojson(docs))


@register(
    "s3_bathymetry_documents",
    query(
        "SELECT ord//1000 AS doc, ord%1000 AS ord, round(lat,2) AS lat, round(lon,2) AS lon, depth FROM bathy", "bathy"
    ),
)
def s3(spark, sf):
    b = a.bathymetry(spark, sf)
    parts = b.groupBy(F.floor(F.col("ord") / 1000).alias("doc")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("ord", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"), "depth")
            )
        ).alias("p")
    )
    text = F.to_json(F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["depth"].alias("depth"))))
    docs = parts.select(F.col("doc").alias("doc_id"), text.alias("payload"))
    return d.parse_bathymetry(docs).withColumnRenamed("doc_id", "doc")


def profile_documents(spark, sf):
    """Profiles of at most 50 rock points each."""
    p = a.litho_points(spark, sf).withColumn("doc", F.floor(F.col("ord") / 50))
    point = F.struct("ord", "lat", "lon", "region", "lithology_class", "resistance", "color", "description", "confidence")
    classes = F.map_from_entries(
        F.array(
            *[
                F.struct(F.lit(c), F.struct(F.lit(r).alias("resistance"), F.lit(col).alias("color"), F.lit(t).alias("description")))
                for c, r, col, t in lit.DEFAULT_CLASSES
            ]
        )
    )
    base = F.map_from_entries(
        F.array(
            *[
                F.struct(
                    F.lit(b[0]),
                    F.struct(
                        F.array(F.lit(b[1]), F.lit(b[2])).alias("resistance_range"),
                        F.create_map(F.lit("min"), F.lit(b[3]), F.lit("max"), F.lit(b[4]), F.lit("mean"), F.lit(b[5])).alias("erosion_m_year"),
                        F.lit(b[6]).alias("description"),
                    ),
                )
                for b in lit.DEFAULT_BASELINES
            ]
        )
    )
    grouped = p.groupBy("doc").agg(F.array_sort(F.collect_list(point)).alias("points"))
    meta = F.struct(
        F.concat(F.lit("profile "), F.col("doc").cast("string")).alias("name"),
        F.lit("1.0").alias("version"),
        F.lit(0.1).alias("resolution"),
        F.struct(*[F.lit(v).alias(k) for k, v in lit.DEFAULT_BOUNDS.items()]).alias("bounds"),
    )
    body = F.to_json(F.struct(meta.alias("metadata"), "points", classes.alias("classes"), base.alias("erosion_baselines")))
    return grouped.select(F.col("doc").alias("doc_id"), body.alias("payload"))


@register(
    "s4_profile_points",
    query(
        f"SELECT ord//50 AS doc, CAST(ord%50 AS INTEGER) AS ord, {s6('lat')} AS lat, {s6('lon')} AS lon, region, lithology_class, {s6('resistance')} AS resistance, color, description, confidence FROM litho_points",
        "litho_points",
    ),
)
def s4(spark, sf):
    p = lit.profile_points(lit.parse_profiles(profile_documents(spark, sf)))
    return p.select(
        F.col("doc_id").alias("doc"), "ord", r6("lat"), r6("lon"), "region", "lithology_class", r6("resistance"), "color",
        "description", "confidence",
    )


@register(
    "s4_profile_metadata",
    query(
        "SELECT 'profile '||CAST(ord//50 AS VARCHAR) AS name, '1.0' AS version, 0.1e0 AS resolution, 40.0e0 AS min_lat, CAST(count(*) AS INTEGER) AS n_points, 4 AS n_classes, 6 AS n_baselines FROM litho_points GROUP BY ord//50",
        "litho_points",
    ),
)
def s4m(spark, sf):
    m = lit.profile_metadata(lit.parse_profiles(profile_documents(spark, sf)))
    return m.select("name", "version", "resolution", F.col("bounds.min_lat").alias("min_lat"), "n_points", "n_classes", "n_baselines")


@register(
    "s4_rejected_profiles",
    """SELECT CAST(event_id AS VARCHAR) AS doc_id, CASE event_id%6 WHEN 0 THEN 'empty payload' WHEN 1 THEN 'unreadable json' WHEN 2 THEN 'no profile'
 WHEN 3 THEN 'no name' WHEN 4 THEN 'no points' END AS reason FROM events WHERE event_id%6<5""",
)
def s4r(spark, sf):
    k = F.col("event_id") % 6
    docs = a.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("doc_id"),
        F.when(k == 0, " ")
        .when(k == 1, '{"metadata":')
        .when(k == 2, "[1,2]")
        .when(k == 3, '{"metadata":{"name":" "},"points":[{"lat":1,"lon":2}]}')
        .when(k == 4, '{"metadata":{"name":"p"},"points":[],"classes":{}}')
        .otherwise('{"metadata":{"name":"p"},"points":[{"lat":1,"lon":2,"lithology_class":"clay"}],"classes":{"clay":{"resistance":1.2}}}')
        .alias("payload"),
    )
    return lit.rejected_profiles(docs)


def _r1(expr: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', round_even({expr}*1e{digits},0)/1e{digits})"


# columns of the files of some scenarios, by the first character of their name
LAYOUTS = {
    "14": tables.LONG_COLUMNS,
    "25": ["storm_event", "note", "net_change_m3", "length_km", "eroded_m3", "step", "year"],
    "3": ["sea_level_m", "step", "area_km2", "length_km", "storm_event"],
}


@register(
    "s6_step_metrics_csv",
    query(
        f"""SELECT scenario, CASE WHEN scenario[1] <> '3' THEN CAST({_r1('year')} AS DOUBLE) END AS year, step, CAST({_r1('length_km')} AS DOUBLE) AS length_km,
 CASE WHEN scenario[1] NOT IN ('2','5') THEN CAST({_r1('area_km2')} AS DOUBLE) END AS area_km2, storm_event,
 CASE WHEN scenario[1] NOT IN ('2','5') THEN CAST({_r1('sea_level_m',4)} AS DOUBLE) END AS sea_level_m FROM step_metrics""",
        "step_metrics",
    ),
)
def s6q(spark, sf):
    """Files with columns in different order, absent columns and one that nobody knows, written and read back."""
    long = tables.long_frame(a.step_metrics(spark, sf)).withColumn("note", F.lit("x, y"))
    folder = f"{shared_dir(spark).rstrip('/')}/step-metrics-{uuid.uuid4().hex}"
    for heads, columns in LAYOUTS.items():
        part = long.where(F.substring("scenario", 1, 1).isin(*heads)).select("scenario", *columns)
        part.write.mode("append").partitionBy("scenario").option("header", True).csv(folder)
    return read_step_metrics(spark, folder, scenario=scenario_folder).select(
        "scenario", "year", "step", "length_km", "area_km2", "storm_event", "sea_level_m"
    )


@register(
    "s6_step_metrics_rejects",
    query(
        """SELECT scenario, reason, count(*) AS n, CAST(min(step) AS INTEGER) AS first_step FROM (
 SELECT scenario, step, CASE WHEN step%11=0 THEN 'wrong number of fields' WHEN step%7=0 THEN 'length_km is no double' WHEN step%5=0 THEN 'no length_km' END AS reason
 FROM step_metrics) WHERE reason IS NOT NULL GROUP BY 1,2""",
        "step_metrics",
    ),
)
def s6r(spark, sf):
    """Records with a field too many, a length that is no number, and no length, found and told apart."""
    step = F.col("step").cast("int")
    length = F.when(step % 11 == 0, "1.0,2.0").when(step % 7 == 0, "long").when(step % 5 == 0, "").otherwise(F.col("length_km"))
    long = tables.long_frame(a.step_metrics(spark, sf))
    body = long.select("scenario", step.alias("at"), F.concat_ws(",", "year", length, "step").alias("line"))
    heads = long.select("scenario", F.lit(-10_000_000).alias("at"), F.lit("year,length_km,step").alias("line")).distinct()
    lines = body.union(heads).repartition("scenario").sortWithinPartitions("scenario", "at")
    folder = f"{shared_dir(spark).rstrip('/')}/step-rejects-{uuid.uuid4().hex}"
    lines.select("scenario", "line").write.partitionBy("scenario").text(folder)
    found = step_metrics_rejects(spark, folder, scenario=scenario_folder)
    at = F.element_at(F.split("record", ","), -1).cast("int")
    return found.groupBy("scenario", "reason").agg(F.count("*").alias("n"), F.min(at).alias("first_step"))


COORD = "'['||{0}||']'"
define(
    "doc_text",
    """SELECT doc_id, line_id, line_id%6 AS kind, n, '['||string_agg(t, ',' ORDER BY pos)||']' AS c, '['||coalesce(string_agg(t, ',' ORDER BY pos) FILTER (pos<n//2),'')||']' AS a, '['||coalesce(string_agg(t, ',' ORDER BY pos) FILTER (pos>=n//2),'')||']' AS b
FROM (SELECT *, '['||printf('%.2f',lon)||','||printf('%.2f',lat)||']' AS t FROM docs) GROUP BY doc_id, line_id, n""",
    "docs",
)
define(
    "payloads",
    """SELECT doc_id, line_id, kind, CASE kind WHEN 0 THEN '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Name":" Line '||line_id||' ","MRGID":'||line_id||'},"geometry":{"type":"Polygon","coordinates":['||c||']}},{"type":"Feature","properties":null,"geometry":null}]}'
 WHEN 1 THEN '{"type":"Feature","properties":{"name":"Shore '||line_id||'"},"geometry":{"type":"LineString","coordinates":'||c||'}}'
 WHEN 2 THEN '{"type":"MultiLineString","coordinates":['||a||','||b||']}' WHEN 3 THEN '{"type":"Polygon","coordinates":['||c||']}'
 WHEN 4 THEN '{"type":"MultiPolygon","coordinates":[['||a||'],['||b||']]}'
 ELSE '{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":'||a||'},{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":['||b||']}]}]}' END AS payload FROM doc_text""",
    "doc_text",
)
define(
    "doc_best",
    f"""SELECT doc_id, arg_max(points,(km,points,-sequence_id)) AS points, arg_max(a,(km,points,-sequence_id)) AS min_lat, arg_max(b,(km,points,-sequence_id)) AS max_lat, arg_max(c,(km,points,-sequence_id)) AS min_lon, arg_max(d,(km,points,-sequence_id)) AS max_lon FROM (
 SELECT doc_id, sequence_id, count(*) AS points, coalesce(sum(km),0) AS km, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM (
  SELECT *, CASE WHEN plat IS NOT NULL THEN {hav('plat','plon','lat','lon')} END AS km FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM doc_seqs WINDOW w AS (PARTITION BY doc_id, sequence_id ORDER BY seq))) GROUP BY 1,2) GROUP BY 1""",
    "doc_seqs",
)


@register(
    "s7_source_inspection",
    query(
        """SELECT doc_id, 'GeoJSON' AS format, ['FeatureCollection','Feature','MultiLineString','Polygon','MultiPolygon','GeometryCollection'][kind+1] AS root_type, CASE WHEN kind=0 THEN 2 ELSE 1 END AS feature_count,
 ['Polygon','LineString','MultiLineString','Polygon','MultiPolygon','GeometryCollection'][kind+1] AS geometry_types, CASE kind WHEN 0 THEN 'Line '||line_id WHEN 1 THEN 'Shore '||line_id ELSE '' END AS name,
 CASE kind WHEN 0 THEN CAST(line_id AS VARCHAR) ELSE '' END AS region_id, CAST(strlen(payload) AS INTEGER) AS payload_bytes, points, min_lat, max_lat, min_lon, max_lon
FROM payloads JOIN doc_best USING (doc_id)
UNION ALL SELECT 'p'||doc_id, 'point-array', 'array', 1, 'PointArray', '', '', CAST(1+any_value(n)+sum(strlen(printf('%.2f',lat))+strlen(printf('%.2f',lon))+15) AS INTEGER), count(*), min(lat), max(lat), min(lon), max(lon) FROM docs GROUP BY doc_id""",
        "payloads",
        "doc_best",
        "docs",
    ),
)
def s7(spark, sf):
    points = a.point_documents(spark, sf).withColumn("doc_id", F.concat(F.lit("p"), "doc_id"))
    both = d.inspect_geojson(a.geojson_documents(spark, sf)).unionByName(d.inspect_points(points))
    return both.withColumn("geometry_types", F.array_join("geometry_types", ","))


@register(
    "s8_property_lookup",
    "SELECT event_id, json_extract_string(props,'$.k') AS found, '' AS absent FROM events",
)
def s8(spark, sf):
    v = F.try_parse_json("props")
    return a.table(spark, sf, "events").select(
        "event_id", d.property_text(v, "K").alias("found"), d.property_text(v, "other").alias("absent")
    )


define(
    "named_pages",
    """SELECT *, CASE WHEN nm<>'' THEN nm WHEN u<>'' THEN coalesce(nullif(regexp_extract(regexp_extract(u,'^[a-z]+://[^/?#]*([^?#]*)',1),'([^/]+)/*$',1),''), nullif(regexp_extract(u,'^[a-z]+://([^/?#]*)',1),''), u)
 WHEN p<>'' THEN regexp_extract(p,'([^/]+)/*$',1) ELSE 'coastline' END AS dataset FROM
(SELECT page_id, CASE page_id%5 WHEN 0 THEN 'Побережье №'||page_id||' — Black Sea!' ELSE '' END AS nm, CASE WHEN page_id%3=0 THEN '' WHEN page_id%7=0 THEN 'http://host'||page_id||'.example.com/' ELSE url END AS u,
  CASE WHEN page_id%2=0 THEN '' ELSE '/data/in/file_'||page_id||'.json' END AS p FROM pages)""",
)


def _named_pages(spark, sf):
    k = F.col("page_id")
    text = k.cast("string")
    return a.table(spark, sf, "pages").select(
        "page_id",
        dataset_name(
            F.when(k % 5 == 0, F.concat(F.lit(" Побережье №"), text, F.lit(" — Black Sea! "))).when(k % 5 == 1, "   "),
            F.when(k % 3 == 0, F.lit(None).cast("string"))
            .when(k % 7 == 0, F.concat(F.lit("http://host"), text, F.lit(".example.com/")))
            .otherwise(F.col("url")),
            F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("/data/in/file_"), text, F.lit(".json"))),
        ).alias("dataset"),
    )


@register("s9_dataset_name", query("SELECT page_id, dataset FROM named_pages", "named_pages"))
def s9(spark, sf):
    return _named_pages(spark, sf)


SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(dataset)),'[^\\p{L}\\p{Nd}]+','-','g'),'[^a-z0-9-]','','g'),'-+','-','g'),'-')"


def snapshot_time():
    return F.to_timestamp(F.lit("2024-01-02 03:04:05"))



@register(
    "s10_snapshot_name",
    query(
        f"SELECT page_id, {SLUG} AS slug, coalesce(nullif({SLUG},''),'coastline')||'-20240102-030405'||CASE WHEN page_id%2=0 THEN '.json' ELSE '.geojson' END AS file_name FROM named_pages",
        "named_pages",
    ),
)
def s10(spark, sf):
    return _named_pages(spark, sf).select(
        "page_id", slug(F.col("dataset")).alias("slug"),
        snapshot_name(F.col("dataset"), F.col("page_id") % 2 == 0, snapshot_time()).alias("file_name"),
    )


@register(
    "s11_snapshot_frame",
    query(
        "SELECT 'shore-'||doc_id AS dataset, '20240102-030405' AS snapshot_ts, 'shore-'||doc_id||'-20240102-030405.geojson' AS file_name, CAST(strlen(payload) AS INTEGER) AS bytes FROM payloads",
        "payloads",
    ),
)
def s11(spark, sf):
    docs = a.geojson_documents(spark, sf).select(
        F.concat(F.lit("Shore "), "doc_id").alias("dataset"), F.lit(False).alias("is_point_array"), "payload"
    )
    return tables.snapshot_frame(docs, snapshot_time()).select(
        "dataset", "snapshot_ts", "file_name", F.octet_length("payload").alias("bytes")
    )


LONG_SQL = f"""SELECT scenario, {_r1('year')} AS year, CAST(step AS VARCHAR) AS step, {', '.join(f'{_r1(c)} AS {c}' for c in ['length_km','area_km2','eroded_m3','deposited_m3','net_change_m3'])},
 CASE WHEN storm_event THEN 'true' ELSE 'false' END AS storm_event, {_r1('greatest(sea_level_m,0)', 4)} AS sea_level_m FROM step_metrics"""
define("long_table", LONG_SQL, "step_metrics")


@register("s12_long_table", query("SELECT * FROM long_table", "long_table"))
def s12(spark, sf):
    return tables.long_frame(a.step_metrics(spark, sf))


@register(
    "s13_wide_table",
    query(
        "SELECT scenario, metric_name, "
        + ", ".join(f"max(value) FILTER (step='{i}') AS step_{i}" for i in range(80))
        + " FROM ("
        + " UNION ALL ".join(f"SELECT scenario, step, '{m}' AS metric_name, {m} AS value FROM long_table" for m in tables.WIDE_METRICS)
        + ") GROUP BY 1,2",
        "long_table",
    ),
)
def s13(spark, sf):
    return tables.wide_frame(a.step_metrics(spark, sf))


@register(
    "s14_coastline_document",
    query(
        f"""SELECT line_id, pb AS real_points, {s6('lb')} AS real_km, pa AS render_points, {s6('la')} AS render_km, {s6('(la-lb)/lb*100')} AS delta_percent, coalesce(nl,0) AS long_segments, coalesce(nr,0) AS repeated, CAST(2 AS INTEGER) AS issues
FROM (SELECT line_id, points AS pb, length_km AS lb FROM summary) JOIN (SELECT line_id, count(*) AS pa, coalesce(sum(km),0.0e0) AS la FROM
  (SELECT line_id, {hav('plat','plon','lat','lon')} AS km FROM (SELECT line_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM kept WINDOW w AS (PARTITION BY line_id ORDER BY seq))) GROUP BY 1) USING (line_id)
LEFT JOIN (SELECT line_id, CAST(count(*) AS INTEGER) AS nl FROM segs WHERE km>{LONG_KM} GROUP BY 1) USING (line_id) LEFT JOIN (SELECT line_id, CAST(count(*) AS INTEGER) AS nr FROM repeated GROUP BY 1) USING (line_id)""",
        "summary",
        "kept",
        "segs",
        "repeated",
    ),
)
def s14(spark, sf):
    v = stored(a.vertices(spark, sf), "vertices")
    docs = docs_out.coastline_documents(v, simplified(v), a.landmarks(spark, sf), long_km=LONG_KM)
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c))
    return docs.select(
        "line_id",
        F.col("real.points_count").alias("real_points"),
        r6("real.length_km", "real_km"),
        F.col("render.points_count").alias("render_points"),
        r6("render.length_km", "render_km"),
        r6("render_simplification.length_delta_percent", "delta_percent"),
        size("highlights.long_segments").alias("long_segments"),
        size("validation.duplicate_locations").alias("repeated"),
        size("validation.summary").alias("issues"),
    )


@register(
    "s15_erosion_series_document",
    query(
        f"""SELECT line_id, s.points AS reference_points, {s6('s.length_km')} AS reference_km, step, l.points AS points, {s6('l.length_km')} AS length_km, {s6('area_km2',5)} AS area_km2
FROM snap_len l JOIN snap_area USING (line_id, step) JOIN summary s USING (line_id)""",
        "snap_len",
        "snap_area",
        "summary",
    ),
)
def s15(spark, sf):
    docs = docs_out.erosion_series_documents(a.snapshots(spark, sf), a.vertices(spark, sf))
    return docs.select("line_id", "reference_coastline", F.explode("steps").alias("s")).select(
        "line_id",
        F.col("reference_coastline.points_count").alias("reference_points"),
        r6("reference_coastline.length_km", "reference_km"),
        "s.step",
        "s.points",
        r6("s.length_km", "length_km"),
        r6("s.area_km2", "area_km2", 5),
    )


@register(
    "s16_fractal_series_document",
    query(
        f"""SELECT line_id, step AS iteration, points AS points_count, {s6('length_km')} AS length_km, {s6('length_km/b')} AS relative_to_model_base, valid, {s6('CASE WHEN valid THEN dimension END')} AS dimension, sample_count
FROM (SELECT *, first_value(length_km) OVER (PARTITION BY line_id ORDER BY step) AS b FROM snap_len) JOIN sdims USING (line_id, step)""",
        "snap_len",
        "sdims",
    ),
)
def s16(spark, sf):
    docs = docs_out.fractal_series_documents(a.snapshots(spark, sf))
    return docs.select("line_id", F.explode("iterations").alias("i")).select(
        "line_id", "i.iteration", "i.points_count", r6("i.length_km", "length_km"),
        r6("i.relative_to_model_base", "relative_to_model_base"), "i.dimension.valid",
        r6("i.dimension.dimension", "dimension"), "i.dimension.sample_count",
    )


@register(
    "s17_report_document",
    query(
        f"""SELECT scenario, n AS total_steps, {s6('y',4)} AS simulated_years, {s6('e',4)} AS total_erosion_m3, k AS storm_events, step, {s6('length_km',4)} AS length_km, storm_event FROM step_metrics JOIN
(SELECT scenario, count(*) AS n, max(year)-min(year) AS y, sum(eroded_m3) AS e, count(*) FILTER (storm_event) AS k FROM step_metrics GROUP BY 1) USING (scenario)""",
        "step_metrics",
    ),
)
def s17(spark, sf):
    docs = docs_out.report_documents(a.step_metrics(spark, sf))
    return docs.select("scenario", "summary", F.explode("analysis.steps").alias("s")).select(
        "scenario", "summary.total_steps", r6("summary.simulated_years", "simulated_years", 4),
        r6("summary.total_erosion_m3", "total_erosion_m3", 4), "summary.storm_events", "s.step",
        r6("s.length_km", "length_km", 4), "s.storm_event",
    )


BOUNDS = (40.0, 47.0, 27.0, 42.5)
STEP = 0.25
define(
    "raster",
    "SELECT (i+0.5e0)*0.1e0 AS lat, (j+0.5e0)*0.1e0 AS lon, CASE WHEN (i+j)%3=0 THEN -depth ELSE depth END AS value FROM grid",
    "grid",
)


def _axis_sql(name: str, low: float, high: float) -> str:
    n = int((high - low) / STEP) + 1
    return f"""SELECT t, arg_min(v, (abs(v-t), v)) AS v FROM (SELECT {low}e0+k*{STEP}e0 AS t FROM range({n}) r(k)), (SELECT DISTINCT {name} AS v FROM raster WHERE lat BETWEEN 40 AND 47 AND lon BETWEEN 27 AND 42.5e0) GROUP BY t"""


define("raxis", _axis_sql("lat", 40.0, 47.0), "raster")
define("caxis", _axis_sql("lon", 27.0, 42.5), "raster")


@register(
    "s18_resampled_raster",
    query(
        "SELECT round(a.t,6) AS lat, round(b.t,6) AS lon, round(-abs(value),2)+0.0e0 AS depth FROM raster r JOIN raxis a ON a.v=r.lat JOIN caxis b ON b.v=r.lon",
        "raster",
        "raxis",
        "caxis",
    ),
)
def s18(spark, sf):
    g = build_grid(a.bathymetry(spark, sf), 0.1)
    raster = g.select(
        ((F.col("i") + 0.5) * 0.1).alias("lat"),
        ((F.col("j") + 0.5) * 0.1).alias("lon"),
        F.when((F.col("i") + F.col("j")) % 3 == 0, -F.col("depth")).otherwise(F.col("depth")).alias("value"),
    )
    return resample(raster, BOUNDS, STEP)
