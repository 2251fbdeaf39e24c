"""Interpolation and sediment queries I1-I7, E1-E7 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import sediment as e
from strandline.operators import spatial as i
from strandline.plans import adapters as a
from strandline.plans import geometry_queries  # noqa: F401  (defines shared tables)
from strandline.plans.registry import r6, register, s6
from strandline.plans.sql import define, query
from strandline.sources.lithology import DEFAULT_BOUNDS, DEFAULT_POINTS, default_classes, default_points

RES = 0.1
define(
    "grid",
    f"""SELECT CAST(floor(lat/{RES}e0) AS BIGINT) AS i, CAST(floor(lon/{RES}e0) AS BIGINT) AS j, arg_max(depth,ord) AS depth FROM bathy GROUP BY 1,2""",
    "bathy",
)


@register("i1_depth_grid", query("SELECT i, j, depth FROM grid", "grid"))
def i1(spark, sf):
    return i.build_grid(a.bathymetry(spark, sf), RES)


def depth_sql(base: str, cols: str) -> str:
    r = f"{RES}e0"
    return f"""SELECT {cols}, lat, lon, CASE WHEN outside THEN 'outside' WHEN v IS NULL THEN 'missing' ELSE 'ok' END AS status, CASE WHEN NOT outside THEN v END AS depth FROM (
SELECT p.*, NOT (p.lat BETWEEN b.a AND b.b AND p.lon BETWEEN b.c AND b.d) AS outside,
 (g0.depth+fx*(g1.depth-g0.depth))+fy*((g2.depth+fx*(g3.depth-g2.depth))-(g0.depth+fx*(g1.depth-g0.depth))) AS v
FROM (SELECT *, (lon-floor(lon/{r})*{r})/{r} AS fx, (lat-floor(lat/{r})*{r})/{r} AS fy, floor(floor(lat/{r})*{r}/{r}) AS i0, floor((floor(lat/{r})*{r}+{r})/{r}) AS i1,
  floor(floor(lon/{r})*{r}/{r}) AS j0, floor((floor(lon/{r})*{r}+{r})/{r}) AS j1 FROM {base}) p,
 (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM bathy) b
LEFT JOIN grid g0 ON g0.i=i0 AND g0.j=j0 LEFT JOIN grid g1 ON g1.i=i0 AND g1.j=j1 LEFT JOIN grid g2 ON g2.i=i1 AND g2.j=j0 LEFT JOIN grid g3 ON g3.i=i1 AND g3.j=j1)"""


define("depths", depth_sql("vertices", "line_id, seq"), "vertices", "bathy", "grid")


@register(
    "i2_bilinear_depth", query(f"SELECT line_id, seq, status, {s6('depth')} AS depth FROM depths", "depths")
)
def i2(spark, sf):
    return i.interpolate_depth(a.vertices(spark, sf), a.bathymetry(spark, sf), RES).select(
        "line_id", "seq", "status", r6("depth")
    )


@register(
    "i3_depth_factor",
    query(f"SELECT line_id, seq, {s6('1-exp(-greatest(-depth,0)/4000.0e0)')} AS depth_factor FROM depths WHERE status='ok'", "depths"),
)
def i3(spark, sf):
    d = i.interpolate_depth(a.vertices(spark, sf), a.bathymetry(spark, sf), RES).where(F.col("status") == "ok")
    return d.select("line_id", "seq", r6(i.depth_factor(F.col("depth"), 4000.0), "depth_factor"))


def near_sql(base: str, points: str, k: int = 6) -> str:
    return f"""SELECT * FROM (SELECT v.line_id, v.seq, v.lat, v.lon, p.ord, p.lithology_class, p.resistance, p.color, p.description, sqrt((p.lat-v.lat)*(p.lat-v.lat)+(p.lon-v.lon)*(p.lon-v.lon)) AS dist,
 row_number() OVER (PARTITION BY v.line_id, v.seq ORDER BY sqrt((p.lat-v.lat)*(p.lat-v.lat)+(p.lon-v.lon)*(p.lon-v.lon)), p.ord) AS rank FROM {base} v, {points} p) WHERE rank<={k}"""


def rock_sql(near: str) -> str:
    known = "first(lithology_class ORDER BY rank) IN (SELECT class FROM litho_classes)"
    return f"""SELECT line_id, seq, any_value(lat) AS lat, any_value(lon) AS lon, first(lithology_class ORDER BY rank) AS cls, first(color ORDER BY rank) AS col, first(description ORDER BY rank) AS des,
 CASE WHEN min(dist)<1e-6 THEN first(resistance ORDER BY rank) ELSE sum(resistance/(dist*dist))/sum(1.0e0/(dist*dist)) END AS res FROM {near} GROUP BY 1,2"""


define("near6", near_sql("vertices", "litho_points"), "vertices", "litho_points")
define("rocks", rock_sql("near6"), "near6")


@register(
    "i4_nearest_points",
    query(f"SELECT line_id, seq, rank, ord, {s6('dist')} AS distance_deg FROM near6", "near6"),
)
def i4(spark, sf):
    n = i.nearest_points(a.vertices(spark, sf), a.litho_points(spark, sf))
    return n.select("line_id", "seq", F.posexplode("near").alias("pos", "p")).select(
        "line_id", "seq", (F.col("pos") + 1).cast("bigint").alias("rank"), "p.ord", r6("p.dist", "distance_deg")
    )


def rock_select(known: str) -> str:
    return f"""line_id, seq, CASE WHEN {known} THEN cls ELSE 'limestone' END AS rock, {s6(f'CASE WHEN {known} THEN res ELSE 4.0e0 END')} AS rock_resistance,
 CASE WHEN {known} THEN col ELSE '#6b6b6b' END AS rock_color, CASE WHEN {known} THEN des ELSE 'default lithology' END AS rock_description"""


KNOWN = "cls IN ('limestone','volcanic','clay','sedimentary')"


def rock_columns():
    return ["line_id", "seq", "rock", r6("rock_resistance"), "rock_color", "rock_description"]



@register("i5_rock_idw", query(f"SELECT {rock_select(KNOWN)} FROM rocks", "rocks"))
def i5(spark, sf):
    return i.rock_at(a.vertices(spark, sf), a.litho_points(spark, sf), a.litho_classes(spark)).select(*rock_columns())


I6_BOUNDS = {"min_lat": 42.6, "max_lat": 43.4, "min_lon": 33.5, "max_lon": 34.5}


@register(
    "i6_rock_lookup",
    query(
        f"SELECT {rock_select(KNOWN + ' AND lat BETWEEN 42.6e0 AND 43.4e0 AND lon BETWEEN 33.5e0 AND 34.5e0')} FROM rocks",
        "rocks",
    ),
)
def i6(spark, sf):
    return i.rock_at(a.vertices(spark, sf), a.litho_points(spark, sf), a.litho_classes(spark), I6_BOUNDS).select(*rock_columns())


@register(
    "i7_profile_statistics",
    query(
        f"SELECT count(*) AS num_points, {s6('min(resistance)')} AS resistance_min, {s6('max(resistance)')} AS resistance_max, {s6('avg(resistance)')} AS resistance_mean FROM litho_points",
        "litho_points",
    ),
)
def i7(spark, sf):
    return i.profile_statistics(a.litho_points(spark, sf)).select(
        "num_points", r6("resistance_min"), r6("resistance_max"), r6("resistance_mean")
    )


@register(
    "i7_confidence_distribution",
    query("SELECT region, confidence, count(*) AS num_points FROM litho_points GROUP BY 1,2", "litho_points"),
)
def i7c(spark, sf):
    return i.confidence_distribution(a.litho_points(spark, sf), ["region"])


DEFAULTS = ",".join(
    f"({n},{p[0]}e0,{p[1]}e0,'{p[3]}',{p[4]}e0,'{p[5]}','{p[6]}')" for n, p in enumerate(DEFAULT_POINTS)
)
define(
    "default_points",
    f"SELECT * FROM (VALUES {DEFAULTS}) t(ord,lat,lon,lithology_class,resistance,color,description)",
)
define("near_default", near_sql("vertices", "default_points"), "vertices", "default_points")
define("rocks_default", rock_sql("near_default"), "near_default")


@register(
    "s5_default_profile", query(f"SELECT {rock_select(KNOWN)} FROM rocks_default", "rocks_default")
)
def s5(spark, sf):
    return i.rock_at(
        a.vertices(spark, sf), default_points(spark), default_classes(spark), DEFAULT_BOUNDS
    ).select(*rock_columns())


# -- sediment ----------------------------------------------------------------

P = e.SedimentParams(direction_deg=45.0, capacity_factor=0.25)
define(
    "vol",
    """SELECT *, er*share AS tr, er*(1-share) AS de FROM (SELECT *, CASE WHEN resistance>0 THEN erosion_rate/resistance ELSE erosion_rate END AS er,
 0.7e0*(CASE WHEN resistance>5 THEN 0.7e0 ELSE 1.0e0 END) AS share, coalesce(energy,0.5e0) AS en FROM sediment_input)""",
    "sediment_input",
)
define(
    "sent",
    """SELECT *, CASE WHEN ch>=1e-9 THEN tr*0.5e0*dr*(CASE WHEN fw THEN 1.5e0 ELSE 0.5e0 END) ELSE 0 END AS tn, CASE WHEN ch>=1e-9 THEN tr*0.5e0*dr*(CASE WHEN fw THEN 0.5e0 ELSE 1.5e0 END) ELSE 0 END AS tp FROM (
 SELECT *, 0.8e0*abs(cx/ch*sin(radians(45e0))+cy/ch*cos(radians(45e0)))*en AS dr, cx/ch*cos(radians(45e0))-cy/ch*sin(radians(45e0))>0 AS fw FROM (
  SELECT *, sqrt(cx*cx+cy*cy) AS ch FROM (
   SELECT *, coalesce(lead(lon) OVER w, first_value(lon) OVER g)-coalesce(lag(lon) OVER w, last_value(lon) OVER g) AS cx,
    coalesce(lead(lat) OVER w, first_value(lat) OVER g)-coalesce(lag(lat) OVER w, last_value(lat) OVER g) AS cy FROM vol
   WINDOW w AS (PARTITION BY line_id ORDER BY seq), g AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))""",
    "vol",
)
define(
    "got",
    """SELECT *, coalesce(lag(tn) OVER w, last_value(tn) OVER g)+coalesce(lead(tp) OVER w, first_value(tp) OVER g) AS inc FROM sent
 WINDOW w AS (PARTITION BY line_id ORDER BY seq), g AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "sent",
)
define(
    "settled",
    """SELECT *, tr+CASE WHEN inc>cap THEN ex-ad ELSE 0 END AS tr2, de+ad AS de2, er-(de+ad) AS net,
 CASE WHEN acc THEN greatest(erosion_rate-(de+ad),0) ELSE erosion_rate END AS mr FROM (
 SELECT *, CASE WHEN acc THEN ex*0.5e0 ELSE 0.0e0 END AS ad FROM (
  SELECT *, CASE WHEN inc>cap THEN inc-cap ELSE cap*0.5e0 END AS ex, inc>cap OR en<0.3e0 AS acc FROM (SELECT *, 0.25e0*en AS cap FROM got)))""",
    "got",
)


@register(
    "e1_erosion_volumes",
    query(f"SELECT line_id, seq, {s6('er')} AS eroded, {s6('tr')} AS transported, {s6('de')} AS deposited FROM vol", "vol"),
)
def e1(spark, sf):
    return e.erosion_volumes(a.sediment_input(spark, sf), P).select(
        "line_id", "seq", r6("eroded"), r6("transported"), r6("deposited")
    )


@register(
    "e2_longshore_exchange",
    query(f"SELECT line_id, seq, {s6('tp')} AS to_prev, {s6('tn')} AS to_next, {s6('inc')} AS incoming FROM got", "got"),
)
def e2(spark, sf):
    x = e.longshore_exchange(e.erosion_volumes(a.sediment_input(spark, sf), P), P)
    return x.select("line_id", "seq", r6("to_prev"), r6("to_next"), r6("incoming"))


def _budget(spark, sf):
    return e.sediment_budget(a.sediment_input(spark, sf), P)


@register(
    "e3_deposition",
    query(
        f"SELECT line_id, seq, {s6('tr2')} AS transported, {s6('de2')} AS deposited, acc AS accumulating, {s6('net')} AS net_change FROM settled",
        "settled",
    ),
)
def e3(spark, sf):
    return _budget(spark, sf)[0].select(
        "line_id", "seq", r6("transported"), r6("deposited"), "accumulating", r6("net_change")
    )


define(
    "totals",
    """SELECT *, CASE WHEN te>0 THEN abs(te-(td+tt))/te ELSE 0 END AS br, CASE WHEN te>0 THEN abs(te-(td+tt))/te<0.15e0 ELSE true END AS ok FROM
(SELECT line_id, sum(er) AS te, sum(tr2) AS tt, sum(de2) AS td, count(*) FILTER (net>0) AS ep, count(*) FILTER (net<0) AS dp FROM settled GROUP BY 1)""",
    "settled",
)


@register(
    "e4_budget_totals",
    query(
        f"""SELECT line_id, {s6('te')} AS total_eroded, {s6('tt')} AS total_transport, {s6('td')} AS total_deposited, {s6('te-td')} AS net_change, {s6('br')} AS balance_ratio, ok AS is_valid,
 concat_ws(' | ', CASE WHEN NOT ok THEN printf('Poor mass balance: %.2f vs %.2f', te, td) END, CASE WHEN ep>0 THEN printf('Erosion at %d points', ep) END, CASE WHEN dp>0 THEN printf('Deposition at %d points', dp) END) AS warnings FROM totals""",
        "totals",
    ),
)
def e4(spark, sf):
    return _budget(spark, sf)[1].select(
        "line_id", r6("total_eroded"), r6("total_transport"), r6("total_deposited"), r6("net_change"),
        r6("balance_ratio"), "is_valid", F.array_join("warnings", " | ").alias("warnings"),
    )


@register(
    "e5_modified_rate",
    query(f"SELECT line_id, seq, {s6('erosion_rate')} AS baseline_rate, {s6('mr')} AS modified_rate FROM settled", "settled"),
)
def e5(spark, sf):
    return _budget(spark, sf)[0].select("line_id", "seq", r6("erosion_rate", "baseline_rate"), r6("modified_rate"))


@register(
    "e6_budget_statistics",
    query(
        f"""SELECT line_id, {s6('te')} AS total_eroded_m3, {s6('td')} AS total_deposited_m3, {s6('tt')} AS total_transport_m3, {s6('te-td')} AS net_change_m3, {s6('br')} AS mass_balance, ok AS is_valid, ep AS erosion_points, dp AS deposition_points FROM totals""",
        "totals",
    ),
)
def e6(spark, sf):
    t = _budget(spark, sf)[1]
    return t.select(
        "line_id", r6("total_eroded", "total_eroded_m3"), r6("total_deposited", "total_deposited_m3"),
        r6("total_transport", "total_transport_m3"), r6("net_change", "net_change_m3"),
        r6("balance_ratio", "mass_balance"), "is_valid", "erosion_points", "deposition_points",
    )


@register(
    "e7_sediment_budget",
    query(
        f"""SELECT s.line_id, s.seq, {s6('er')} AS eroded, {s6('inc')} AS incoming, {s6('net')} AS net_change, acc AS accumulating, {s6('mr')} AS modified_rate, t.ok AS line_valid FROM settled s JOIN totals t USING (line_id)""",
        "settled",
        "totals",
    ),
)
def e7(spark, sf):
    from strandline.lines import attach

    rows, totals = _budget(spark, sf)
    span = rows.groupBy("line_id").agg(F.min("seq").alias("lo_seq"), F.max("seq").alias("hi_seq"))
    line = totals.select("line_id", F.col("is_valid").alias("line_valid")).join(span, "line_id")
    return attach(rows, line).select(
        "line_id", "seq", r6("eroded"), r6("incoming"), r6("net_change"), "accumulating", r6("modified_rate"), "line_valid"
    )
