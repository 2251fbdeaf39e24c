"""Fractal and snapshot-series queries F1-F10, T1-T7 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import fractal as f
from strandline.operators import series as t
from strandline.operators.geometry import line_summary
from strandline.operators.quality import normalise_temporal
from strandline.plans import adapters as a
from strandline.plans import quality_queries  # noqa: F401  (defines shared tables)
from strandline.plans.registry import r6, register, s6
from strandline.plans.sql import define, hav, query

SCALES = ",".join(f"({s})" for s in f.SCALE_FACTORS)
OFFS = ",".join(f"({i},{x}e0,{y}e0)" for i, (x, y) in enumerate(f.OFFSETS))


def coverage_sql(base: str, k: str, offsets: str) -> str:
    return f"""SELECT {k}, scale_factor, any_value(size) AS size, count(DISTINCT (o, r, c)) AS boxes FROM (
 SELECT {k}, scale_factor, size, o, floor((ay+dy*(i/CAST(steps AS DOUBLE))-min_y+oy*box)/box) AS r, floor((ax+dx*(i/CAST(steps AS DOUBLE))-min_x+ox*box)/box) AS c FROM (
  SELECT *, unnest(range(steps+1)) AS i FROM (
   SELECT *, greatest(CAST(ceil(sqrt(dx*dx+dy*dy)/(box/2)) AS BIGINT)+1,2) AS steps FROM (
    SELECT *, size/scale_factor AS box, x-ax AS dx, y-ay AS dy FROM (
     SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, min(x) OVER p AS min_x, min(y) OVER p AS min_y, greatest(max(x) OVER p-min(x) OVER p, max(y) OVER p-min(y) OVER p) AS size
     FROM (SELECT {k}, seq, (lon-35.0e0)*87300.0e0 AS x, (lat-43.5e0)*111194.9e0 AS y FROM {base})
     WINDOW w AS (PARTITION BY {k} ORDER BY seq), p AS (PARTITION BY {k})), (VALUES {SCALES}) sc(scale_factor)
    WHERE ax IS NOT NULL AND size>=1))), (VALUES {offsets}) of(o,ox,oy)) GROUP BY {k}, scale_factor"""


def series_sql(cov: str, k: str) -> str:
    return f"""SELECT {k}, scale_factor, size/scale_factor AS box_size_m, (size/scale_factor)/size AS relative_scale, boxes/4.0e0 AS mean_boxes,
 CAST(floor(boxes/4.0e0+0.5e0) AS BIGINT) AS boxes_covered, ln(1.0e0/((size/scale_factor)/size)) AS x, ln(boxes/4.0e0) AS y,
 row_number() OVER (PARTITION BY {k} ORDER BY scale_factor)-1 AS idx FROM {cov} WHERE boxes/4.0e0>1"""


def windows_sql(series: str, k: str) -> str:
    on = " AND ".join(f"s.{c.strip()}=w.{c.strip()}" for c in k.split(","))
    sk = ", ".join(f"w.{c.strip()}" for c in k.split(","))
    return f"""SELECT {k}, a, b, b-a+1 AS n, slope, intercept, r2, spread, r2>=0.98e0 AND spread<=0.18e0 AS stable FROM (
 SELECT {sk}, w.a, w.b, regr_slope(s.y,s.x) AS slope, regr_intercept(s.y,s.x) AS intercept, coalesce(regr_r2(s.y,s.x),1) AS r2,
  max(s.l) FILTER (s.idx>w.a)-min(s.l) FILTER (s.idx>w.a) AS spread
 FROM (SELECT {k}, a, b FROM (SELECT {k}, count(*) AS m FROM {series} GROUP BY {k}), range(13) p(a), range(13) q(b) WHERE b<m AND b>=a+3) w
 JOIN (SELECT *, (y-lag(y) OVER z)/(x-lag(x) OVER z) AS l FROM {series} WINDOW z AS (PARTITION BY {k} ORDER BY idx)) s ON {on} AND s.idx BETWEEN w.a AND w.b
 GROUP BY {sk}, w.a, w.b)"""


def best_sql(windows: str, k: str) -> str:
    st = "{'a':a,'b':b,'n':n,'slope':slope,'intercept':intercept,'r2':r2,'spread':spread,'stable':stable}"
    better = (
        "CASE WHEN nw.stable<>od.stable THEN nw.stable WHEN nw.n<>od.n THEN nw.n>od.n WHEN abs(nw.r2-od.r2)>1e-9 THEN nw.r2>od.r2 "
        "WHEN abs(nw.r2-od.r2)<=1e-3 AND abs(nw.slope-od.slope)>1e-6 THEN nw.slope>od.slope ELSE nw.spread<od.spread END"
    )
    return (
        f"SELECT {k}, list_reduce(list({st} ORDER BY a,b), lambda od, nw: CASE WHEN {better} THEN nw ELSE od END) AS z "
        f"FROM {windows} GROUP BY {k}"
    )


def dims_sql(base: str, series: str, best: str, k: str) -> str:
    return f"""SELECT {k}, coalesce(m,0) AS sample_count, coalesce(z.slope BETWEEN 0.5 AND 3.0,false) AS valid,
 CASE WHEN z.slope BETWEEN 0.5 AND 3.0 THEN z.slope ELSE 0 END AS dimension, CASE WHEN z.slope BETWEEN 0.5 AND 3.0 THEN z.slope ELSE 1 END AS scalar_dimension,
 coalesce(z.r2,0) AS r_squared, coalesce(z.spread,0) AS spread, coalesce(z.slope BETWEEN 0.5 AND 3.0 AND z.stable,false) AS stable
FROM (SELECT DISTINCT {k} FROM {base}) LEFT JOIN (SELECT {k}, count(*) AS m FROM {series} GROUP BY {k}) USING ({k}) LEFT JOIN {best} USING ({k})"""


define("cov1", coverage_sql("vertices", "line_id", "(0,0.0e0,0.0e0)"), "vertices")
define("cov4", coverage_sql("vertices", "line_id", OFFS), "vertices")
define("samples", series_sql("cov4", "line_id"), "cov4")
define("windows", windows_sql("samples", "line_id"), "samples")
define("bestw", best_sql("windows", "line_id"), "windows")
define("dims", dims_sql("vertices", "samples", "bestw", "line_id"), "vertices", "samples", "bestw")
define("scov4", coverage_sql("snapshots", "line_id, step", OFFS), "snapshots")
define("ssamples", series_sql("scov4", "line_id, step"), "scov4")
define("swindows", windows_sql("ssamples", "line_id, step"), "ssamples")
define("sbestw", best_sql("swindows", "line_id, step"), "swindows")
define("sdims", dims_sql("snapshots", "ssamples", "sbestw", "line_id, step"), "snapshots", "ssamples", "sbestw")


@register("f1_box_coverage", query("SELECT line_id, scale_factor, boxes FROM cov1", "cov1"))
def f1(spark, sf):
    return f.box_coverage(a.vertices(spark, sf), offsets=1).select("line_id", "scale_factor", "boxes")


@register(
    "f2_offset_average", query("SELECT line_id, scale_factor, boxes/4.0e0 AS mean_boxes FROM cov4", "cov4")
)
def f2(spark, sf):
    return f.box_coverage(a.vertices(spark, sf)).select(
        "line_id", "scale_factor", (F.col("boxes") / 4.0).alias("mean_boxes")
    )


@register(
    "f3_scale_series",
    query(
        f"""SELECT line_id, scale_factor, {s6('box_size_m',4)} AS box_size_m, {s6('relative_scale')} AS relative_scale, mean_boxes, boxes_covered,
 {s6('x')} AS log_inv_scale, {s6('y')} AS log_boxes FROM samples""",
        "samples",
    ),
)
def f3(spark, sf):
    return f.scale_series(a.vertices(spark, sf)).select(
        "line_id", "scale_factor", r6("box_size_m", digits=4), r6("relative_scale"), "mean_boxes", "boxes_covered",
        r6("log_inv_scale"), r6("log_boxes"),
    )


FIT = """(SELECT line_id, count(*) AS samples, coalesce(regr_slope(y,x),0) AS s, coalesce(regr_intercept(y,x),0) AS i, coalesce(regr_r2(y,x),1) AS r FROM samples GROUP BY 1)"""


@register(
    "f4_regression",
    query(f"SELECT line_id, samples, {s6('s')} AS slope, {s6('i')} AS intercept FROM {FIT}", "samples"),
)
def f4(spark, sf):
    s = f.scale_series(a.vertices(spark, sf))
    return f.regression(s, ["line_id"], "log_inv_scale", "log_boxes").select(
        "line_id", "samples", r6("slope"), r6("intercept")
    )


@register("f5_r_squared", query(f"SELECT line_id, samples, {s6('r')} AS r_squared FROM {FIT}", "samples"))
def f5(spark, sf):
    s = f.scale_series(a.vertices(spark, sf))
    return f.regression(s, ["line_id"], "log_inv_scale", "log_boxes").select("line_id", "samples", r6("r_squared"))


@register(
    "f6_local_slopes",
    query(
        f"""SELECT line_id, CAST(idx-1 AS INTEGER) AS position, {s6('l')} AS local_slope, {s6('max(l) OVER p-min(l) OVER p')} AS spread FROM
(SELECT *, (y-lag(y) OVER z)/(x-lag(x) OVER z) AS l FROM samples WINDOW z AS (PARTITION BY line_id ORDER BY idx)) WHERE idx>0 WINDOW p AS (PARTITION BY line_id)""",
        "samples",
    ),
)
def f6(spark, sf):
    return f.local_slopes(f.scale_series(a.vertices(spark, sf))).select(
        "line_id", "position", r6("local_slope"), r6("spread")
    )


@register(
    "f7_best_window",
    query(
        f"""SELECT line_id, CAST(z.a AS INTEGER) AS first_sample, CAST(z.b AS INTEGER) AS last_sample, {s6('z.slope')} AS slope, {s6('z.intercept')} AS intercept,
 {s6('z.r2')} AS r_squared, {s6('z.spread')} AS spread, z.stable AS stable FROM bestw""",
        "bestw",
    ),
)
def f7(spark, sf):
    return f.best_window(f.scale_series(a.vertices(spark, sf))).select(
        "line_id", "first_sample", "last_sample", r6("slope"), r6("intercept"), r6("r_squared"), r6("spread"), "stable"
    )


DIM_COLS = f"sample_count, valid, {s6('dimension')} AS dimension, {s6('scalar_dimension')} AS scalar_dimension, {s6('r_squared')} AS r_squared, {s6('spread')} AS spread, stable"


@register("f8_dimension", query(f"SELECT line_id, {DIM_COLS} FROM dims", "dims"))
def f8(spark, sf):
    return f.dimension(a.vertices(spark, sf)).select(
        "line_id", "sample_count", "valid", r6("dimension"), r6("scalar_dimension"), r6("r_squared"), r6("spread"), "stable"
    )


def _versions(spark, sf):
    return f.dimension(a.snapshots(spark, sf), ["line_id", "step"])


@register(
    "f9_version_deltas",
    query(
        f"""SELECT line_id, step, valid, {s6('dimension')} AS dimension, {s6('CASE WHEN valid AND lag(valid) OVER w THEN dimension-lag(dimension) OVER w END')} AS delta
FROM sdims WINDOW w AS (PARTITION BY line_id ORDER BY step)""",
        "sdims",
    ),
)
def f9(spark, sf):
    return f.convergence(_versions(spark, sf))[0].select("line_id", "step", "valid", r6("dimension"), r6("delta"))


F9_THEORY = 1.05


@register(
    "f9_convergence",
    query(
        f"""SELECT line_id, coalesce(ok AND j<=0.03e0,false) AS converged, coalesce(ok AND st,false) AS stable, {s6('fd')} AS final_dimension,
 coalesce(ok AND abs(fd-{F9_THEORY}e0)<=0.05e0,false) AS near_theory, coalesce(ok AND j<=0.03e0 AND st AND abs(fd-{F9_THEORY}e0)<=0.05e0,false) AS valid FROM (SELECT DISTINCT line_id FROM sdims) LEFT JOIN
(SELECT line_id, count(*)>=3 AS ok, max(abs(d)) AS j, bool_and(stable) AS st, arg_max(dimension,step) AS fd FROM
 (SELECT *, dimension-lag(dimension) OVER (PARTITION BY line_id ORDER BY step) AS d FROM (SELECT * FROM sdims WHERE valid QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY step DESC)<=3)) GROUP BY 1) USING (line_id)""",
        "sdims",
    ),
)
def f9c(spark, sf):
    return f.convergence(_versions(spark, sf), theory=F9_THEORY)[1].select(
        "line_id", "converged", "stable", r6("final_dimension"), "near_theory", "valid"
    )


def fast_sql(base: str, k: str) -> str:
    on = " AND ".join(f"b.{c.strip()}=e.{c.strip()}" for c in k.split(","))
    bk = ", ".join(f"b.{c.strip()}" for c in k.split(","))
    return f"""SELECT {bk}, b.points, e.raw AS raw_slope, coalesce(least(greatest(-e.raw,1.0e0),2.0e0),1.0e0) AS fast_dimension
FROM (SELECT {k}, count(*) AS points FROM {base} GROUP BY {k}) b LEFT JOIN
(SELECT {k}, regr_slope(ln(n), ln(scale)) AS raw FROM (SELECT {k}, scale, count(DISTINCT (ci,cj)) AS n FROM
 (SELECT {k}, scale, floor((lat-mla)/((xla-mla)/scale)) AS ci, floor((lon-mlo)/((xlo-mlo)/scale)) AS cj FROM
  (SELECT *, min(lat) OVER p AS mla, max(lat) OVER p AS xla, min(lon) OVER p AS mlo, max(lon) OVER p AS xlo, count(*) OVER p AS c FROM {base} WINDOW p AS (PARTITION BY {k})), (VALUES (2),(4),(8),(16),(32)) s(scale)
  WHERE c>=4 AND xla>mla AND xlo>mlo) GROUP BY {k}, scale) GROUP BY {k}) e ON {on}"""


define("fast", fast_sql("vertices", "line_id"), "vertices")
define("sfast", fast_sql("snapshots", "line_id, step"), "snapshots")


@register(
    "f10_fast_dimension",
    query(f"SELECT line_id, points, {s6('raw_slope')} AS raw_slope, {s6('fast_dimension')} AS fast_dimension FROM fast", "fast"),
)
def f10(spark, sf):
    return f.fast_dimension(a.vertices(spark, sf)).select("line_id", "points", r6("raw_slope"), r6("fast_dimension"))


# -- T -----------------------------------------------------------------------

define(
    "calendar",
    """SELECT scenario, step, step*years_per_step AS year, CASE WHEN step=0 THEN 0.0e0 WHEN seasonality THEN 1.0e0+0.5e0*sin(6.283185307179586e0*(step*years_per_step)+seasonal_phase%6.283185307179586e0) ELSE 1.0e0 END AS seasonal_factor,
 CASE WHEN step>0 AND sea_level_rise>0 THEN step*years_per_step*sea_level_rise ELSE 0.0e0 END AS sea_level_offset, storm_intensity FROM
(SELECT *, unnest(range(greatest(CAST(ceil(target_years/years_per_step) AS BIGINT),1)+1)) AS step FROM tparams)""",
    "tparams",
)


def _calendar(spark, sf):
    return t.step_calendar(normalise_temporal(a.scenario_params(spark, sf)))


@register(
    "t1_seasonal_factor",
    query(f"SELECT scenario, CAST(step AS INTEGER) AS step, {s6('seasonal_factor')} AS seasonal_factor FROM calendar", "calendar"),
)
def t1(spark, sf):
    return _calendar(spark, sf).select("scenario", "step", r6("seasonal_factor"))


@register(
    "t2_rate_modulation",
    query(
        f"""SELECT scenario, CAST(step AS INTEGER) AS step, step%4=0 AS is_storm, {s6('sea_level_offset')} AS sea_level_offset,
 {s6('25.0e0*(CASE WHEN step%4=0 THEN storm_intensity ELSE 1 END)*seasonal_factor*(CASE WHEN sea_level_offset>0 THEN 1.0e0+0.1e0*ln(1.0e0+sea_level_offset) ELSE 1 END)')} AS rate FROM calendar""",
        "calendar",
    ),
)
def t2(spark, sf):
    cal = _calendar(spark, sf).withColumn("is_storm", F.col("step") % 4 == 0)
    return cal.select("scenario", "step", "is_storm", r6("sea_level_offset"), r6(t.modulated_rate(F.lit(25.0)), "rate"))


define("snaps2", "SELECT * FROM snapshots WHERE NOT (step=3 AND line_id%10=0 AND seq=1)", "snapshots")


def _snaps2(spark, sf):
    s = a.snapshots(spark, sf)
    return s.where(~((F.col("step") == 3) & (F.col("line_id") % 10 == 0) & (F.col("seq") == 1)))


define(
    "moved",
    f"""SELECT c.line_id, c.step, c.seq, {hav('p.lat','p.lon','c.lat','c.lon')} AS km FROM snaps2 c JOIN snaps2 p ON p.line_id=c.line_id AND p.step=c.step-1 AND p.seq=c.seq
JOIN (SELECT line_id, step, count(*) AS n FROM snaps2 GROUP BY 1,2) a ON a.line_id=c.line_id AND a.step=c.step
JOIN (SELECT line_id, step, count(*) AS n FROM snaps2 GROUP BY 1,2) b ON b.line_id=c.line_id AND b.step=c.step-1 AND a.n=b.n""",
    "snaps2",
)


@register("t3_vertex_retreat", query(f"SELECT line_id, step, seq, {s6('km')} AS retreat_km FROM moved", "moved"))
def t3(spark, sf):
    return t.retreats(_snaps2(spark, sf)).select("line_id", "step", "seq", r6("retreat_km"))


define(
    "states",
    """SELECT DISTINCT line_id, step, step*2.5e0 AS year, step>0 AND (line_id+step)%3=0 AS storm_event,
 CASE WHEN step=0 THEN 0.0e0 ELSE 1.0e0+0.5e0*sin(6.283185307179586e0*(step*2.5e0)+0.7e0) END AS seasonal_factor FROM snapshots""",
    "snapshots",
)


def _states(spark, sf):
    step, year = F.col("step"), F.col("step") * 2.5
    return a.snapshots(spark, sf).select("line_id", "step").distinct().select(
        "line_id",
        "step",
        year.alias("year"),
        ((step > 0) & ((F.col("line_id") + step) % 3 == 0)).alias("storm_event"),
        F.when(step == 0, 0.0).otherwise(t.seasonal_factor(year, F.lit(0.7))).alias("seasonal_factor"),
    )


define(
    "snap_area",
    """SELECT line_id, step, abs(sum((plon-rlon)*(lat-rlat)-(lon-rlon)*(plat-rlat)))*111194.9e0*111194.9e0*cos(radians(any_value(rlat)))/2e6 AS area_km2 FROM
(SELECT *, coalesce(lag(lat) OVER w, last_value(lat) OVER g) AS plat, coalesce(lag(lon) OVER w, last_value(lon) OVER g) AS plon, avg(lat) OVER p AS rlat, avg(lon) OVER p AS rlon FROM snapshots
 WINDOW w AS (PARTITION BY line_id, step ORDER BY seq), p AS (PARTITION BY line_id, step), g AS (PARTITION BY line_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1,2""",
    "snapshots",
)


@register(
    "t4_step_metrics",
    query(
        f"""SELECT line_id, step, year, points, {s6('length_km')} AS length_km, {s6('area_km2',5)} AS area_km2, {s6('CASE WHEN points>10 THEN fast_dimension ELSE 0 END')} AS fractal_dimension,
 {s6('coalesce(am,0)')} AS mean_retreat, {s6('coalesce(xm,0)')} AS max_retreat, storm_event, {s6('seasonal_factor')} AS seasonal_factor
FROM snap_len JOIN snap_area USING (line_id, step) JOIN (SELECT line_id, step, fast_dimension FROM sfast) USING (line_id, step) JOIN states USING (line_id, step)
LEFT JOIN (SELECT c.line_id, c.step, avg({hav('p.lat','p.lon','c.lat','c.lon')}) AS am, max({hav('p.lat','p.lon','c.lat','c.lon')}) AS xm FROM snapshots c JOIN snapshots p ON p.line_id=c.line_id AND p.step=c.step-1 AND p.seq=c.seq GROUP BY 1,2) USING (line_id, step)""",
        "snap_len",
        "snap_area",
        "sfast",
        "states",
    ),
)
def t4(spark, sf):
    return t.snapshot_metrics(a.snapshots(spark, sf), _states(spark, sf)).select(
        "line_id", "step", "year", "points", r6("length_km"), r6("area_km2", digits=5), r6("fractal_dimension"),
        r6("mean_retreat"), r6("max_retreat"), "storm_event", r6("seasonal_factor"),
    )


@register(
    "t5_eroded_volumes",
    query(
        f"""SELECT line_id, step, {s6('coalesce((p-length_km)*1000,0)',4)} AS eroded_m3, 0.0e0 AS deposited_m3, {s6('coalesce((p-length_km)*1000,0)',4)} AS net_change_m3 FROM
(SELECT *, lag(length_km) OVER (PARTITION BY line_id ORDER BY step) AS p FROM snap_len)""",
        "snap_len",
    ),
)
def t5(spark, sf):
    sized = line_summary(a.snapshots(spark, sf), ["line_id", "step"]).select("line_id", "step", "length_km")
    return t.eroded_volumes(sized).select(
        "line_id", "step", r6("eroded_m3", digits=4), "deposited_m3", r6("net_change_m3", digits=4)
    )


@register(
    "t6_series_summary",
    query(
        f"""SELECT line_id, y AS total_years, n-1 AS total_steps, k AS storm_count, {s6('k/CAST(n-1 AS DOUBLE)')} AS storm_frequency, {s6('(a-b)*1000',4)} AS accumulated_erosion_m, {s6('y*0.003e0')} AS sea_level_rise_m,
 {s6('a')} AS initial_length_km, {s6('b')} AS final_length_km, {s6('b-a')} AS length_change_km, {s6('(b-a)/a*100')} AS length_change_percent FROM
(SELECT line_id, max(year) AS y, count(*) AS n, count(*) FILTER (storm_event) AS k, arg_min(length_km,step) AS a, arg_max(length_km,step) AS b FROM snap_len JOIN states USING (line_id, step) GROUP BY 1)""",
        "snap_len",
        "states",
    ),
)
def t6(spark, sf):
    sized = line_summary(a.snapshots(spark, sf), ["line_id", "step"]).select("line_id", "step", "length_km")
    m = sized.join(_states(spark, sf), ["line_id", "step"])
    s = t.series_summary(m, F.lit(0.003))
    return s.select(
        "line_id", "total_years", "total_steps", "storm_count", r6("storm_frequency"),
        r6("accumulated_erosion_m", digits=4), r6("sea_level_rise_m"), r6("initial_length_km"), r6("final_length_km"),
        r6("length_change_km"), r6("length_change_percent"),
    )


@register(
    "t7_step_calendar",
    query(f"SELECT scenario, CAST(step AS INTEGER) AS step, {s6('year')} AS year FROM calendar", "calendar"),
)
def t7(spark, sf):
    return _calendar(spark, sf).select("scenario", "step", r6("year"))
