"""Wave-exposure queries W1-W9 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import exposure as w
from strandline.operators.quality import normalise_wave
from strandline.operators.spatial import rock_at
from strandline.plans import adapters as a
from strandline.plans import spatial_queries as sq
from strandline.plans.registry import r6, register, s6
from strandline.plans.sql import define, query
from strandline.session import cut_lineage

P = w.WaveParams(strength_m=40.0, wind_dir_deg=210.0, wind_speed=14.0, max_fetch_m=60_000.0)
N = P.fetch_samples
MAIN = f"sin(radians({P.wind_dir_deg}e0))", f"cos(radians({P.wind_dir_deg}e0))"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

define(
    "wwork",
    f"""SELECT *, 111194.9e0*cos(radians(rlat)) AS ml FROM (SELECT line_id, seq, lat, lon, closed, avg(lat) OVER p AS rlat, avg(lon) OVER p AS rlon, count(*) OVER p AS n FROM
 (SELECT *, first_value(lat) OVER g=last_value(lat) OVER g AND first_value(lon) OVER g=last_value(lon) OVER g AS closed, max(seq) OVER (PARTITION BY line_id) AS hi FROM shores WINDOW g AS (PARTITION BY line_id ORDER BY seq {ALL}))
 WHERE NOT (closed AND seq=hi) WINDOW p AS (PARTITION BY line_id))""",
    "shores",
)
define(
    "wxy",
    "SELECT *, (lon-rlon)*ml AS x, (lat-rlat)*111194.9e0 AS y FROM wwork",
    "wwork",
)
define(
    "wframe0",
    f"""SELECT *, coalesce(lag(x) OVER o, last_value(x) OVER g) AS px, coalesce(lag(y) OVER o, last_value(y) OVER g) AS py, coalesce(lag(seq) OVER o, last_value(seq) OVER g) AS pseq,
 coalesce(lead(x) OVER o, first_value(x) OVER g) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER g) AS ny, lag(seq) OVER o IS NULL AS isfirst, lead(seq) OVER o IS NULL AS islast
FROM wxy WINDOW o AS (PARTITION BY line_id ORDER BY seq), g AS (PARTITION BY line_id ORDER BY seq {ALL})""",
    "wxy",
)
define(
    "wframe",
    """SELECT *, (nx-px)/d AS tx, (ny-py)/d AS ty FROM (SELECT *, sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py)) AS d FROM wframe0) WHERE d>0 AND n>=3 AND (closed OR NOT (isfirst OR islast))""",
    "wframe0",
)


@register(
    "w1_vertex_frames",
    query(
        f"SELECT line_id, seq, closed, {s6('px',3)} AS prev_x, {s6('py',3)} AS prev_y, {s6('nx',3)} AS next_x, {s6('ny',3)} AS next_y, {s6('tx')} AS tangent_x, {s6('ty')} AS tangent_y FROM wframe",
        "wframe",
    ),
)
def w1(spark, sf):
    return w.vertex_frames(a.shores(spark, sf)).where("framed").select(
        "line_id", "seq", "closed", r6("px", "prev_x", 3), r6("py", "prev_y", 3), r6("nx", "next_x", 3),
        r6("ny", "next_y", 3), r6("tx", "tangent_x"), r6("ty", "tangent_y"),
    )


@register(
    "w2_directional_fan",
    f"""SELECT c_custkey, CAST(ray AS INTEGER) AS ray, {s6('off')} AS offset_deg, {s6('mx*cos(radians(off))-my*sin(radians(off))')} AS dx, {s6('mx*sin(radians(off))+my*cos(radians(off))')} AS dy FROM (
SELECT *, sin(radians(dir)) AS mx, cos(radians(dir)) AS my, CASE WHEN n<=1 THEN 0.0e0 ELSE -sp+ray/CAST(n-1 AS DOUBLE)*2*sp END AS off FROM (
 SELECT *, unnest(range(n)) AS ray FROM (SELECT c_custkey, CASE WHEN c_custkey%12-2<=0 THEN 9 ELSE c_custkey%12-2 END AS n, CASE WHEN c_custkey%70-5<=0 THEN 55.0e0 ELSE c_custkey%70-5.0e0 END AS sp, c_custkey*37%360*1.0e0 AS dir FROM customer)))""",
)
def w2(spark, sf):
    c = F.col("c_custkey")
    params = a.table(spark, sf, "customer").select(
        "c_custkey",
        F.lit(40.0).alias("strength_m"),
        F.lit(0.0).alias("wind_speed"),
        (c % 70 - 5.0).alias("fetch_spread_deg"),
        (c % 12 - 2).cast("int").alias("fetch_samples"),
        *[F.lit(0.0).alias(n) for n in ("max_fetch_m", "depth_scale_m", "exposure_power", "max_retreat_m", "probe_m")],
        (c * 37 % 360 * 1.0).alias("wind_dir_deg"),
    )
    return w.fan_directions(normalise_wave(params)).select("c_custkey", "ray", r6("offset_deg"), r6("dx"), r6("dy"))


OFFSET = f"radians(-{P.fetch_spread_deg}e0+i/{N - 1}.0e0*2*{P.fetch_spread_deg}e0)"
define(
    "wfan",
    f"SELECT CAST(i AS INTEGER) AS ray, {MAIN[0]}*cos({OFFSET})-{MAIN[1]}*sin({OFFSET}) AS dx, {MAIN[0]}*sin({OFFSET})+{MAIN[1]}*cos({OFFSET}) AS dy FROM range({N}) r(i)",
)
PROBE = P.probe()
LIMIT = P.max_fetch_m - PROBE
define(
    "wrays",
    f"""SELECT *, x+dx*{PROBE}e0 AS ox, y+dy*{PROBE}e0 AS oy FROM (SELECT f.line_id, f.seq, f.pseq, f.x, f.y, f.tx, f.ty, k.ray, k.dx, k.dy FROM wframe f, wfan k
 UNION ALL SELECT line_id, seq, pseq, x, y, tx, ty, {N}, -ty, tx FROM wframe UNION ALL SELECT line_id, seq, pseq, x, y, tx, ty, {N + 1}, ty, -tx FROM wframe)""",
    "wframe",
    "wfan",
)
define(
    "wfetch",
    f"""SELECT r.line_id, r.seq, r.ray, any_value(r.dx) AS dx, any_value(r.dy) AS dy, any_value(r.tx) AS tx, any_value(r.ty) AS ty,
 {PROBE}e0+least({LIMIT}e0, coalesce(min(CASE WHEN abs(den)>=1e-9 AND tt>1e-6 AND uu BETWEEN -1e-6 AND 1+1e-6 THEN tt END), {LIMIT}e0)) AS fe
FROM (SELECT r.*, s.seq AS seg, dx*(s.ny-s.y)-dy*(s.nx-s.x) AS den, ((s.x-ox)*(s.ny-s.y)-(s.y-oy)*(s.nx-s.x))/nullif(dx*(s.ny-s.y)-dy*(s.nx-s.x),0) AS tt, ((s.x-ox)*dy-(s.y-oy)*dx)/nullif(dx*(s.ny-s.y)-dy*(s.nx-s.x),0) AS uu
 FROM wrays r LEFT JOIN (SELECT * FROM wframe0 WHERE closed OR NOT islast) s ON s.line_id=r.line_id AND s.seq<>r.seq AND s.seq<>r.pseq) r GROUP BY 1,2,3""",
    "wrays",
    "wframe0",
)


@register("w3_ray_fetch", query(f"SELECT line_id, seq, ray, {s6('fe',3)} AS fetch_m FROM wfetch", "wfetch"))
def w3(spark, sf):
    return w.ray_fetch(w.vertex_frames(a.shores(spark, sf)), P).select("line_id", "seq", "ray", r6("fetch", "fetch_m", 3))


define("wdepth", sq.depth_sql("wframe", "line_id, seq"), "wframe", "bathy", "grid")
define(
    "wsides",
    f"""SELECT *, CASE WHEN ws IS NULL THEN 0 ELSE sqrt(least(mf/{P.max_fetch_m}e0,1))*least(ws/{N}.0e0,1)*(0.35e0+0.65e0*CASE WHEN depth IS NOT NULL THEN 1-exp(-greatest(-depth,0)/{P.depth_scale_m}e0) ELSE 1-exp(-nf/{P.depth_scale_m}e0) END) END AS score FROM (
 SELECT line_id, seq, side, sum(wt) AS ws, sum(wt*fe)/sum(wt) AS mf, max(nf) AS nf FROM (
  SELECT line_id, seq, side, fe, CASE WHEN ray<{N} AND inc>0 THEN power(inc,{P.exposure_power}e0) END AS wt, CASE WHEN ray=CASE side WHEN 'left' THEN {N} ELSE {N + 1} END THEN fe END AS nf FROM (
   SELECT *, (dx*(-ty)+dy*tx)*CASE side WHEN 'left' THEN 1 ELSE -1 END AS inc FROM wfetch, (VALUES ('left'),('right')) t(side))) GROUP BY 1,2,3)
JOIN (SELECT line_id, seq, depth FROM wdepth) USING (line_id, seq)""",
    "wfetch",
    "wdepth",
)
define(
    "wscores",
    """SELECT line_id, seq, coalesce(max(score) FILTER (side='left'),0) AS ls, coalesce(max(score) FILTER (side='right'),0) AS rs, coalesce(max(mf) FILTER (side='left'),0) AS lm, coalesce(max(mf) FILTER (side='right'),0) AS rm FROM wsides GROUP BY 1,2""",
    "wsides",
)


def _scores(spark, sf):
    frames = cut_lineage(w.vertex_frames(a.shores(spark, sf)))
    return w.side_scores(frames, w.ray_fetch(frames, P), P, a.bathymetry(spark, sf))


@register(
    "w4_side_scores",
    query(
        f"SELECT line_id, seq, {s6('ls')} AS left_score, {s6('rs')} AS right_score, {s6('lm',3)} AS left_mean_fetch, {s6('rm',3)} AS right_mean_fetch FROM wscores",
        "wscores",
    ),
)
def w4(spark, sf):
    return _scores(spark, sf).select(
        "line_id", "seq", r6("left_score"), r6("right_score"), r6("left_mean_fetch", digits=3), r6("right_mean_fetch", digits=3)
    )


define(
    "wside",
    f"""SELECT *, CASE WHEN rt THEN rs ELSE ls END AS score, CASE WHEN rt THEN ty ELSE -ty END AS sx, CASE WHEN rt THEN -tx ELSE tx END AS sy FROM (
 SELECT f.*, s.ls, s.rs, s.rs>s.ls OR (abs(s.rs-s.ls)<=1e-9 AND f.ty*{MAIN[0]}-f.tx*{MAIN[1]}>-(f.ty*{MAIN[0]}-f.tx*{MAIN[1]})) AS rt FROM wframe f JOIN wscores s USING (line_id, seq)) WHERE CASE WHEN rt THEN rs ELSE ls END>0""",
    "wframe",
    "wscores",
)


@register(
    "w5_seaward_side",
    query(f"SELECT line_id, seq, CASE WHEN rt THEN 'right' ELSE 'left' END AS side, {s6('score')} AS score FROM wside", "wside"),
)
def w5(spark, sf):
    return w.seaward_side(_scores(spark, sf), P).select("line_id", "seq", "side", r6("score"))


define(
    "wshape",
    """SELECT *, least(greatest(-pull,0),1.5e0) AS pro, least(greatest(pull,0),1.2e0) AS she FROM (SELECT *, (hx*sx+hy*sy)/sc AS pull FROM (
 SELECT *, (px+nx)/2-x AS hx, (py+ny)/2-y AS hy, 0.5e0*(sqrt((x-px)*(x-px)+(y-py)*(y-py))+sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny))) AS sc FROM wside) WHERE sc>1e-6)""",
    "wside",
)


@register(
    "w6_shape_factors",
    query(f"SELECT line_id, seq, {s6('pro')} AS protrusion, {s6('she')} AS shelter FROM wshape", "wshape"),
)
def w6(spark, sf):
    return w.shape_factors(w.seaward_side(_scores(spark, sf), P)).select(
        "line_id", "seq", r6("protrusion"), r6("shelter")
    )


define(
    "wretreat",
    f"""SELECT *, least({P.strength_m}e0*least(greatest(power({P.wind_speed}e0/12,2),0.1e0),4.0e0)*score*least(greatest(0.55e0+pro-0.35e0*she,0.1e0),1.75e0),{P.strength_m}e0) AS ret FROM wshape""",
    "wshape",
)


def _retreat(spark, sf):
    return w.wave_pass(a.shores(spark, sf), P, a.bathymetry(spark, sf))


@register("w7_retreat_potential", query(f"SELECT line_id, seq, {s6('ret')} AS retreat_m FROM wretreat", "wretreat"))
def w7(spark, sf):
    return _retreat(spark, sf)[1].select("line_id", "seq", r6("retreat_m"))


define("wnear", sq.near_sql("wretreat", "litho_points"), "wretreat", "litho_points")
define("wrock", sq.rock_sql("wnear"), "wnear")
define(
    "wresist",
    f"""SELECT r.*, r.ret/(CASE WHEN {sq.KNOWN} THEN k.res ELSE 4.0e0 END) AS ret2 FROM wretreat r JOIN (SELECT line_id, seq, cls, res FROM wrock) k USING (line_id, seq)""",
    "wretreat",
    "wrock",
)


def _resisted(spark, sf):
    frames, retreats = _retreat(spark, sf)
    return frames, w.resisted(rock_at(retreats, a.litho_points(spark, sf), a.litho_classes(spark)))


@register("w8_rock_modulation", query(f"SELECT line_id, seq, {s6('ret2')} AS retreat_m FROM wresist", "wresist"))
def w8(spark, sf):
    return _resisted(spark, sf)[1].select("line_id", "seq", r6("retreat_m"))


define(
    "wmoved",
    """SELECT f.line_id, f.seq, f.isfirst AND f.closed AS st, f.rlat+(f.y+coalesce(-r.sy*r.ret2+r.hy*least(r.ret2/r.sc,0.5e0),0))/111194.9e0 AS lat, f.rlon+(f.x+coalesce(-r.sx*r.ret2+r.hx*least(r.ret2/r.sc,0.5e0),0))/f.ml AS lon, r.seq IS NOT NULL AS moved
FROM wframe0 f LEFT JOIN (SELECT * FROM wresist WHERE ret2>0) r ON r.line_id=f.line_id AND r.seq=f.seq""",
    "wframe0",
    "wresist",
)


@register(
    "w9_moved_shore",
    query(
        f"""SELECT line_id, seq, {s6('lat')} AS lat, {s6('lon')} AS lon, moved FROM wmoved
UNION ALL SELECT m.line_id, CAST(k.hi+1 AS INTEGER), {s6('m.lat')}, {s6('m.lon')}, m.moved FROM wmoved m JOIN (SELECT line_id, max(seq) AS hi FROM wmoved GROUP BY 1) k USING (line_id) WHERE st""",
        "wmoved",
    ),
)
def w9(spark, sf):
    frames, retreats = _resisted(spark, sf)
    return w.moved_shore(frames, retreats).select("line_id", "seq", r6("lat"), r6("lon"), "moved")
