"""Step-metrics queries R1-R21 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import reports as r
from strandline.plans import adapters as a
from strandline.plans.registry import r6, register, s6
from strandline.plans.sql import define, query

STEPS = range(80)
FL = "arg_min({0},step)"
LL = "arg_max({0},step)"


def metrics(spark, sf):
    return a.step_metrics(spark, sf)


def out(df, digits=4, **_):
    """Round every double column."""
    return df.select(*[r6(c, digits=digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def grouped(cols: dict[str, str], digits: int = 4, plain: tuple[str, ...] = ()) -> str:
    items = ", ".join(f"{e if n in plain else s6(e, digits)} AS {n}" for n, e in cols.items())
    return query(f"SELECT scenario, {items} FROM step_metrics GROUP BY scenario", "step_metrics")


DL = f"({LL.format('length_km')}-{FL.format('length_km')})"
YRS = f"({LL.format('year')}-{FL.format('year')})"


@register(
    "r1_basic_statistics",
    grouped(
        {
            "total_steps": "count(*)",
            "initial_length_km": FL.format("length_km"),
            "final_length_km": LL.format("length_km"),
            "initial_area_km2": FL.format("area_km2"),
            "final_area_km2": LL.format("area_km2"),
            "max_step": "max(step)",
        },
        plain=("total_steps", "max_step"),
    ),
)
def r1(spark, sf):
    return out(r.basic_statistics(metrics(spark, sf)))


TEMPORAL = {
    "simulated_years": YRS,
    "length_change_km": DL,
    "length_change_percent": f"{DL}/{FL.format('length_km')}*100",
    "mean_annual_change_km": f"CASE WHEN {YRS}>0 THEN {DL}/{YRS} ELSE 0 END",
}


@register("r2_temporal_change", grouped(TEMPORAL))
def r2(spark, sf):
    return out(r.temporal_change(metrics(spark, sf)))


EROSION = {
    "total_eroded_m3": "sum(eroded_m3)",
    "total_deposited_m3": "sum(deposited_m3)",
    "net_change_m3": "sum(net_change_m3)",
    "mean_erosion_m3": "sum(eroded_m3)/count(*)",
    "max_erosion_step_m3": "max(eroded_m3)",
    "min_erosion_step_m3": "min(eroded_m3)",
}


@register("r3_erosion_totals", grouped(EROSION))
def r3(spark, sf):
    return out(r.erosion_totals(metrics(spark, sf)))


NS, NN = "count(*) FILTER (storm_event)", "count(*) FILTER (NOT storm_event)"
SN, NNET = (
    "coalesce(sum(net_change_m3) FILTER (storm_event),0)",
    "coalesce(sum(net_change_m3) FILTER (NOT storm_event),0)",
)


@register(
    "r4_storm_split",
    grouped(
        {
            "storm_events": NS,
            "storm_frequency": f"({NS})/CAST(count(*) AS DOUBLE)",
            "storm_erosion_m3": SN,
            "normal_erosion_m3": NNET,
            "storm_efficiency": f"CASE WHEN ({NS})>0 THEN {SN}/({NS}) ELSE 0 END",
            "normal_efficiency": f"CASE WHEN ({NN})>0 THEN {NNET}/({NN}) ELSE 0 END",
        },
        plain=("storm_events",),
    ),
)
def r4(spark, sf):
    return out(
        r.storm_split(metrics(spark, sf)).select(
            "scenario", "storm_events", "storm_frequency", "storm_erosion_m3", "normal_erosion_m3",
            "storm_efficiency", "normal_efficiency",
        )
    )


@register(
    "r5_storm_counts",
    grouped(
        {
            "total_steps": "count(*)",
            "storm_count": NS,
            "normal_count": NN,
            "storm_frequency": f"({NS})/CAST(count(*) AS DOUBLE)",
        },
        plain=("total_steps", "storm_count", "normal_count"),
    ),
)
def r5(spark, sf):
    return out(
        r.storm_split(metrics(spark, sf)).select(
            "scenario", "total_steps", F.col("storm_events").alias("storm_count"),
            F.col("normal_steps").alias("normal_count"), "storm_frequency",
        )
    )


SM, NM = "coalesce(avg(length_km) FILTER (storm_event),0)", "coalesce(avg(length_km) FILTER (NOT storm_event),0)"
PE, PS = f"(CASE WHEN ({NS})>0 THEN {SN}/({NS}) ELSE 0 END)", f"(CASE WHEN ({NN})>0 THEN {NNET}/({NN}) ELSE 0 END)"


@register(
    "r6_storm_comparison",
    grouped(
        {
            "storm_mean_length": SM,
            "normal_mean_length": NM,
            "length_difference": f"{SM}-{NM}",
            "storm_total": SN,
            "normal_total": NNET,
            "storm_per_event": PE,
            "normal_per_step": PS,
            "efficiency_ratio": f"CASE WHEN ({NS})>0 AND ({NN})>0 AND {NNET}>0 THEN {PE}/{PS} ELSE 0 END",
        }
    ),
)
def r6q(spark, sf):
    return out(r.storm_comparison(metrics(spark, sf)).drop("n_storm", "n_normal"))


define(
    "storm_steps",
    """SELECT *, lag(year) OVER w AS pyear, lag(length_km) OVER w AS plen FROM step_metrics WHERE storm_event
WINDOW w AS (PARTITION BY scenario ORDER BY step)""",
    "step_metrics",
)


@register(
    "r7_storm_timing",
    query(
        f"""SELECT scenario, {s6('coalesce(i,0)',4)} AS storm_interval_mean, {s6('coalesce(d,0)',4)} AS storm_interval_std,
 {s6('a',4)} AS storm_seasonal_mean, {s6('b',4)} AS normal_seasonal_mean FROM
(SELECT scenario, coalesce(avg(seasonal_factor) FILTER (storm_event),0) AS a, coalesce(avg(seasonal_factor) FILTER (NOT storm_event),0) AS b FROM step_metrics GROUP BY 1)
LEFT JOIN (SELECT scenario, avg(year-pyear) AS i, stddev_pop(year-pyear) AS d FROM storm_steps GROUP BY 1) USING (scenario)""",
        "storm_steps",
    ),
)
def r7(spark, sf):
    return out(r.storm_timing(metrics(spark, sf)))


@register(
    "r7_storm_years",
    query("SELECT scenario, year FROM step_metrics WHERE storm_event", "step_metrics"),
)
def r7y(spark, sf):
    return r.storm_rows(metrics(spark, sf)).select("scenario", "year")


@register(
    "r8_storm_impact",
    query(
        f"""SELECT scenario, {s6('mx',4)} AS max_single_storm, {s6('mn',4)} AS min_single_storm, {s6('av',4)} AS mean_single_storm, {s6('lm',4)} AS length_change_mean,
 {s6('ls',4)} AS length_change_std, {s6('CASE WHEN t<>0 THEN s/t*100 ELSE 0 END',4)} AS storm_contribution_pct FROM
(SELECT scenario, sum(net_change_m3) AS t, {SN} AS s FROM step_metrics GROUP BY 1) LEFT JOIN
(SELECT scenario, max(net_change_m3) AS mx, min(net_change_m3) AS mn, avg(net_change_m3) AS av, avg(length_km-plen) AS lm, stddev_samp(length_km-plen) AS ls FROM storm_steps GROUP BY 1) USING (scenario)""",
        "storm_steps",
    ),
)
def r8(spark, sf):
    return out(r.storm_impact(metrics(spark, sf)))


@register(
    "r9_overview",
    grouped(
        {
            "total_steps": "count(*)",
            "initial_length": FL.format("length_km"),
            "final_length": LL.format("length_km"),
            "length_change": DL,
        },
        plain=("total_steps",),
    ),
)
def r9(spark, sf):
    return out(r.overview(metrics(spark, sf)))


@register(
    "r10_final_metrics",
    grouped(
        {
            "length_km": LL.format("length_km"),
            "area_km2": LL.format("area_km2"),
            "total_erosion_m3": "sum(eroded_m3)",
            "storm_count": NS,
        },
        plain=("storm_count",),
    ),
)
def r10(spark, sf):
    return out(r.final_metrics(metrics(spark, sf)))


@register(
    "r11_scenario_erosion",
    grouped(
        {
            "total_eroded": "sum(eroded_m3)",
            "net_change": "sum(net_change_m3)",
            "mean_erosion": "avg(eroded_m3)",
            "max_single_step": "max(eroded_m3)",
        }
    ),
)
def r11(spark, sf):
    return out(
        r.erosion_totals(metrics(spark, sf)).select(
            "scenario", F.col("total_eroded_m3").alias("total_eroded"), F.col("net_change_m3").alias("net_change"),
            F.col("mean_erosion_m3").alias("mean_erosion"), F.col("max_erosion_step_m3").alias("max_single_step"),
        )
    )


@register(
    "r12_scenario_temporal",
    grouped(
        {
            "total_years": TEMPORAL["simulated_years"],
            "length_change_pct": TEMPORAL["length_change_percent"],
            "mean_annual_change_km": TEMPORAL["mean_annual_change_km"],
        }
    ),
)
def r12(spark, sf):
    return out(
        r.temporal_change(metrics(spark, sf)).select(
            "scenario", F.col("simulated_years").alias("total_years"),
            F.col("length_change_percent").alias("length_change_pct"), "mean_annual_change_km",
        )
    )


def _matrix(value: str) -> str:
    cols = ", ".join(f"{s6(f'max(v) FILTER (step={i})',4)} AS step_{i}" for i in STEPS)
    return query(
        f"SELECT scenario, {cols} FROM (SELECT scenario, step, {value} AS v FROM (SELECT *, first_value(length_km) "
        "OVER (PARTITION BY scenario ORDER BY step) AS f FROM step_metrics)) GROUP BY scenario",
        "step_metrics",
    )


@register("r13_relative_length", _matrix("CASE WHEN f>0 THEN length_km/f*100 ELSE length_km END"))
def r13(spark, sf):
    return out(r.step_matrix(metrics(spark, sf), True))


@register("r13_absolute_length", _matrix("length_km"))
def r13a(spark, sf):
    return out(r.step_matrix(metrics(spark, sf), False))


@register(
    "r13_step_maps",
    query(
        f"""SELECT scenario, step, {s6('CASE WHEN f>0 THEN length_km/f*100 ELSE length_km END',4)} AS relative_length FROM step_metrics JOIN
(SELECT scenario, {FL.format('length_km')} AS f FROM step_metrics GROUP BY 1) USING (scenario)""",
        "step_metrics",
    ),
)
def r13m(spark, sf):
    """The relative lengths as one map per scenario, unfolded."""
    maps = r.step_maps(metrics(spark, sf), True)
    return out(maps.select("scenario", F.explode("steps").alias("step", "relative_length")))


@register(
    "r14_cumulative_net",
    query(
        f"""SELECT scenario, step, {s6('sum(net_change_m3) OVER (PARTITION BY scenario ORDER BY step ROWS UNBOUNDED PRECEDING)',4)} AS cumulative_net_m3 FROM step_metrics""",
        "step_metrics",
    ),
)
def r14(spark, sf):
    return out(r.cumulative_net(metrics(spark, sf)).select("scenario", "step", "cumulative_net_m3"))


@register(
    "r15_step_rates",
    query(
        f"""SELECT scenario, step, {s6('p-length_km',4)} AS erosion_rate_km FROM (SELECT *, lag(length_km) OVER (PARTITION BY scenario ORDER BY step) AS p FROM step_metrics) WHERE p IS NOT NULL""",
        "step_metrics",
    ),
)
def r15(spark, sf):
    return out(r.step_rates(metrics(spark, sf)).select("scenario", "step", "erosion_rate_km"))


@register(
    "r16_linear_trend",
    query(
        f"""SELECT scenario, step, {s6('s',4)} AS slope, {s6('i',4)} AS intercept, {s6('i+s*year',4)} AS fitted_km FROM step_metrics JOIN
(SELECT scenario, regr_slope(length_km,year) AS s, regr_intercept(length_km,year) AS i FROM step_metrics GROUP BY 1 HAVING count(*)>2) USING (scenario)""",
        "step_metrics",
    ),
)
def r16(spark, sf):
    return out(r.linear_trend(metrics(spark, sf)).select("scenario", "step", "slope", "intercept", "fitted_km"))


define(
    "trend",
    """SELECT scenario, s, CASE WHEN s<-0.1e0 THEN 'shrinking' WHEN s>0.1e0 THEN 'growing' ELSE 'stable' END AS trend FROM
(SELECT scenario, regr_slope(length_km, k) AS s FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY step)-1 AS k FROM step_metrics) GROUP BY 1 HAVING count(*)>2)""",
    "step_metrics",
)


@register("r17_trend_class", query(f"SELECT scenario, {s6('s',4)} AS slope, trend FROM trend", "trend"))
def r17(spark, sf):
    return out(r.trend_class(metrics(spark, sf)))


def _esc(text: str) -> str:
    return text.replace("'", "''")


@register(
    "r18_findings",
    query(
        f"""SELECT scenario, concat_ws(' | ', CASE WHEN c<0 THEN printf('{r.MSG_SHRUNK}', abs(c), abs(c/f*100)) ELSE printf('{r.MSG_GREW}', c, c/f*100) END,
 CASE WHEN e>0 THEN printf('{r.MSG_ERODED}', e) ELSE '{r.MSG_ACCUMULATED}' END,
 CASE WHEN k>0 THEN printf('{r.MSG_STORMS}', k, round(k/CAST(n AS DOUBLE),3)) END,
 CASE WHEN k>0 AND abs(sn)>abs(nn) THEN '{r.MSG_DOMINANT}' END,
 CASE WHEN trend='shrinking' THEN printf('{r.MSG_TREND_DOWN}', s) WHEN trend='growing' THEN printf('{r.MSG_TREND_UP}', s) WHEN trend='stable' THEN '{r.MSG_TREND_FLAT}' END) AS findings
FROM (SELECT scenario, {DL} AS c, {FL.format('length_km')} AS f, sum(eroded_m3) AS e, {NS} AS k, count(*) AS n, {SN} AS sn, {NNET} AS nn FROM step_metrics GROUP BY 1) LEFT JOIN trend USING (scenario)""",
        "step_metrics",
        "trend",
    ),
)
def r18(spark, sf):
    return r.findings(metrics(spark, sf)).select("scenario", F.array_join("findings", " | ").alias("findings"))


@register(
    "r19_storm_histogram",
    query(
        """SELECT b.scenario, b.bucket, coalesce(h.storms,0) AS storms FROM
(SELECT scenario, unnest(range(greatest(n-1,coalesce(t,0))+1)) AS bucket FROM (SELECT scenario, count(*) AS n, CAST(max(floor(year)) FILTER (storm_event) AS BIGINT) AS t FROM step_metrics GROUP BY 1)) b
LEFT JOIN (SELECT scenario, CAST(floor(year) AS BIGINT) AS bucket, count(*) AS storms FROM step_metrics WHERE storm_event GROUP BY 1,2) h ON h.scenario=b.scenario AND h.bucket=b.bucket""",
        "step_metrics",
    ),
)
def r19(spark, sf):
    return r.storm_histogram(metrics(spark, sf))


@register(
    "r20_storm_share",
    grouped(
        {
            "normal_share_pct": f"({NN})/CAST(count(*) AS DOUBLE)*100",
            "storm_share_pct": f"({NS})/CAST(count(*) AS DOUBLE)*100",
        }
    ),
)
def r20(spark, sf):
    return out(r.storm_split(metrics(spark, sf)).select("scenario", "normal_share_pct", "storm_share_pct"))


@register(
    "r21_step_details",
    query(
        f"""SELECT scenario, step, {s6('year')} AS year, {s6('length_km',4)} AS length_km, {s6('area_km2',4)} AS area_km2, {s6('eroded_m3',4)} AS eroded_m3,
 {s6('deposited_m3',4)} AS deposited_m3, {s6('net_change_m3',4)} AS net_change_m3, storm_event FROM step_metrics""",
        "step_metrics",
    ),
)
def r21(spark, sf):
    return out(r.step_details(metrics(spark, sf)))
