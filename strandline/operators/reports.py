"""Analytics over step metrics, one scenario per key.

Per-scenario figures are combining aggregates; order-aware figures use the
chunked helpers, so a scenario with very many steps is never sorted whole.

Only ``step`` and ``length_km`` are needed. Other columns may be absent, or null
all through a scenario whose file lacks them: figures of what is not there are null,
counts of storms are 0, and a scenario without years, without volumes or without storm
marks has no row in the tables of temporal change, erosion totals or storms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.lines import attach, previous_row, running
from strandline.schemas import STEP_METRICS

KEY = ["scenario"]
# Message formats and trend limits.
TREND_LIMIT = 0.1
MSG_SHRUNK = "Береговая линия сократилась на %.2f км (%.1f%%) за период моделирования"
MSG_GREW = "Береговая линия увеличилась на %.2f км (%.1f%%) за период моделирования"
MSG_ERODED = "Накопленная эрозия составила %.1f м$^3$ материала"
MSG_ACCUMULATED = "Наблюдается чистая аккумуляция материала"
MSG_STORMS = "Зафиксировано %d штормовых событий (частота: %.3f)"
MSG_DOMINANT = "Штормовые события вносят основной вклад в общую эрозию"
MSG_TREND_DOWN = "Обнаружена устойчивая тенденция к сокращению береговой линии (тренд: %.3f км/шаг)"
MSG_TREND_UP = "Обнаружена устойчивая тенденция к росту береговой линии (тренд: %.3f км/шаг)"
MSG_TREND_FLAT = "Динамика береговой линии относительно стабильна"

#: Buckets of a histogram that one row unfolds to.
STRETCH = 4096

_first = lambda c: F.min_by(c, "step")
_last = lambda c: F.max_by(c, "step")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _sum_if(cond: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))


def completed(m: DataFrame) -> DataFrame:
    """``m`` with its absent optional columns as nulls."""
    absent = [f for f in STEP_METRICS if f.name not in m.columns]
    return m.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else m


def basic_statistics(m: DataFrame) -> DataFrame:
    """R1."""
    return completed(m).groupBy(*KEY).agg(
        F.count("*").alias("total_steps"),
        _first("length_km").alias("initial_length_km"),
        _last("length_km").alias("final_length_km"),
        _first("area_km2").alias("initial_area_km2"),
        _last("area_km2").alias("final_area_km2"),
        F.max("step").alias("max_step"),
    )


def temporal_change(m: DataFrame) -> DataFrame:
    """None for scenarios without years."""
    years = _last("year") - _first("year")
    change = _last("length_km") - _first("length_km")
    return completed(m).groupBy(*KEY).agg(
        years.alias("simulated_years"),
        change.alias("length_change_km"),
        (change / _first("length_km") * 100).alias("length_change_percent"),
        _ratio(change, years).alias("mean_annual_change_km"),
    ).where(F.col("simulated_years").isNotNull())


def erosion_totals(m: DataFrame) -> DataFrame:
    """None for scenarios without eroded volumes or net change."""
    return completed(m).groupBy(*KEY).agg(
        F.sum("eroded_m3").alias("total_eroded_m3"),
        F.coalesce(F.sum("deposited_m3"), F.lit(0.0)).alias("total_deposited_m3"),
        F.sum("net_change_m3").alias("net_change_m3"),
        F.avg("eroded_m3").alias("mean_erosion_m3"),
        F.max("eroded_m3").alias("max_erosion_step_m3"),
        F.min("eroded_m3").alias("min_erosion_step_m3"),
    ).where("total_eroded_m3 IS NOT NULL AND net_change_m3 IS NOT NULL")


def storm_split(m: DataFrame) -> DataFrame:
    """None for scenarios without storm marks; erosion is null without net change."""
    storm = F.col("storm_event")
    known = F.count("net_change_m3") > 0
    agg = completed(m).groupBy(*KEY).agg(
        F.count("*").alias("total_steps"),
        F.count_if(storm).alias("storm_events"),
        F.count_if(~storm).alias("normal_steps"),
        F.when(known, _sum_if(storm, "net_change_m3")).alias("storm_erosion_m3"),
        F.when(known, _sum_if(~storm, "net_change_m3")).alias("normal_erosion_m3"),
    )
    return agg.where("storm_events + normal_steps > 0").withColumns(
        {
            "storm_frequency": F.col("storm_events") / F.col("total_steps"),
            "storm_efficiency": _ratio(F.col("storm_erosion_m3"), F.col("storm_events")),
            "normal_efficiency": _ratio(F.col("normal_erosion_m3"), F.col("normal_steps")),
            "storm_share_pct": F.col("storm_events") / F.col("total_steps") * 100,
            "normal_share_pct": F.col("normal_steps") / F.col("total_steps") * 100,
        }
    )


def storm_comparison(m: DataFrame) -> DataFrame:
    """R6."""
    storm = F.col("storm_event")
    zero = F.lit(0.0)
    agg = completed(m).groupBy(*KEY).agg(
        F.count_if(storm).alias("n_storm"),
        F.count_if(~storm).alias("n_normal"),
        F.coalesce(F.avg(F.when(storm, F.col("length_km"))), zero).alias("storm_mean_length"),
        F.coalesce(F.avg(F.when(~storm, F.col("length_km"))), zero).alias("normal_mean_length"),
        _sum_if(storm, "net_change_m3").alias("storm_total"),
        _sum_if(~storm, "net_change_m3").alias("normal_total"),
    )
    per_storm, per_step = _ratio(F.col("storm_total"), F.col("n_storm")), _ratio(F.col("normal_total"), F.col("n_normal"))
    usable = (F.col("n_storm") > 0) & (F.col("n_normal") > 0) & (F.col("normal_total") > 0)
    return agg.withColumns(
        {
            "length_difference": F.col("storm_mean_length") - F.col("normal_mean_length"),
            "storm_per_event": per_storm,
            "normal_per_step": per_step,
            "efficiency_ratio": F.when(usable, F.try_divide(per_storm, per_step)).otherwise(zero),
        }
    )


def storm_rows(m: DataFrame) -> DataFrame:
    """Storm rows with the storm row before them (for R7 and R8)."""
    return previous_row(completed(m).where("storm_event"), ["year", "length_km"], KEY, "step")


def storm_timing(m: DataFrame) -> DataFrame:
    """Spacing of storms in years (population deviation) and seasonal means."""
    m = completed(m)
    gap = F.col("year") - F.col("prev.year")
    spacing = storm_rows(m).groupBy(*KEY).agg(
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("storm_interval_mean"),
        F.coalesce(F.stddev_pop(gap), F.lit(0.0)).alias("storm_interval_std"),
    )
    storm = F.col("storm_event")
    out = m.select(*KEY).distinct().join(spacing, KEY, "left")
    if "seasonal_factor" in m.columns:
        season = m.groupBy(*KEY).agg(
            F.coalesce(F.avg(F.when(storm, F.col("seasonal_factor"))), F.lit(0.0)).alias("storm_seasonal_mean"),
            F.coalesce(F.avg(F.when(~storm, F.col("seasonal_factor"))), F.lit(0.0)).alias("normal_seasonal_mean"),
        )
        out = out.join(season, KEY)
    return out


def storm_impact(m: DataFrame) -> DataFrame:
    """Single-storm impact and length change between consecutive storm rows."""
    change = F.col("length_km") - F.col("prev.length_km")
    m = completed(m)
    storms = storm_rows(m).groupBy(*KEY).agg(
        F.max("net_change_m3").alias("max_single_storm"),
        F.min("net_change_m3").alias("min_single_storm"),
        F.avg("net_change_m3").alias("mean_single_storm"),
        F.avg(change).alias("length_change_mean"),
        F.stddev_samp(change).alias("length_change_std"),
    )
    total = m.groupBy(*KEY).agg(
        F.sum("net_change_m3").alias("total"), _sum_if(F.col("storm_event"), "net_change_m3").alias("storm")
    )
    return total.join(storms, KEY, "left").withColumn(
        "storm_contribution_pct",
        F.when(F.col("total") != 0, F.col("storm") / F.col("total") * 100).otherwise(F.lit(0.0)),
    ).drop("total", "storm")


def overview(m: DataFrame) -> DataFrame:
    """R9."""
    return m.groupBy(*KEY).agg(
        F.count("*").alias("total_steps"),
        _first("length_km").alias("initial_length"),
        _last("length_km").alias("final_length"),
        (_last("length_km") - _first("length_km")).alias("length_change"),
    )


def final_metrics(m: DataFrame) -> DataFrame:
    """R10."""
    return completed(m).groupBy(*KEY).agg(
        _last("length_km").alias("length_km"),
        _last("area_km2").alias("area_km2"),
        F.sum("eroded_m3").alias("total_erosion_m3"),
        F.count_if("storm_event").alias("storm_count"),
    )


def step_matrix(m: DataFrame, relative: bool, steps: list[int] | None = None) -> DataFrame:
    """Scenarios as rows, steps as columns; missing steps are null."""
    first = m.groupBy(*KEY).agg(
        _first("length_km").alias("_f"), F.min("step").alias("lo_seq"), F.max("step").alias("hi_seq")
    )
    value = F.when(F.col("_f") > 0, F.col("length_km") / F.col("_f") * 100).otherwise(F.col("length_km"))
    cells = attach(m, first, KEY, "step").select(
        *KEY, "step", (value if relative else F.col("length_km")).alias("v")
    )
    wide = cells.groupBy(*KEY).pivot("step", steps).agg(F.first("v"))
    return wide.select(*KEY, *[F.col(f"`{c}`").alias(f"step_{c}") for c in wide.columns if c not in KEY])


def step_maps(m: DataFrame, relative: bool) -> DataFrame:
    """R13 for any number of steps: a row per scenario, with a map from step to length; the input is read once."""
    first = m.groupBy(*KEY).agg(
        _first("length_km").alias("_f"), F.min("step").alias("lo_seq"), F.max("step").alias("hi_seq")
    )
    value = F.when(F.col("_f") > 0, F.col("length_km") / F.col("_f") * 100).otherwise(F.col("length_km"))
    cells = attach(m, first, KEY, "step").select(*KEY, F.struct("step", (value if relative else F.col("length_km")).alias("v")).alias("c"))
    return cells.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list("c"))).alias("steps"))


def cumulative_net(m: DataFrame) -> DataFrame:
    """R14."""
    return running(m, {"cumulative_net_m3": F.col("net_change_m3")}, KEY, "step")


def step_rates(m: DataFrame) -> DataFrame:
    """Length lost per step; the first step has no rate."""
    return previous_row(m, ["length_km"], KEY, "step").where("prev is not null").withColumn(
        "erosion_rate_km", F.col("prev.length_km") - F.col("length_km")
    ).drop("prev")


def linear_trend(m: DataFrame) -> DataFrame:
    """Fitted line over years (or steps), for more than two rows."""
    m = m.withColumn("_x", F.coalesce("year", "step") if "year" in m.columns else F.col("step"))
    x = "_x"
    fit = m.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min("step").alias("lo_seq"),
        F.max("step").alias("hi_seq"),
        F.regr_slope("length_km", x).alias("slope"),
        F.regr_intercept("length_km", x).alias("intercept"),
    ).where((F.col("n") > 2) & F.col("slope").isNotNull())
    return attach(m, fit, KEY, "step").withColumn("fitted_km", F.col("intercept") + F.col("slope") * F.col(x)).drop(
        "n", "lo_seq", "hi_seq", "_x"
    )


def trend_class(m: DataFrame) -> DataFrame:
    """Slope over the row number and its class."""
    ranked = running(m, {"_row": F.lit(1)}, KEY, "step")
    fit = ranked.groupBy(*KEY).agg(F.count("*").alias("n"), F.regr_slope("length_km", F.col("_row") - 1).alias("slope"))
    return fit.where(F.col("n") > 2).select(
        *KEY,
        "slope",
        F.when(F.col("slope") < -TREND_LIMIT, "shrinking").when(F.col("slope") > TREND_LIMIT, "growing").otherwise("stable").alias("trend"),
    )


def findings(m: DataFrame) -> DataFrame:
    """List of findings per scenario; none about erosion where its volumes are not known."""
    m = completed(m)
    storm = F.col("storm_event")
    facts = m.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        _first("length_km").alias("first_km"),
        (_last("length_km") - _first("length_km")).alias("change"),
        F.sum("eroded_m3").alias("eroded"),
        F.count_if(storm).alias("storms"),
        _sum_if(storm, "net_change_m3").alias("storm_net"),
        _sum_if(~storm, "net_change_m3").alias("normal_net"),
    )
    facts = facts.join(trend_class(m), KEY, "left")
    change, pct = F.col("change"), F.when(F.col("first_km") > 0, F.col("change") / F.col("first_km") * 100).otherwise(0.0)
    lines = F.array_compact(
        F.array(
            F.when(change < 0, F.format_string(MSG_SHRUNK, F.abs(change), F.abs(pct))).otherwise(
                F.format_string(MSG_GREW, change, pct)
            ),
            F.when(F.col("eroded") > 0, F.format_string(MSG_ERODED, F.col("eroded"))).when(
                F.col("eroded").isNotNull(), F.lit(MSG_ACCUMULATED)
            ),
            F.when(F.col("storms") > 0, F.format_string(MSG_STORMS, F.col("storms"), F.round(F.col("storms") / F.col("n"), 3))),
            F.when(
                (F.col("storms") > 0) & (F.abs(F.col("storm_net")) > F.abs(F.col("normal_net"))), F.lit(MSG_DOMINANT)
            ),
            F.when(F.col("trend") == "shrinking", F.format_string(MSG_TREND_DOWN, F.col("slope")))
            .when(F.col("trend") == "growing", F.format_string(MSG_TREND_UP, F.col("slope")))
            .when(F.col("trend").isNotNull(), F.lit(MSG_TREND_FLAT)),
        )
    )
    return facts.select(*KEY, lines.alias("findings"))


def storm_histogram(m: DataFrame) -> DataFrame:
    """Storms per whole year, with empty buckets."""
    m = completed(m)
    x = F.coalesce(F.floor("year"), F.col("step").cast("bigint"))
    hits = m.where("storm_event").groupBy(*KEY, x.alias("bucket")).agg(F.count("*").alias("storms"))
    span = m.groupBy(*KEY).agg((F.count("*") - 1).alias("rows"), F.max(F.when(F.col("storm_event"), x)).alias("top"))
    span = span.select(*KEY, F.greatest("rows", F.coalesce("top", F.lit(0)).cast("bigint")).alias("most"))
    # stretches first, so that no row holds all buckets of a scenario
    stretch = F.sequence(F.lit(0).cast("bigint"), F.expr(f"most div {STRETCH}"))
    stretches = span.withColumn("_n", F.explode(stretch)).withColumn("_s", F.col("_n") * STRETCH)
    buckets = stretches.select(*KEY, F.explode(F.sequence("_s", F.least(F.col("_s") + (STRETCH - 1), F.col("most")))).alias("bucket"))
    return buckets.join(hits, [*KEY, "bucket"], "left").select(*KEY, "bucket", F.coalesce("storms", F.lit(0)).alias("storms"))


def step_details(m: DataFrame) -> DataFrame:
    """The rows of the report tables."""
    return completed(m).select(
        *KEY, "step", "year", "length_km", "area_km2", "eroded_m3", "deposited_m3", "net_change_m3", "storm_event"
    )
