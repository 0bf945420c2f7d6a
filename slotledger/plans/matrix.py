"""Baseline cost matrix: what each baseline would cost over a month of the observed usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.functions import predicates as only
from slotledger.functions.costs import MONTH_HOURS, or_zero
from slotledger.functions.rounding import round_columns
from slotledger.functions.times import since
from slotledger.operators.grids import band_label, baseline_grid, baseline_steps
from slotledger.params import MatrixParams
from slotledger.session import require_utc
from slotledger.sources.tables import in_view

MINUTE_MS = 60000
PLANS = [("PAYG (0 Commit)", "total_payg"), ("1 Year Commit", "total_1yr"), ("3 Year Commit", "total_3yr")]


def minute_usage(timeline: DataFrame, params: MatrixParams = MatrixParams()) -> DataFrame:
    """Slot milliseconds per minute that has usage rows."""
    require_utc(timeline.sparkSession)
    recent = since(in_view(timeline, params), "period_start", params.as_of, params.lookback_days, True, "period_date")
    return (
        recent.filter(only.is_query() & only.not_script())
        .groupBy(F.date_trunc("minute", "period_start").alias("usage_minute"))
        .agg(or_zero(F.sum("period_slot_ms")).alias("slot_ms"))
    )


def band_histogram(minutes: DataFrame, params: MatrixParams = MatrixParams()) -> DataFrame:
    """Minutes and slot milliseconds per grid band ``(prev, point]``, zero-filled; usage above the
    top point is in one more band. The whole result has one row per grid point."""
    band = F.ceil(F.col("slot_ms") / float(MINUTE_MS * params.step_size))
    top = baseline_steps(params.max_baseline, params.step_size)
    counted = (
        minutes.groupBy(F.least(band, F.lit(top + 1)).alias("k"))
        .agg(F.count("*").alias("minutes"), F.sum("slot_ms").alias("slot_ms"))
    )
    grid = baseline_grid(minutes.sparkSession, params.max_baseline, params.step_size, overflow=True)
    return grid.join(counted, "k", "left").na.fill(0, ["minutes", "slot_ms"])


def baseline_cost_matrix(timeline: DataFrame, params: MatrixParams = MatrixParams()) -> DataFrame:
    """One row per baseline. Usage above a baseline is the sum over the bands above it, so a
    running total over the bands replaces a pass over all minutes for every baseline."""
    bands = band_histogram(minute_usage(timeline, params), params)
    higher = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    summed = bands.withColumns({
        "above_minutes": or_zero(F.sum("minutes").over(higher)),
        "above_ms": or_zero(F.sum("slot_ms").over(higher)),
        "all_minutes": F.sum("minutes").over(everything),
        "all_ms": F.sum("slot_ms").over(everything),
    }).filter((F.col("all_minutes") > 0) & (F.col("k") <= baseline_steps(params.max_baseline, params.step_size)))

    hours = params.lookback_days * 24.0
    slots = F.col("slots")
    autoscale_raw = (F.col("above_ms") - F.col("above_minutes") * slots * MINUTE_MS) / float(MINUTE_MS) / 60.0
    idle = F.col("autoscale_raw") - (F.col("all_ms") / float(MINUTE_MS) - hours * 60.0 * slots) / 60.0
    capacity = slots * hours
    figures = (
        summed.withColumn("autoscale_raw", autoscale_raw)
        .withColumns({
            "used_raw": capacity - F.greatest(F.lit(0.0), idle),
            "autoscale_slot_hours": F.col("autoscale_raw") * (MONTH_HOURS / hours),
        })
        .withColumns({
            "utilization_pct": F.when(capacity > 0, F.col("used_raw") / capacity).otherwise(F.lit(0.0)) * 100,
            "autoscale_slot_months": F.col("autoscale_slot_hours") / MONTH_HOURS,
            "cost_autoscale_payg": F.col("autoscale_slot_hours") * params.payg_price,
            "cost_base_payg": slots * MONTH_HOURS * params.payg_price,
            "cost_base_1yr": slots * MONTH_HOURS * params.commit_1yr_price,
            "cost_base_3yr": slots * MONTH_HOURS * params.commit_3yr_price,
        })
        .select(
            band_label(slots, params.step_size).alias("bucket"),
            "minutes", "slots", "utilization_pct", "autoscale_slot_hours", "autoscale_slot_months",
            "cost_autoscale_payg", "cost_base_payg", "cost_base_1yr", "cost_base_3yr",
            (F.col("cost_base_payg") + F.col("cost_autoscale_payg")).alias("total_payg"),
            (F.col("cost_base_1yr") + F.col("cost_autoscale_payg")).alias("total_1yr"),
            (F.col("cost_base_3yr") + F.col("cost_autoscale_payg")).alias("total_3yr"),
        )
    )
    cents = [c for c in figures.columns if c.startswith(("cost_", "total_"))] + ["utilization_pct"]
    places = {**dict.fromkeys(cents, 2), "autoscale_slot_hours": 0, "autoscale_slot_months": 0}
    return round_columns(figures, places).orderBy("slots")


def best_baseline_per_plan(matrix: DataFrame) -> DataFrame:
    """The cheapest baseline of each price plan; among equal costs, the largest baseline."""
    cheapest = matrix.agg(*[
        F.min(F.struct(F.col(total).alias("cost"), (-F.col("slots")).alias("minus"), "autoscale_slot_months"))
        .alias(total)
        for _, total in PLANS
    ])
    rows = F.array(*[
        F.struct(
            F.lit(plan).alias("plan"),
            (-F.col(f"{total}.minus")).alias("slots"),
            F.col(f"{total}.autoscale_slot_months").alias("autoscale_slot_months"),
            F.col(f"{total}.cost").alias("cost"),
        )
        for plan, total in PLANS
    ])
    return cheapest.filter(F.col(PLANS[0][1]).isNotNull()).select(F.inline(rows))
