"""Jobs: on-demand against slot pricing for the largest jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions import costs
from slotledger.functions import predicates as only
from slotledger.functions.times import since, whole_milliseconds
from slotledger.operators.topk import most, top_rows
from slotledger.params import JobCostParams
from slotledger.sources.tables import in_view, shape_jobs

JOB_COLUMNS = [
    "job_id", "project_id", "user_email", "on_demand_cost", "editions_cost", "waste_savings",
    "has_error", "category", "avg_slots", "effective_slots", "billed_slots",
]


def largest_jobs(jobs: DataFrame, params: JobCostParams = JobCostParams()) -> DataFrame:
    """The jobs that are costed: finished, uncached queries; with ``limit_jobs`` the largest by bytes billed.

    That cut is an option. It comes before costing and totals, which then cover the largest jobs only.
    """
    recent = since(in_view(shape_jobs(jobs), params), "creation_time", params.as_of, params.lookback_days, partition="creation_date")
    eligible = (
        recent.filter(
            only.is_done() & only.is_query() & only.not_script() & only.not_cached()
            & only.billed_at_least(params.min_bytes_billed)
        )
        .select(
            "job_id", "project_id", "user_email", "total_bytes_billed", "total_slot_ms", "has_error",
            whole_milliseconds(F.col("start_time"), F.col("end_time")).alias("run_ms"),
        )
    )
    if params.limit_jobs is None:
        return eligible
    return most(eligible, "total_bytes_billed", ["job_id", "project_id"], params.limit_jobs)


def _costed(jobs: DataFrame, params: JobCostParams) -> DataFrame:
    steps = [
        {
            "actual_ms": costs.or_zero(F.col("run_ms")),
            "billed_ms": F.greatest(F.col("run_ms"), F.lit(costs.MIN_BILLED_MS)),
        },
        {"avg_slots": costs.average_slots(F.col("total_slot_ms"), F.col("actual_ms"))},
        {"effective_slots": F.col("avg_slots") * costs.spike_factor(F.col("actual_ms"))},
        {"billed_slots": costs.billed_slots(F.col("effective_slots"), params.slot_step_size)},
        {
            "on_demand_cost": costs.terabytes(F.col("total_bytes_billed")) * params.on_demand_rate_per_tb,
            "editions_cost": F.col("billed_slots") * F.col("billed_ms") / costs.SLOT_HOUR_MS
            * params.edition_slot_hr_rate,
        },
        {
            "waste_savings": F.col("on_demand_cost") - F.col("editions_cost"),
            "category": costs.cost_category(F.col("on_demand_cost"), F.col("editions_cost")),
        },
    ]
    costed = largest_jobs(jobs, params)
    for step in steps:
        costed = costed.withColumns(step)
    return costed


def job_costs(jobs: DataFrame, params: JobCostParams = JobCostParams()) -> DataFrame:
    return _costed(jobs, params).select(*JOB_COLUMNS)


def project_cost_summary(jobs: DataFrame, params: JobCostParams = JobCostParams()) -> DataFrame:
    """Totals per project over the costed jobs, largest saving first."""
    return (
        _costed(jobs, params)
        .groupBy("project_id")
        .agg(
            F.sum("on_demand_cost").alias("total_on_demand_cost"),
            F.sum("editions_cost").alias("total_editions_cost"),
            F.sum(F.when(F.col("has_error"), F.col("editions_cost")).otherwise(F.lit(0.0))).alias("editions_error_tax"),
            F.sum("waste_savings").alias("reservation_savings"),
        )
        .orderBy(F.desc("reservation_savings"), "project_id")
    )


def top_jobs(jobs: DataFrame, params: JobCostParams = JobCostParams()) -> DataFrame:
    """The costed jobs of a category, those that would save most first, with the cheaper plan."""
    on_demand, editions = F.col("on_demand_cost"), F.col("editions_cost")
    order = [F.desc("waste_savings"), F.desc("total_bytes_billed"), "job_id", "project_id"]
    costed = _costed(jobs, params)
    if params.category_filter:
        costed = costed.filter(F.col("category").contains(params.category_filter))
    ranked = costed.orderBy(*order) if params.limit_top_jobs is None else top_rows(costed, order, params.limit_top_jobs)
    return (
        ranked.select(
            *JOB_COLUMNS,
            F.lit("On-Demand").alias("current_plan"),
            costs.cheaper_plan(on_demand, editions).alias("better_plan"),
            costs.saving_percent(F.col("waste_savings"), on_demand, editions).alias("savings_pct"),
        )
    )
