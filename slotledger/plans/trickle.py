"""Hours in which a reservation carries a steady trickle of small queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.functions import costs
from slotledger.functions import predicates as only
from slotledger.functions.rounding import round_columns
from slotledger.functions.times import hour_and_weekday, since, whole_milliseconds, whole_seconds
from slotledger.operators import quantiles
from slotledger.operators.grids import week_grid
from slotledger.operators.topk import first_of_each, listed, top_rows
from slotledger.params import TrickleParams
from slotledger.session import require_utc
from slotledger.sources.tables import VIEW, in_view, shape_jobs

PROFILE_KEYS = ["hour_bucket", "reservation_id", "project_id"]


def reserved_queries(jobs: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """Reserved queries of the look-back with their hour and run time."""
    require_utc(jobs.sparkSession)
    start, end = F.col("start_time"), F.col("end_time")
    recent = since(in_view(shape_jobs(jobs), params), "creation_time", params.as_of, params.lookback_days, partition="creation_date")
    return recent.filter(only.is_query() & only.not_script() & only.on_reservation()).withColumns({
        "hour_bucket": F.date_trunc("hour", "creation_time"),
        "run_ms": whole_milliseconds(start, end),
        "run_seconds": whole_seconds(start, end),
    })


def _mean_slots() -> Column:
    return F.col("total_slot_ms") / F.nullif(F.col("run_ms"), F.lit(0))


def counted_queries(queries: DataFrame) -> DataFrame:
    """Queries by hour, reservation, project, hash and whole second of run time, with their figures.

    Profile and query hashes both follow from this, so the jobs are read and shuffled once. The
    figures are an array of one struct: pruned apart, the two uses would be two scans again.
    """
    slots = _mean_slots()
    figures = F.struct(
        F.count("*").alias("n"),
        F.sum(slots).alias("slots"), F.count(slots).alias("slots_n"),
        F.min(F.struct("job_id", "project_id", F.to_date("creation_time").alias("day"))).alias("example"),
        F.sum("total_slot_ms").alias("slot_ms"), F.count("total_slot_ms").alias("slot_n"),
        F.sum("total_bytes_processed").alias("bytes"), F.count("total_bytes_processed").alias("bytes_n"),
    )
    return queries.groupBy(*PROFILE_KEYS, "query_hash", "run_seconds").agg(F.array(figures).alias(quantiles.FIGURES))


def profile_of(counted: DataFrame) -> DataFrame:
    """Count, mean slots and median run time by hour, reservation and project.

    The median is over whole seconds, of which a group has few, whatever the number of its queries.
    """
    figure = quantiles.figure
    seconds = counted.groupBy(*PROFILE_KEYS, "run_seconds").agg(
        F.sum(figure("n")).alias("n"), F.sum(figure("slots")).alias("slots"), F.sum(figure("slots_n")).alias("slots_n")
    )
    per_group = Window.partitionBy(*PROFILE_KEYS)
    upto = per_group.orderBy("run_seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # queries without a run time have no part in the median, and come first
    timed = F.when(F.col("run_seconds").isNotNull(), F.col("n"))
    ranked = seconds.withColumns({"upto": F.sum(timed).over(upto), "all": F.sum(timed).over(per_group)})
    return ranked.groupBy(*PROFILE_KEYS).agg(
        F.sum("n").alias("query_count"),
        F.try_divide(F.sum("slots"), F.sum("slots_n")).alias("avg_slots_per_query"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("run_seconds"))).alias("median_duration_seconds"),
    )


def hourly_profile(queries: DataFrame) -> DataFrame:
    """The same, from the queries themselves, for those who need nothing else of them."""
    return queries.groupBy(*PROFILE_KEYS).agg(
        F.count("*").alias("query_count"), F.avg(_mean_slots()).alias("avg_slots_per_query"),
        quantiles.discrete_median("run_seconds").alias("median_duration_seconds"),
    )


def _is_trickle(params: TrickleParams) -> Column:
    return (
        (F.col("hourly_queries") > params.min_hourly_queries)
        & (F.col("slots") < params.max_avg_slots)
        & (F.col("seconds") < params.max_median_seconds)
    )


def _hour_figures() -> dict[str, Column]:
    # projects weigh the same in both averages
    return {
        "hourly_queries": F.sum("query_count"),
        "slots": F.avg("avg_slots_per_query"),
        "seconds": F.avg("median_duration_seconds"),
    }


def flagged_hours(profile: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """Hours of a reservation with many queries that are small on average."""
    return (
        profile.groupBy("hour_bucket", "reservation_id")
        .agg(*[figure.alias(name) for name, figure in _hour_figures().items()])
        .filter(_is_trickle(params))
        .select("hour_bucket", "reservation_id", "hourly_queries")
    )


def trickle_hours(jobs: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """The flagged hours in time order."""
    flagged = flagged_hours(hourly_profile(reserved_queries(jobs, params)), params)
    return flagged.orderBy("hour_bucket", "reservation_id")


def flagged_project_hours(jobs: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """Profile rows that fall in flagged hours, each with the hour's total.

    A join of the profile with its own totals would scan the jobs twice. The window holds one
    pre-aggregated row per project of one reservation and hour.
    """
    profile = hourly_profile(reserved_queries(jobs, params))
    same_hour = Window.partitionBy("hour_bucket", "reservation_id")
    return (
        profile.withColumns({name: figure.over(same_hour) for name, figure in _hour_figures().items()})
        .filter(_is_trickle(params))
        .select("hour_bucket", "reservation_id", "project_id", "query_count", "hourly_queries")
    )


def trickle_summary(jobs: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """Flagged hours, the busiest of them and the busiest projects, by reservation."""
    in_flagged = flagged_project_hours(jobs, params)
    hours = (
        in_flagged.select("reservation_id", "hour_bucket", "hourly_queries").distinct()
        .groupBy("reservation_id")
        .agg(F.count("*").alias("total_flagged_hours"), F.max("hourly_queries").alias("peak_hourly_queries"))
    )
    labelled = F.concat(F.col("project_id"), F.lit(" ("), F.col("total_queries").cast("string"), F.lit(")"))
    projects = in_flagged.groupBy("reservation_id", "project_id").agg(F.sum("query_count").alias("total_queries"))
    tops = (
        first_of_each(projects, ["reservation_id"], [F.desc("total_queries"), "project_id"], params.top_projects)
        .withColumn("label", labelled)
        .groupBy("reservation_id")
        .agg(listed("label", "rank").alias("top_projects"))
    )
    return hours.join(tops, "reservation_id").select(
        "reservation_id", "total_flagged_hours", "peak_hourly_queries", "top_projects",
        F.lit(costs.BASELINE_ADVICE).alias("advice"),
    )


def trickle_heatmap(flagged: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """Queries in flagged hours by hour of day and weekday, with intensity against the busiest cell."""
    require_utc(flagged.sparkSession)
    hour, weekday = hour_and_weekday(F.col("hour_bucket"), params.timezone)
    cells = flagged.groupBy(hour.alias("hour"), weekday.alias("weekday")).agg(F.sum("hourly_queries").alias("queries"))
    grid = week_grid(flagged.sparkSession).join(cells, ["hour", "weekday"], "left").na.fill(0, ["queries"])
    # 168 rows, whatever the input
    highest = F.max("queries").over(Window.partitionBy())
    intensity = F.when(F.col("queries") > 0, F.col("queries") / highest).otherwise(F.lit(0.0))
    return grid.withColumn("intensity", intensity).orderBy("hour", "weekday")


def _most_frequent(jobs: DataFrame, params: TrickleParams) -> DataFrame:
    counted = counted_queries(reserved_queries(jobs, params))
    flagged = flagged_hours(profile_of(counted), params)
    # one row per hour, reservation and hash meets the flagged hours
    figure, timed = quantiles.figure, F.when(F.col("run_seconds").isNotNull(), quantiles.figure("n"))
    by_hash = counted.groupBy("hour_bucket", "reservation_id", "query_hash").agg(
        F.sum(figure("n")).alias("n"), F.min(figure("example")).alias("example"),
        *[F.sum(figure(c)).alias(c) for c in ("slot_ms", "slot_n", "bytes", "bytes_n")],
        F.sum(F.col("run_seconds") * figure("n")).alias("seconds"), F.coalesce(F.sum(timed), F.lit(0)).alias("seconds_n"),
    )
    frequent = (
        by_hash.join(flagged.select("hour_bucket", "reservation_id"), ["hour_bucket", "reservation_id"])
        .groupBy("query_hash")
        .agg(
            F.sum("n").alias("frequency"),
            F.min("example").alias("example"),
            F.try_divide(F.sum("slot_ms"), F.sum("slot_n")).alias("avg_slot_ms"),
            F.try_divide(F.sum("seconds"), F.sum("seconds_n")).alias("avg_seconds"),
            F.try_divide(F.sum("bytes"), F.sum("bytes_n")).alias("avg_bytes"),
        )
    )
    return top_rows(frequent, [F.desc("frequency"), "query_hash"], params.top_queries).select(
        "query_hash", "frequency", "avg_slot_ms", "avg_seconds", "avg_bytes",
        F.col("example.job_id").alias("example_job_id"), F.col("example.project_id").alias("project_id"),
        F.col("example.day").alias("creation_date"),
    )


def trickle_top_queries(jobs: DataFrame, jobs_text: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """The most frequent queries of the flagged hours, with full text and advice.

    The text table, the widest of all, is read for the days of the look-back only, and of these for
    the days of the examples where it has a day partition: the day is part of the join. How to join
    is left to the optimizer, which knows that the list is short. Rows with text are then added to
    the rows without, and one of each kept.
    """
    top = _most_frequent(jobs, params)
    recent = since(jobs_text, "creation_time", params.as_of, params.lookback_days, partition="creation_date")
    created = "creation_date" if "creation_date" in recent.columns else F.to_date("creation_time").alias("creation_date")
    # a project's own view holds the texts of its jobs
    project = F.col(VIEW).alias("project_id") if VIEW in recent.columns else F.col("project_id")
    if VIEW in recent.columns:
        recent = recent.filter(F.col(VIEW) == F.col("project_id"))
    texts = recent.select(project, F.col("job_id").alias("example_job_id"), created, "query")
    found = texts.join(top, ["project_id", "example_job_id", "creation_date"])
    keys = top.columns
    shown = (
        top.withColumn("query", F.lit(None).cast("string"))
        .unionByName(found.select(*keys, "query"))
        .groupBy(*keys)
        .agg(F.max("query").alias("query"))
    )
    avg_bytes = F.coalesce("avg_bytes", F.lit(0.0))
    return round_columns(
        shown.select(
            F.coalesce("query", F.lit(costs.TEXT_MISSING)).alias("query"),
            "example_job_id", "project_id", "frequency",
            (costs.or_zero(F.col("avg_slot_ms")) / costs.SLOT_HOUR_MS).alias("avg_slot_hours"),
            F.coalesce("avg_seconds", F.lit(0.0)).alias("avg_duration_seconds"),
            avg_bytes.alias("avg_bytes_processed"),
            costs.short_query_advice(avg_bytes, F.col("avg_seconds")).alias("recommendation"),
        ),
        {"avg_slot_hours": 4, "avg_duration_seconds": 2, "avg_bytes_processed": 2},
    ).orderBy(F.desc("frequency"), "example_job_id")


def with_display_columns(top_queries: DataFrame, params: TrickleParams = TrickleParams()) -> DataFrame:
    """Cut long texts for display, and add the short badge and the size in MB."""
    return top_queries.withColumns({
        "query": costs.shown_text(F.col("query"), params.shown_length),
        "badge": costs.advice_badge(F.col("recommendation")),
        "avg_mb_processed": costs.megabytes(F.col("avg_bytes_processed")),
    })
