"""Slots: sizing per reservation, utilisation over time, current reservations and the peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions import costs, ids
from slotledger.functions import predicates as only
from slotledger.functions.rounding import round_columns, to_nearest
from slotledger.functions.times import checked_zone, iso_text, since, tumbling
from slotledger.operators import quantiles
from slotledger.params import PeakParams, SlotParams, UtilizationParams
from slotledger.session import require_utc
from slotledger.sources.tables import in_view, shape_reservations

DAY_COLUMN = "period_date"
SIZING_UNIT = 50
RESOLUTION_MS = {"MINUTE": 60000, "HOUR": 3600000, "DAY": 86400000}


def _reserved(timeline: DataFrame, params: SlotParams) -> DataFrame:
    # scripts and other job types count here, unlike in utilisation
    recent = since(in_view(timeline, params), "period_start", params.as_of, params.lookback_days, partition=DAY_COLUMN)
    return recent.filter(only.on_reservation())


def per_second_usage(timeline: DataFrame, params: SlotParams = SlotParams()) -> DataFrame:
    """Slot milliseconds by second and reservation. A second is part of the key, so the
    busiest reservation is spread over as many groups as it has seconds."""
    return _reserved(timeline, params).groupBy("period_start", "reservation_id").agg(
        F.sum("period_slot_ms").alias("slot_ms")
    )


def merged_per_second(per_second: DataFrame) -> DataFrame:
    return per_second.groupBy("period_start").agg(F.sum("slot_ms").alias("slot_ms"))


def windowed_usage(per_second: DataFrame, keys: list[str], params: SlotParams = SlotParams()) -> DataFrame:
    """Average over the full window length, and the busiest second, by window."""
    seconds = params.window_minutes * 60
    return (
        per_second.groupBy(tumbling(F.col("period_start"), params.window_minutes).alias("window_start"), *keys)
        .agg(F.sum("slot_ms").alias("slot_ms"), F.max("slot_ms").alias("peak_ms"))
        .select(
            "window_start", *keys,
            (F.col("slot_ms") / (1000.0 * seconds)).alias("avg_slots"),
            (F.col("peak_ms") / 1000.0).alias("max_slots"),
        )
    )


def _sizes(params: SlotParams) -> list:
    return [
        quantiles.sketch("avg_slots", [params.percentile], params.accuracy).alias("averages"),
        quantiles.sketch("max_slots", [90, 99], params.accuracy).alias("maxima"),
        F.max("max_slots").alias("peak"),
    ]


def _rounded_sizes() -> list:
    sizes = {
        "recommended_baseline": F.get("averages", 0),
        "recommended_max_p90": F.get("maxima", 0),
        "recommended_max_p99": F.get("maxima", 1),
        "recommended_max_peak": F.col("peak"),
    }
    return [to_nearest(size, SIZING_UNIT).alias(name) for name, size in sizes.items()]


def named_sizes(sizes: DataFrame, merged: Column) -> DataFrame:
    """Sizes to the nearest 50 slots with the ids of reservations, or the name of all of them merged."""
    res, name = F.col("reservation_id"), F.lit(costs.MERGED_NAME)
    return sizes.select(
        F.when(merged, name).otherwise(res).alias("reservation_id"),
        F.when(~merged, ids.admin_project(res)).alias("admin_project_id"),
        F.when(merged, name).otherwise(ids.clean_id(res)).alias("clean_reservation_id"),
        *_rounded_sizes(),
    )


def sizes_by_reservation(per_second: DataFrame, params: SlotParams) -> DataFrame:
    windows = windowed_usage(per_second, ["reservation_id"], params)
    return named_sizes(windows.groupBy("reservation_id").agg(*_sizes(params)), F.lit(False))


def size_of_all(per_second: DataFrame, params: SlotParams) -> DataFrame:
    sizes = windowed_usage(merged_per_second(per_second), [], params).agg(*_sizes(params))
    return named_sizes(sizes.withColumn("reservation_id", F.lit(None).cast("string")), F.lit(True))


def slot_recommendations(timeline: DataFrame, params: SlotParams = SlotParams()) -> DataFrame:
    """Baseline and maximum per reservation, to the nearest 50 slots."""
    return sizes_by_reservation(per_second_usage(timeline, params), params)


def merged_slot_recommendation(timeline: DataFrame, params: SlotParams = SlotParams()) -> DataFrame:
    """One row: the size of a single reservation that would carry all of the usage."""
    return size_of_all(per_second_usage(timeline, params), params)


def all_slot_recommendations(timeline: DataFrame, params: SlotParams = SlotParams()) -> DataFrame:
    """Per reservation and merged. Both halves share the shuffle of the per-second sums."""
    return slot_recommendations(timeline, params).unionByName(merged_slot_recommendation(timeline, params))


def current_reservations(timeline: DataFrame, reservations: DataFrame, params: SlotParams = SlotParams()) -> DataFrame:
    """Reservations of every admin project that usage names, or of the organisation's project if none."""
    res = F.col("reservation_id")
    # the filter is cheap and runs next to the scan
    used = _reserved(timeline, params).filter(ids.names_admin_project(res)).select("reservation_id").distinct()
    admins = used.select(ids.admin_project(res).alias("admin_project_id")).distinct()
    fallback = (
        admins.agg(F.count("*").alias("n"))
        .filter((F.col("n") == 0) & F.lit(params.org_project_id is not None))
        .select(F.lit(params.org_project_id).cast("string").alias("admin_project_id"))
    )
    return (
        shape_reservations(reservations)
        .join(admins.unionByName(fallback), "admin_project_id", "left_semi")
        .select(
            F.col("reservation_name").alias("reservation_id"),
            F.col("slot_capacity").alias("current_baseline"),
            F.col("max_slots").alias("current_max_slots"),
            "edition", "admin_project_id",
            F.lit(params.region).alias("region"),
        )
    )


def _counted_buckets(rows: DataFrame, percents: dict[str, int]) -> DataFrame:
    """Sums, maximum and exact ranks by bucket, all from one table of counted values."""
    # the join below implies the filter; said here, it is the same in both uses of the counts
    counts = quantiles.counted(
        rows.filter(F.col("period_min").isNotNull()), "period_min", "period_slot_ms", {"billed": "total_bytes_billed", "processed": "total_bytes_processed"}
    )
    sums = counts.groupBy("period_min").agg(
        F.sum(F.col("period_slot_ms") * quantiles.figure("n")).alias("slot_ms"), F.max("period_slot_ms").alias("max_ms"),
        F.sum(quantiles.figure("billed")).alias("billed"), F.sum(quantiles.figure("processed")).alias("processed"),
    )
    return sums.join(quantiles.ranks(counts, "period_min", "period_slot_ms", percents), "period_min", "left")


def utilization_buckets(timeline: DataFrame, params: UtilizationParams = UtilizationParams()) -> DataFrame:
    """Utilisation by UTC bucket. Maximum and percentiles are over single job-seconds, not over
    concurrent totals, and byte averages divide by 60 at every resolution."""
    require_utc(timeline.sparkSession)
    length_ms = RESOLUTION_MS[params.resolution]
    recent = since(in_view(timeline, params), "period_start", params.as_of, params.lookback_days, partition=DAY_COLUMN)
    rows = recent.filter(only.is_query() & only.not_script()).select(
        F.date_trunc(params.resolution, "period_start").alias("period_min"),
        "period_slot_ms", "total_bytes_billed", "total_bytes_processed",
    )
    percents = {"p90_ms": 90, "p99_ms": 99}
    # two ways to the same columns: one bounded sketch, or exact ranks from counted values
    if params.exact:
        buckets = _counted_buckets(rows, percents)
    else:
        sums = [
            F.sum("period_slot_ms").alias("slot_ms"), F.max("period_slot_ms").alias("max_ms"),
            F.sum("total_bytes_billed").alias("billed"), F.sum("total_bytes_processed").alias("processed"),
        ]
        both = quantiles.sketch("period_slot_ms", list(percents.values()), params.accuracy).alias("ranks")
        buckets = rows.groupBy("period_min").agg(*sums, both).withColumns(
            {name: F.get("ranks", position) for position, name in enumerate(percents)}
        )
    # a whole-number sum is the exact value of the decimal one; the quotient keeps nine decimals
    average = (costs.or_zero(F.col("slot_ms")).cast("decimal(38,9)") / length_ms).cast("decimal(38,9)")
    figures = buckets.select(
        "period_min",
        (costs.or_zero(F.col("max_ms")) / 1000.0).alias("max_slots"),
        F.lit(0).alias("median_slots"),
        (costs.or_zero(F.col("p90_ms")) / 1000.0).alias("p90_slots"),
        (costs.or_zero(F.col("p99_ms")) / 1000.0).alias("p99_slots"),
        F.bround(average, 4).cast("double").alias("time_average"),
        (costs.or_zero(F.col("billed")) / 60.0).alias("bytes_billed_avg"),
        (costs.or_zero(F.col("processed")) / 60.0).alias("bytes_processed_avg"),
    )
    return round_columns(
        figures,
        {"max_slots": 2, "p90_slots": 3, "p99_slots": 3, "bytes_billed_avg": 2, "bytes_processed_avg": 4},
    )


def slot_utilization(timeline: DataFrame, params: UtilizationParams = UtilizationParams()) -> DataFrame:
    """Utilisation with local ISO times, newest first by instant."""
    zone = checked_zone(params.timezone)
    buckets = utilization_buckets(timeline, params)
    return buckets.orderBy(F.desc("period_min")).select(
        iso_text(F.col("period_min"), zone).alias("timestamp"),
        *[c for c in buckets.columns if c != "period_min"],
    )


def utilization_peak(utilization: DataFrame) -> DataFrame:
    """The highest ``max_slots`` of utilisation rows and the maximum baseline it suggests."""
    return utilization.agg(costs.or_zero(F.max("max_slots")).alias("peak_slots")).withColumn(
        "suggested_max", costs.suggested_maximum(F.col("peak_slots"))
    )


def peak_slots(timeline: DataFrame, params: PeakParams = PeakParams()) -> DataFrame:
    """The busiest second over all jobs, and the maximum baseline it suggests."""
    recent = since(in_view(timeline, params), "period_start", params.as_of, params.lookback_days, True, DAY_COLUMN)
    per_second = recent.filter(only.is_query() & only.not_script()).groupBy("period_start").agg(
        F.sum("period_slot_ms").alias("slot_ms")
    )
    return peak_of(per_second)


def peak_of(per_second: DataFrame) -> DataFrame:
    return per_second.agg((costs.or_zero(F.max("slot_ms")) / 1000.0).alias("peak_slots")).withColumn(
        "suggested_max", costs.suggested_maximum(F.col("peak_slots"))
    )
