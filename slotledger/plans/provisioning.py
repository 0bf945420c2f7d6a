"""Provisioned slots over time, from the change logs of reservations and commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.costs import or_zero
from slotledger.functions.predicates import came_after
from slotledger.functions.rounding import round_columns
from slotledger.functions.times import days_before, instant, iso_text, whole_seconds
from slotledger.operators.blocks import asof_backward, lag_row, running_steps
from slotledger.operators.grids import repeated
from slotledger.params import ProvisioningParams, UtilizationParams
from slotledger.plans.slots import utilization_buckets
from slotledger.session import require_utc
from slotledger.sources.tables import in_admin_project, shape_reservation_changes

RESERVATION, COMMITMENT = "reservation", "commitment"
TOTALS = ["current_slots", "baseline_slots", "capacity_slots"]


def _span(params: ProvisioningParams) -> tuple[Column, Column]:
    end = F.date_trunc("second", instant(params.as_of))
    return days_before(end, params.lookback_days), end


def _level_change(action: Column, level: Column, before: Column, was_alive: Column) -> Column:
    """How one change moves the total. An update without a level takes the old one away; a deletion
    counts only after a creation or an update."""
    return (
        F.when(action == "CREATE", level)
        .when(action == "UPDATE", F.coalesce(level - before, level, -before, F.lit(0)))
        .when(action == "DELETE", F.when(was_alive, -level).otherwise(F.lit(0)))
    )


def reservation_events(changes: DataFrame, params: ProvisioningParams = ProvisioningParams()) -> DataFrame:
    """Entries of the reservation log as events. The edition filter comes before the lag."""
    _, end = _span(params)
    log = in_admin_project(shape_reservation_changes(changes), params)
    return log.filter((F.col("change_timestamp") <= end) & (F.col("edition") == params.edition)).select(
        F.lit(RESERVATION).alias("log"), F.col("project_id").alias("owner"), F.col("reservation_name").alias("name"),
        "change_timestamp", "action", F.col("current_slots").alias("level"), F.col("slot_capacity").alias("base"),
    )


def commitment_events(changes: DataFrame, params: ProvisioningParams = ProvisioningParams()) -> DataFrame:
    """Entries of the active part of the commitment log as events."""
    _, end = _span(params)
    none = F.lit(None)
    return in_admin_project(changes, params).filter(
        (F.col("state") == "ACTIVE") & (F.col("edition") == params.edition) & (F.col("change_timestamp") <= end)
    ).select(
        F.lit(COMMITMENT).alias("log"), none.cast("string").alias("owner"), F.col("capacity_commitment_id").alias("name"),
        "change_timestamp", "action", F.col("slot_count").cast("long").alias("level"), none.cast("long").alias("base"),
    )


def event_deltas(events: DataFrame) -> DataFrame:
    """How each event moves the totals, by the event before it of the same reservation or commitment."""
    carried = ["action", "level", "base"]
    lagged = lag_row(events, ["log", "owner", "name"], ["change_timestamp", *carried], carried, "before")
    action, level, before = F.col("action"), F.col("level"), F.col("before.level")
    alive = came_after(F.col("before.action"))
    committed = F.when(
        action.isin("CREATE", "UPDATE"), F.when(alive, F.coalesce(level - before, level)).otherwise(level)
    ).when((action == "DELETE") & alive, -level).otherwise(F.lit(0))
    reserves = F.col("log") == RESERVATION
    return lagged.select(
        "log", "name", "change_timestamp",
        F.when(reserves, _level_change(action, level, before, alive)).alias("current_delta"),
        F.when(reserves, _level_change(action, F.col("base"), F.col("before.base"), alive)).alias("baseline_delta"),
        F.when(~reserves, committed).alias("capacity_delta"),
    )


def reservation_deltas(changes: DataFrame, params: ProvisioningParams = ProvisioningParams()) -> DataFrame:
    """Moves of the autoscaled and baseline totals."""
    return event_deltas(reservation_events(changes, params)).select(
        "change_timestamp", F.col("name").alias("reservation_name"), "current_delta", "baseline_delta"
    )


def commitment_deltas(changes: DataFrame, params: ProvisioningParams = ProvisioningParams()) -> DataFrame:
    """Moves of the committed total, over the active part of the log only."""
    return event_deltas(commitment_events(changes, params)).select(
        "change_timestamp", F.col("name").alias("capacity_commitment_id"), "capacity_delta"
    )


def provisioning_steps(
    reservation_changes: DataFrame,
    commitment_changes: DataFrame,
    params: ProvisioningParams = ProvisioningParams(),
) -> DataFrame:
    """The step function of provisioned slots: one row per distinct change time from the start of
    the span, with the totals that hold until ``next_timestamp``.

    Both logs are one stream of events: each is read once, and one lag and one running total serve
    both. Deltas are summed per timestamp, so entries at one time cost one row, however many there
    are. Everything before the span adds up at its start, so the running totals cover the span only.
    ``copies`` counts the log entries at that time, reservations times commitments, each log having
    an entry at both ends.
    """
    start, end = _span(params)
    events = reservation_events(reservation_changes, params).unionByName(commitment_events(commitment_changes, params))
    reserves = F.col("log") == RESERVATION
    counted = F.col("change_timestamp") >= start
    moved = event_deltas(events).select(
        F.greatest("change_timestamp", start).alias("change_timestamp"), "current_delta", "baseline_delta", "capacity_delta",
        (counted & reserves).cast("long").alias("in_reservations"), (counted & ~reserves).cast("long").alias("in_commitments"),
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = moved.sparkSession.range(1).select(
        F.explode(F.array(start, end)).alias("change_timestamp"), zero.alias("current_delta"), zero.alias("baseline_delta"),
        zero.alias("capacity_delta"), one.alias("in_reservations"), one.alias("in_commitments"),
    )
    points = moved.unionByName(ends).groupBy("change_timestamp").agg(
        or_zero(F.sum("current_delta")).alias("current_slots"),
        or_zero(F.sum("baseline_delta")).alias("baseline_slots"),
        or_zero(F.sum("capacity_delta")).alias("capacity_slots"),
        (F.greatest(F.sum("in_reservations"), one) * F.greatest(F.sum("in_commitments"), one)).alias("copies"),
    )
    return running_steps(points, "change_timestamp", TOTALS, "next_timestamp").withColumn(
        "next_timestamp", F.coalesce("next_timestamp", end)
    )


def provisioning_timeline(
    reservation_changes: DataFrame,
    commitment_changes: DataFrame,
    params: ProvisioningParams = ProvisioningParams(),
) -> DataFrame:
    """The timeline at whole seconds, run-length coded. Entries at one time share their totals: of
    the ``copies`` of a row all but the last have no length and end where they begin."""
    return provisioning_steps(reservation_changes, commitment_changes, params).select(
        F.date_trunc("second", "change_timestamp").alias("change_timestamp"),
        F.date_trunc("second", "next_timestamp").alias("end_timestamp"),
        *TOTALS, "copies",
    )


def repeated_timeline(timeline: DataFrame) -> DataFrame:
    """One row for each copy of a run-length coded timeline."""
    last = F.col("copy") == F.col("copies")
    return repeated(timeline, "copies", "copy").select(
        "change_timestamp", F.when(last, F.col("end_timestamp")).otherwise(F.col("change_timestamp")).alias("end_timestamp"), *TOTALS
    )


def provisioned_slot_hours(steps: DataFrame) -> DataFrame:
    """Slot-hours from the steps: autoscaled, baseline beyond the commitments, and both."""
    seconds = whole_seconds(F.date_trunc("second", "change_timestamp"), F.date_trunc("second", "next_timestamp"))
    uncommitted = F.greatest(F.col("baseline_slots") - F.col("capacity_slots"), F.lit(0))
    hours = steps.agg(
        (or_zero(F.sum(seconds * F.col("current_slots"))) / 3600.0).alias("autoscaled_slot_hours"),
        (or_zero(F.sum(seconds * uncommitted)) / 3600.0).alias("baseline_slot_hours"),
        (or_zero(F.sum(seconds * (F.col("current_slots") + uncommitted))) / 3600.0).alias("total_slot_hours"),
    )
    rounded = round_columns(hours, {c: 2 for c in hours.columns})
    both = F.col("autoscaled_slot_hours") + F.col("baseline_slot_hours")
    return rounded.select(
        "*",
        F.try_divide("autoscaled_slot_hours", both).alias("autoscaled_share"),
        F.try_divide("baseline_slot_hours", both).alias("baseline_share"),
    )


def utilization_vs_provisioned(
    timeline: DataFrame,
    reservation_changes: DataFrame,
    commitment_changes: DataFrame,
    utilization: UtilizationParams = UtilizationParams(),
    provisioning: ProvisioningParams = ProvisioningParams(),
) -> DataFrame:
    """Utilisation with the slots provisioned at the start of each bucket, oldest first."""
    require_utc(timeline.sparkSession)
    buckets = utilization_buckets(timeline, utilization)
    steps = provisioning_steps(reservation_changes, commitment_changes, provisioning).select(
        F.date_trunc("second", "change_timestamp").alias("at"), "change_timestamp", "baseline_slots", "current_slots"
    )
    provided = ["baseline_slots", "current_slots"]
    joined = asof_backward(
        buckets, steps, "period_min", "at", provided, sequence=["change_timestamp"]
    )
    return joined.orderBy("period_min").select(
        iso_text(F.col("period_min"), utilization.timezone).alias("timestamp"),
        *[c for c in buckets.columns if c != "period_min"],
        *[or_zero(F.col(c)).alias(c) for c in provided],
    )
