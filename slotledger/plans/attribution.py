"""Attribution of reservation bills to the projects that used the slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions import costs, ids
from slotledger.functions import predicates as only
from slotledger.functions.rounding import round_columns
from slotledger.functions.times import between_days, day, previous_month
from slotledger.params import AttributionParams
from slotledger.session import require_utc
from slotledger.sources.tables import in_view

MONEY = ["direct_usage_cost_usd", "allocated_waste_cost_usd", "total_cost_attribution_usd"]
CONFIG = ["sku_rate", "total_admin_bill", "waste_rule", "central_project"]


def project_usage(jobs: DataFrame, params: AttributionParams = AttributionParams()) -> DataFrame:
    """Slot milliseconds by project and reservation. A missing statement type is dropped here."""
    require_utc(jobs.sparkSession)
    first, last = previous_month(params.as_of)
    if params.billing_month_start is not None:
        first = day(params.billing_month_start)
    if params.billing_month_end is not None:
        last = day(params.billing_month_end)
    billed = between_days(in_view(jobs, params), "creation_time", first, last, "creation_date")
    return (
        billed.filter(only.is_query() & only.known_not_script() & only.on_reservation())
        .groupBy("project_id", "reservation_id")
        .agg(costs.or_zero(F.sum("total_slot_ms")).alias("slot_ms"))
    )


def priced_reservations(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per used reservation with a rate: its total usage, rate and waste.

    The short id is looked up before the full id. Reservations without a rate drop out.
    """
    totals = usage.groupBy("reservation_id").agg(F.sum("slot_ms").alias("total_ms"))
    rate = F.struct(*CONFIG)
    by_short = rates.select(F.col("reservation_key").alias("short_key"), rate.alias("short_rate"))
    by_full = rates.select(F.col("reservation_key").alias("reservation_id"), rate.alias("full_rate"))
    total_hours = costs.slot_hours(F.col("total_ms"))
    return (
        totals.withColumn("short_key", ids.short_id(F.col("reservation_id")))
        .join(by_short, "short_key", "left")
        .join(by_full, "reservation_id", "left")
        .withColumn("rate", F.coalesce("short_rate", "full_rate"))
        .filter(F.col("rate").isNotNull())
        .select("reservation_id", total_hours.alias("total_hours"), "rate.*")
        .withColumn(
            "waste", F.greatest(F.lit(0.0), F.col("total_admin_bill") - F.col("total_hours") * F.col("sku_rate"))
        )
    )


def cost_attribution(jobs: DataFrame, rates: DataFrame, params: AttributionParams = AttributionParams()) -> DataFrame:
    """Direct cost and share of the unused bill by project and reservation.

    Rule A spreads the waste by usage. Rule B charges it to the central project, where one is set,
    and leaves projects with their direct cost. The rule is a column of ``rates``.
    """
    usage = project_usage(jobs, params)
    # totals join back instead of a window, so no task holds all projects of a reservation
    priced = priced_reservations(usage, rates)
    hours = costs.slot_hours(F.col("slot_ms"))
    share = F.when(F.col("total_hours") > 0, F.col("hours") / F.col("total_hours")).otherwise(F.lit(0.0))
    detail = (
        usage.join(priced, "reservation_id")
        .withColumn("hours", hours)
        .select(
            "project_id", "reservation_id",
            (F.col("hours") * F.col("sku_rate")).alias("direct"),
            F.when(F.col("waste_rule") == "A", F.col("waste") * share).otherwise(F.lit(0.0)).alias("waste"),
        )
    )
    central = priced.filter(
        (F.col("waste_rule") == "B") & (F.length("central_project") > 0) & (F.col("waste") > 0)
    ).select(F.col("central_project").alias("project_id"), "reservation_id", F.lit(0.0).alias("direct"), "waste")
    charges = [F.col("direct"), F.col("waste"), F.col("direct") + F.col("waste")]
    money = detail.unionByName(central).select(
        "project_id", "reservation_id", *[charge.alias(name) for name, charge in zip(MONEY, charges)]
    )
    return round_columns(money, dict.fromkeys(MONEY, 2))
