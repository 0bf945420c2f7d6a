"""Users by bytes billed, with cost under both pricing models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions import costs
from slotledger.functions.predicates import is_query
from slotledger.functions.rounding import round_columns
from slotledger.functions.times import since
from slotledger.operators.topk import top_rows
from slotledger.params import SpenderParams
from slotledger.sources.tables import in_view


def top_spenders(jobs: DataFrame, params: SpenderParams = SpenderParams()) -> DataFrame:
    """The users with most bytes billed. Scripts count, and so do jobs without a user."""
    recent = since(in_view(jobs, params), "creation_time", params.as_of, params.lookback_days, partition="creation_date")
    users = (
        recent.filter(is_query())
        .groupBy("user_email")
        .agg(
            F.count("*").alias("query_count"),
            F.sum("total_bytes_billed").alias("billed"),
            F.sum("total_slot_ms").alias("slot_ms"),
        )
    )
    hours = costs.slot_hours(F.col("slot_ms"))
    figures = top_rows(users, [F.desc("billed"), "user_email"], params.limit_users).select(
        "user_email", "query_count",
        costs.or_zero(F.col("billed")).alias("total_bytes_billed"),
        hours.alias("total_slot_hours"),
        (costs.terabytes(F.col("billed")) * params.od_price).alias("est_on_demand_cost"),
        (hours * params.ed_price).alias("est_editions_cost"),
    )
    return round_columns(figures, {"total_slot_hours": 2, "est_on_demand_cost": 2, "est_editions_cost": 2})


def with_terabytes(spenders: DataFrame) -> DataFrame:
    """Add the bytes billed in TB."""
    return spenders.withColumn("total_tb_billed", costs.terabytes(F.col("total_bytes_billed")))
