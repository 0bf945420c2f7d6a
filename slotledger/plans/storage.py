"""Storage: forecast cost per dataset under both billing models, and switch recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.functions.costs import gib
from slotledger.functions.predicates import has_physical_bytes
from slotledger.params import StorageParams

BYTE_COLUMNS = [
    "active_logical_bytes", "long_term_logical_bytes", "active_physical_bytes",
    "time_travel_physical_bytes", "fail_safe_physical_bytes", "long_term_physical_bytes",
]
MODEL_OPTION = "storage_billing_model"
DEFAULT_MODEL_OPTION = "default_storage_billing_model"


def dataset_bytes(table_storage: DataFrame) -> DataFrame:
    """Bytes per dataset over tables that hold physical bytes."""
    return (
        table_storage.filter(has_physical_bytes())
        .groupBy(F.col("project_id").alias("project_name"), F.col("table_schema").alias("dataset_name"))
        .agg(*[F.sum(c).alias(c) for c in BYTE_COLUMNS])
    )


def storage_forecast(table_storage: DataFrame, params: StorageParams = StorageParams()) -> DataFrame:
    size = {c: gib(F.col(c)) for c in BYTE_COLUMNS}
    travel = size["time_travel_physical_bytes"]
    logical = (
        size["active_logical_bytes"] * params.active_logical_price
        + size["long_term_logical_bytes"] * params.long_term_logical_price
    )
    physical = (
        (size["active_physical_bytes"] - travel) * params.active_physical_price
        + travel * params.time_travel_rescale * params.active_physical_price
        + size["fail_safe_physical_bytes"] * params.active_physical_price
        + size["long_term_physical_bytes"] * params.long_term_physical_price
    )
    return dataset_bytes(table_storage).select(
        "project_name", "dataset_name",
        logical.alias("forecast_logical"), physical.alias("forecast_physical"),
    )


def physical_datasets(schemata_options: DataFrame) -> DataFrame:
    """Datasets already on the physical model, over all projects in one scan."""
    return (
        schemata_options.filter((F.col("option_name") == MODEL_OPTION) & (F.col("option_value") == "PHYSICAL"))
        .select(F.col("project_id").alias("project_name"), F.col("schema_name").alias("dataset_name"))
        .distinct()
    )


def org_storage_status(organization_options: DataFrame, params: StorageParams = StorageParams()) -> DataFrame:
    """The organisation's default model; one row, LOGICAL when the option is not set."""
    model = F.when(F.col("n") == 0, "LOGICAL").otherwise(F.col("value"))
    statement = f"ALTER ORGANIZATION SET OPTIONS (`{params.region}.default_storage_billing_model`='PHYSICAL');"
    physical = F.coalesce(F.col("current_model") == "PHYSICAL", F.lit(False))
    return (
        organization_options.filter(F.col("option_name") == DEFAULT_MODEL_OPTION)
        .agg(F.count("*").alias("n"), F.min("option_value").alias("value"))
        .select(model.alias("current_model"))
        .select("current_model", physical.alias("is_optimized"), F.when(~physical, statement).alias("ddl"))
    )


def _switch_statement(params: StorageParams):
    head = [F.lit("ALTER SCHEMA `"), F.col("project_name"), F.lit("."), F.col("dataset_name")]
    model = [F.lit("` SET OPTIONS(storage_billing_model='"), F.col("better_on")]
    if params.time_travel_hours is None:
        tail = F.lit("' );")
    else:
        tail = F.lit(f"', max_time_travel_hours={float(params.time_travel_hours)});")
    return F.concat(*head, *model, tail)


def dearer_datasets(
    table_storage: DataFrame, schemata_options: DataFrame, params: StorageParams = StorageParams()
) -> DataFrame:
    """Datasets on the dearer model, with what a switch would save, in no order."""
    forecast = storage_forecast(table_storage, params)
    # both sides are grouped by the join keys already, so the join adds no shuffle of the forecast
    on_physical = physical_datasets(schemata_options).withColumn("on_physical", F.lit(True))
    logical, physical = F.col("forecast_logical"), F.col("forecast_physical")
    spending = F.when(F.col("currently_on") == "logical", logical).otherwise(physical)
    share = F.when(F.col("monthly_spending") > 0, F.col("monthly_savings") / F.col("monthly_spending")).otherwise(
        F.lit(0.0)
    )
    return (
        forecast.join(on_physical, ["project_name", "dataset_name"], "left")
        .withColumns({
            "currently_on": F.when(F.col("on_physical"), "physical").otherwise("logical"),
            "better_on": F.when(logical > physical, "physical").otherwise("logical"),
        })
        .filter(F.col("currently_on") != F.col("better_on"))
        .withColumns({
            "forecast_compare": logical - physical,
            "monthly_spending": spending,
            "monthly_savings": F.abs(logical - physical),
        })
        .withColumn("monthly_savings_pct", share)
        .filter(
            (F.col("monthly_savings") > params.min_monthly_saving)
            & (F.col("monthly_savings_pct") > params.min_monthly_saving_pct)
        )
        .select(
            "project_name", "dataset_name", "forecast_logical", "forecast_physical", "forecast_compare",
            "better_on", "currently_on", "monthly_spending", "monthly_savings", "monthly_savings_pct",
            _switch_statement(params).alias("ddl"),
        )
    )


def storage_recommendations(
    table_storage: DataFrame, schemata_options: DataFrame, params: StorageParams = StorageParams()
) -> DataFrame:
    """Datasets on the dearer model, the largest saving first."""
    found = dearer_datasets(table_storage, schemata_options, params)
    return found.orderBy(F.desc("monthly_savings"), "project_name", "dataset_name")


def storage_kpis(recommendations: DataFrame) -> DataFrame:
    """Total saving, distinct datasets and number of rows of recommendations, in any order."""
    named = F.concat_ws(
        ".", F.coalesce("project_name", F.lit("null")), F.coalesce("dataset_name", F.lit("null"))
    )
    return recommendations.agg(
        F.coalesce(F.sum("monthly_savings"), F.lit(0.0)).alias("total_savings"),
        F.count_distinct(named).alias("datasets"),
        F.count("*").alias("opportunities"),
    )
