"""The attribution configuration, one JSON document, as rows of reservation rates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.schemas import ATTRIBUTION_CONFIG

RATES = "reservation_key string, sku_rate double, total_admin_bill double, waste_rule string, central_project string"
CORRUPT = "_corrupt_record"


def rates_from_document(document: DataFrame) -> DataFrame:
    """One row per configured reservation. A document with an incomplete entry counts as none."""
    complete = F.forall(
        F.map_values("reservations"),
        lambda r: r["sku_rate"].isNotNull() & r["total_admin_bill"].isNotNull(),
    )
    return (
        document.filter(complete)
        .select(
            F.coalesce("waste_rule", F.lit("A")).alias("waste_rule"),
            F.col("central_cost_center_project").alias("central_project"),
            F.explode(F.map_entries("reservations")).alias("entry"),
        )
        .select(
            F.col("entry.key").alias("reservation_key"),
            F.col("entry.value.sku_rate").alias("sku_rate"),
            F.col("entry.value.total_admin_bill").alias("total_admin_bill"),
            "waste_rule",
            "central_project",
        )
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rates from a JSON file; no reservations if it is missing or does not parse."""
    schema = T.StructType([*ATTRIBUTION_CONFIG.fields, T.StructField(CORRUPT, T.StringType())])
    try:
        document = (
            spark.read.schema(schema)
            .option("multiLine", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(path)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RATES)
    return rates_from_document(document.filter(F.col(CORRUPT).isNull()))


def with_rule(rates: DataFrame, waste_rule: str = "A", central_project: str | None = None) -> DataFrame:
    """Attach the document-level settings to plain rate rows."""
    return rates.select(
        "reservation_key", "sku_rate", "total_admin_bill",
        F.lit(waste_rule).alias("waste_rule"),
        F.lit(central_project).cast("string").alias("central_project"),
    )
