"""Complete grids, filled with zeros where there is no data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def baseline_steps(max_baseline: int, step: int) -> int:
    """Index of the last grid point: the first multiple of ``step`` at or above the maximum."""
    return -(-max(max_baseline, 0) // step)


def baseline_grid(spark: SparkSession, max_baseline: int, step: int, overflow: bool = False) -> DataFrame:
    """Grid points ``0, step, ..`` with their index ``k``, and one more for values above the top."""
    last = baseline_steps(max_baseline, step) + (1 if overflow else 0)
    points = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    return spark.range(1).select(F.explode(points).alias("k")).withColumn("slots", F.col("k") * step)


def week_grid(spark: SparkSession) -> DataFrame:
    """The 168 hours of a week."""
    hours = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.select("hour", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))


def band_label(slots, step: int):
    """Label of the band that ends at a grid point."""
    return F.when(slots == 0, "[0 → 0]").otherwise(F.format_string("[%d → %d]", slots - step, slots))


def repeated(df: DataFrame, times: str, into: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``times`` over, numbered from 1 in ``into``.

    Rows are generated in chunks, so that the arrays that they come from are short: a row repeated
    n times holds n / ``chunk`` numbers, and then a chunk of them, at once.
    """
    last = F.ceil(F.col(times) / chunk) - 1
    chunks = df.where(F.col(times) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("_chunk") * chunk
    copies = F.sequence(first + 1, F.least(first + chunk, F.col(times)))
    return chunks.withColumn(into, F.explode(copies)).drop("_chunk")
