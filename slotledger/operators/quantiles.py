"""Quantiles: a bounded sketch, and an exact form for long groups of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_E_FOLD = 200
FIGURES = "_figures"


def sketch(value: Column | str, percents: list[int], accuracy: int = 10000) -> Column:
    """Values at the given percents as an array, from one sketch. Each is off by at most
    1/accuracy of the group's size in rank, and the sketch does not grow with the group."""
    return F.percentile_approx(value, [percent / 100.0 for percent in percents], accuracy)


def discrete_median(column: str) -> Column:
    """Exact discrete median. Its buffer holds one entry per distinct value, so use it on
    narrow domains such as whole seconds."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column})")


def counted(df: DataFrame, key: str, value: str, sums: dict[str, str] | None = None) -> DataFrame:
    """``(key, value, figures)``: one row for each value of a key, which spreads a hot key over its values.

    ``figures`` holds the count ``n`` and the named sums of other columns, as an array of one struct:
    uses that need different figures would be pruned apart, and then scan and shuffle once each.
    """
    sums = sums or {}
    figures = F.struct(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    return df.groupBy(key, value).agg(F.array(figures).alias(FIGURES))


def figure(name: str) -> Column:
    return F.element_at(FIGURES, 1)[name]


def exact(df: DataFrame, key: str, value: str, percents: dict[str, int]) -> DataFrame:
    """Exact discrete percentiles of a whole-number column per ``key``."""
    return ranks(counted(df, key, value), key, value, percents)


def ranks(counts: DataFrame, key: str, value: str, percents: dict[str, int]) -> DataFrame:
    """Exact discrete percentiles per ``key`` from :func:`counted` values.

    Values without a key are left out. A histogram with bins by sign and logarithm tells which bin
    holds each rank, and only that bin is ordered. NULLs are in the lowest bin and count for nothing:
    a filter on them would reach the scan, and make it another one than that of other uses of ``counts``.
    """
    size = F.floor(F.log1p(F.abs(F.col(value).cast("double"))) * BINS_PER_E_FOLD)
    lowest = -BINS_PER_E_FOLD * 50
    counts = counts.select(
        key, value, F.when(F.col(value).isNull(), F.lit(0)).otherwise(figure("n")).alias("_n"),
        F.coalesce(F.when(F.col(value) < 0, -size).otherwise(size), F.lit(lowest)).alias("_bin"),
    )
    per_key = Window.partitionBy(key)
    upto = per_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = counts.groupBy(key, "_bin").agg(F.sum("_n").alias("_n"))
    bins = bins.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(per_key)})
    rank = {name: F.greatest(F.ceil(F.col("_all") * percent / 100), F.lit(1)) for name, percent in percents.items()}
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.alias("rank")) for name, r in rank.items()])
    bins = bins.withColumn("_below", F.col("_upto") - F.col("_n"))
    targets = (
        bins.select(key, "_bin", "_below", "_upto", F.inline(wanted))
        .filter((F.col("rank") > F.col("_below")) & (F.col("rank") <= F.col("_upto")))
        .drop("_upto")
    )
    # each (key, name) has one bin, so this window orders the values of that bin only
    in_bin = Window.partitionBy(key, "name").orderBy(value)
    in_bin = in_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(targets, [key, "_bin"]).withColumn("_in_bin", F.sum("_n").over(in_bin))
    found = ranked.filter(F.col("_below") + F.col("_in_bin") >= F.col("rank"))
    picks = [F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in percents]
    return found.groupBy(key).agg(*picks)
