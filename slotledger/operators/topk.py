"""The first rows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.operators.blocks import BLOCK, BUNDLE, bundled, in_blocks, unbundled

#: Up to so many rows one task merges what every task has kept.
MERGED_ROWS = 100_000
BINS = 4096


def top_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order, found without sorting the rest.

    Every task keeps its own first ``n`` rows and one task merges them. The merged rows are in one
    partition already, so the coalesce moves nothing. It keeps later projections above the limit:
    below it, they would part the limit from its sort, and all rows would be sorted by range.
    """
    return df.orderBy(*order).limit(n).coalesce(1)


def first_of_each(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1; every task keeps its own first ones before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def listed(label: str, by: str) -> Column:
    """An aggregate: the labels of a group in the order of ``by``, joined by commas."""
    return F.expr(f"listagg({label}, ', ') within group (order by {by})")


def most(df: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the highest whole numbers ``by``, equal ones by ``ties``; NULLs come last.

    For few rows this is :func:`top_rows`. Of many, no task could hold them: a histogram of ``by`` tells
    in which bin the n-th row is. Rows above are taken as they are, and only the rows of that bin are
    put in order, by ranges, and counted along these. Rows come in no particular order.
    """
    if n <= MERGED_ROWS:
        return top_rows(df, [F.desc_nulls_last(by), *ties], n)
    # widths in proportion to the number, so that bins are narrow where values are small
    size = F.floor(F.log1p(F.abs(F.col(by).cast("double"))) * (BINS / 44))
    rows = df.withColumn("_bin", F.coalesce(F.when(F.col(by) < 0, -size).otherwise(size), F.lit(-BINS - 1)))
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    # at most two bins for each of the widths, whatever the input
    higher = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).filter(F.col("_above") < n)
    placed = rows.join(F.broadcast(above), "_bin")
    whole = placed.filter(F.col("_above") + F.col("_n") <= n).select(*df.columns)
    # no more than the rows of one bin are sorted; a negated key puts the highest first, NULLs last
    last = placed.filter(F.col("_above") + F.col("_n") > n).withColumns(
        {"_null": F.col(by).isNull(), "_down": -F.col(by).cast("decimal(38,0)")}
    )
    sort = ["_null", "_down", *ties]
    last = last.select("_above", *sort, *[c for c in df.columns if c not in ties])
    blocks = in_blocks(bundled(last, sort), sort)
    counts = blocks.groupBy(BLOCK).agg(F.count("*").alias("_rows"), F.any_value(BUNDLE).alias("_any"))
    before = F.sum("_rows").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(BLOCK, F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*sort)) + unbundled("_above")
    ranked = blocks.withColumn("_rank", rank).join(F.broadcast(starts), BLOCK)
    kept = ranked.filter(F.col("_rank") + F.col("_before") <= n)
    return whole.unionByName(kept.select(*[c if c in ties else unbundled(c).alias(c) for c in df.columns]))
