"""Ordered operations over long logs, cut into blocks of about equal size.

A window without a partition, or with one hot partition, puts its whole input into one task. Here
the rows are dealt by ranges of the whole order, keys first, so that a block is a run of consecutive
rows whatever the keys and the times are: the cuts come from a sample of the rows, and a key or an
hour that holds most of a log is cut as often as its rows need. Windows run inside a block. What a
block hands on is one row; those rows, one for each block, meet in one task and are broadcast.

Rows that are equal in every ordered column stay together, as no cut lies between them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, CARRY, KEY, BUNDLE = "_block", "_carry", "_key", "_bundle"


def in_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with the number of its block, one partition for each: ascending runs of ``order``."""
    ranged = df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id())
    # by number, not by its hash, which would put several blocks into one task
    return ranged.repartitionById(_partitions(df), BLOCK)


def bundled(df: DataFrame, apart: list[str]) -> DataFrame:
    """``df`` with all columns but ``apart`` in one, an array of one struct; see :func:`unbundled`.

    The rows of blocks are used twice, for the blocks' ends and for themselves. If a use needs fewer
    columns, or one leaves out what the other keeps, they are pruned apart and scan and shuffle twice.
    """
    rest = [c for c in df.columns if c not in apart]
    return df.select(*apart, F.array(F.struct(*rest)).alias(BUNDLE)) if rest else df


def unbundled(name: str) -> Column:
    return F.element_at(BUNDLE, 1)[name]


def _partitions(df: DataFrame) -> int:
    conf = df.sparkSession.conf
    shuffle = conf.get("spark.sql.shuffle.partitions")
    return int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or shuffle)


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))


def lag_row(df: DataFrame, keys: list[str], order: list[str], carried: list[str], into: str) -> DataFrame:
    """The previous row of each key as struct ``into``, NULL on the first.

    Rows without ``order[0]`` are left out. The last row of each block is handed to the next one.
    """
    sort, held = [*keys, *order], list(dict.fromkeys([*keys, *carried]))
    apart = list(dict.fromkeys([*sort, *carried]))
    rows = in_blocks(bundled(df.filter(F.col(order[0]).isNotNull()), apart), sort)
    inside = Window.partitionBy(BLOCK).orderBy(*sort)
    ends = rows.groupBy(BLOCK).agg(F.max_by(F.struct(*[c for c in rows.columns if c != BLOCK]), F.struct(*sort)).alias("_end"))
    handed = ends.select(BLOCK, F.lag("_end").over(Window.orderBy(BLOCK)).alias("_end"))
    handed = handed.select(BLOCK, F.struct(*[F.col("_end")[c].alias(c) for c in held]).alias(CARRY), F.col("_end").isNotNull().alias("_handed"))
    # column by column: a struct would be built below the shuffle and make it another one
    lagged = rows.withColumns({"_has": F.lag(F.lit(True)).over(inside), **{f"_lag_{c}": F.lag(c).over(inside) for c in held}})
    within = F.when(_same([(F.col(f"_lag_{k}"), F.col(k)) for k in keys]), F.struct(*[F.col(f"_lag_{c}").alias(c) for c in carried]))
    carry = F.col(CARRY)
    across = F.when(
        F.col("_handed") & _same([(carry[k], F.col(k)) for k in keys]), F.struct(*[carry[c].alias(c) for c in carried])
    )
    # one row for each block, of which there are no more than shuffle partitions
    return lagged.join(F.broadcast(handed), BLOCK).select(
        *[c if c in apart else unbundled(c).alias(c) for c in df.columns],
        F.when(F.col("_has"), within).otherwise(across).alias(into),
    )


def running_steps(points: DataFrame, ts: str, totals: list[str], following: str) -> DataFrame:
    """Running totals over unique timestamps, and the next timestamp as ``following``."""
    rows = in_blocks(bundled(points, [ts]), [ts])
    inside = Window.partitionBy(BLOCK).orderBy(ts)
    along = Window.orderBy(BLOCK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(BLOCK).agg(F.min(ts).alias("_first"), *[F.sum(unbundled(t)).alias(f"_sum_{t}") for t in totals])
    offsets = ends.select(
        BLOCK, F.lead("_first").over(along).alias("_next_block"),
        *[F.coalesce(F.sum(f"_sum_{t}").over(earlier), F.lit(0)).alias(f"_off_{t}") for t in totals],
    )
    running = {t: F.sum(unbundled(t)).over(inside) + F.col(f"_off_{t}") for t in totals}
    others = [c for c in points.columns if c not in (ts, *totals)]
    found = rows.withColumn(following, F.lead(ts).over(inside)).join(F.broadcast(offsets), BLOCK)
    found = found.select(
        ts, F.coalesce(following, "_next_block").alias(following), *[unbundled(c).alias(c) for c in others],
        *[total.alias(t) for t, total in running.items()],
    )
    return found.select(*points.columns, following)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    values: list[str],
    by: list[str] | None = None,
    sequence: list[str] | None = None,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row at or before it, NULL if none.

    Left rows are kept one for one; those without a time have NULL values. Right rows without a
    time are left out. Among right rows with equal time, the last by ``sequence`` wins. What a block
    hands on is the last value of its last key, so neither gaps nor the time after the last change
    cost rows.
    """
    by, sequence = by or [], sequence or []
    # a struct of nullable fields is itself never NULL, so equal keys meet even if they hold NULLs
    left_rows = left.select(
        _struct(by).alias(KEY), F.col(left_ts).alias("_ts"), F.lit(2).alias("_side"), _struct(left.columns).alias("_row")
    )
    right_rows = right.where(F.col(right_ts).isNotNull()).select(
        _struct(by).alias(KEY), F.col(right_ts).alias("_ts"), F.lit(1).alias("_side"),
        _struct(sequence).alias("_seq"), _struct(values).alias("_value"),
    )
    sort = [KEY, "_ts", "_side", "_seq"]
    rows = in_blocks(right_rows.unionByName(left_rows, allowMissingColumns=True), sort)
    upto = Window.partitionBy(BLOCK, KEY).orderBy(*sort[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_seen", F.last("_value", ignorenulls=True).over(upto))
    # the left row goes along because, pruned away, it would make this another shuffle
    last = F.max_by(F.struct(KEY, "_seen", "_row"), F.struct(*sort))
    ends = seen.groupBy(BLOCK).agg(last.alias("_last"))
    of_key = Window.partitionBy(f"_last.{KEY}").orderBy(BLOCK)
    ends = ends.select(BLOCK, F.col(f"_last.{KEY}").alias("key"), F.last("_last._seen", ignorenulls=True).over(of_key).alias("value"))
    handed = ends.select(BLOCK, F.lag(F.struct("key", "value")).over(Window.orderBy(BLOCK)).alias(CARRY))
    matched = seen.join(F.broadcast(handed), BLOCK).filter(F.col("_side") == 2)
    carried = F.when(F.col(f"{CARRY}.key") == F.col(KEY), F.col(f"{CARRY}.value"))
    value = F.coalesce("_seen", carried)
    return matched.select("_row.*", *[value.getField(v).alias(v) for v in values])


def _struct(names: list[str]) -> Column:
    return F.struct(*[F.col(n) for n in names]) if names else F.struct(F.lit(0).alias("all"))
