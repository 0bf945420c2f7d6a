"""Day rollups of the usage timeline: seconds by reservation, and sketches of window sizes by day.

Rollups lie beside the timeline, divided by the same days. For each day a mark tells of which files
of the timeline it was made. A day whose files are not those of its mark, because late rows came or
an earlier run ended half-way, is not used: answers take such days from the timeline itself, and
``refresh`` makes them anew and overwrites them alone. So answers are those of the timeline always.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.functions import predicates as only
from slotledger.functions.times import days_before, instant, since
from slotledger.operators import quantiles
from slotledger.params import PeakParams, SlotParams
from slotledger.plans import slots
from slotledger.session import require_utc
from slotledger.sources.tables import read_table

TIMELINE, SECONDS, SKETCHES, MARKS = "jobs_timeline", "usage_by_second", "usage_sketches", "usage_marks"
DAY = slots.DAY_COLUMN
MINUTES_OF_A_DAY = 1440

SECONDS_SCHEMA = f"period_start timestamp, reservation_id string, counted boolean, slot_ms long, {DAY} date"
SKETCHES_SCHEMA = f"reservation_id string, merged boolean, averages binary, maxima binary, peak_ms long, window_minutes int, {DAY} date"
MARKS_SCHEMA = f"files long, bytes long, hash long, {DAY} date"


def _days_of_files(spark: SparkSession, root: str) -> DataFrame:
    """The mark of each day of the timeline as it lies there now: a listing, no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/{TIMELINE}")
    return files.groupBy(F.col(DAY).cast("date").alias(DAY)).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("hash"),
    )


def _stored(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _marks(spark: SparkSession, root: str) -> tuple[dict[date, tuple], set[date]]:
    """The marks of all days as of now, and the days whose rollups bear them. One row a day each."""
    now = {r[DAY]: (r.files, r.bytes, r.hash) for r in _days_of_files(spark, root).collect()}
    made = {r[DAY]: (r.files, r.bytes, r.hash) for r in _stored(spark, root, MARKS, MARKS_SCHEMA).collect()}
    return now, {day for day, mark in now.items() if made.get(day) == mark}


def _replace_days(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{root}/{name}")


def seconds_of(timeline: DataFrame) -> DataFrame:
    """Slot milliseconds by second, reservation and whether the jobs are queries that count for the peak."""
    counted = F.coalesce(only.is_query() & only.not_script(), F.lit(False)).alias("counted")
    return timeline.groupBy(DAY, "period_start", "reservation_id", counted).agg(F.sum("period_slot_ms").alias("slot_ms"))


def sketches_of(seconds: DataFrame, params: SlotParams, k: int) -> DataFrame:
    """Sketches of window averages and maxima by day and reservation, and of all reservations merged.

    Windows are aligned to the epoch, and must divide a day, so that none is in two days.
    """
    if MINUTES_OF_A_DAY % params.window_minutes:
        raise ValueError(f"windows of {params.window_minutes} minutes do not divide a day")
    reserved = seconds.filter(only.on_reservation()).groupBy(DAY, "period_start", "reservation_id").agg(F.sum("slot_ms").alias("slot_ms"))
    merged = reserved.groupBy(DAY, "period_start").agg(F.sum("slot_ms").alias("slot_ms"))
    every = reserved.withColumn("merged", F.lit(False)).unionByName(
        merged.withColumns({"reservation_id": F.lit(None).cast("string"), "merged": F.lit(True)})
    )
    windows = slots.windowed_usage(every, [DAY, "reservation_id", "merged"], params)
    return windows.groupBy(DAY, "reservation_id", "merged").agg(
        F.kll_sketch_agg_double("avg_slots", k).alias("averages"), F.kll_sketch_agg_double("max_slots", k).alias("maxima"),
        F.max(F.col("max_slots") * 1000).cast("long").alias("peak_ms"),
    ).withColumn("window_minutes", F.lit(params.window_minutes))


def refresh(spark: SparkSession, root: str, params: SlotParams = SlotParams(), k: int = 4096) -> list[date]:
    """Make the rollups of all days that have none or whose files have changed; which days these were.

    The marks are taken before the rows are read and written after the rollups: a row that comes in
    between, or a run that ends early, leaves a mark that does not fit, and the day is made again.
    ``k`` sets the size of the sketches and their error, see :func:`rank_error`.
    """
    require_utc(spark)
    now, complete = _marks(spark, root)
    stale = sorted(set(now) - complete)
    if stale:
        timeline = read_table(spark, root, TIMELINE).filter(F.col(DAY).isin(stale))
        _replace_days(seconds_of(timeline).repartitionByRange("period_start").sortWithinPartitions("period_start"), root, SECONDS)
        seconds = _stored(spark, root, SECONDS, SECONDS_SCHEMA).filter(F.col(DAY).isin(stale))
        _replace_days(sketches_of(seconds, params, k), root, SKETCHES)
        _replace_days(spark.createDataFrame([(*now[day], day) for day in stale], MARKS_SCHEMA), root, MARKS)
    return stale


def seconds(spark: SparkSession, root: str) -> DataFrame:
    """Seconds of all days: rollups where they are complete, else the timeline's own rows added up."""
    _, complete = _marks(spark, root)
    rolled = _stored(spark, root, SECONDS, SECONDS_SCHEMA).filter(F.col(DAY).isin(sorted(complete)))
    rest = read_table(spark, root, TIMELINE).filter(~F.col(DAY).isin(sorted(complete)))
    return rolled.unionByName(seconds_of(rest))


def _reserved(usage: DataFrame, params: SlotParams) -> DataFrame:
    recent = since(usage, "period_start", params.as_of, params.lookback_days, partition=DAY)
    return recent.filter(only.on_reservation()).groupBy("period_start", "reservation_id").agg(F.sum("slot_ms").alias("slot_ms"))


def slot_recommendations(spark: SparkSession, root: str, params: SlotParams = SlotParams()) -> DataFrame:
    return slots.sizes_by_reservation(_reserved(seconds(spark, root), params), params)


def merged_slot_recommendation(spark: SparkSession, root: str, params: SlotParams = SlotParams()) -> DataFrame:
    return slots.size_of_all(_reserved(seconds(spark, root), params), params)


def all_slot_recommendations(spark: SparkSession, root: str, params: SlotParams = SlotParams()) -> DataFrame:
    reserved = _reserved(seconds(spark, root), params)
    return slots.sizes_by_reservation(reserved, params).unionByName(slots.size_of_all(reserved, params))


def peak_slots(spark: SparkSession, root: str, params: PeakParams = PeakParams()) -> DataFrame:
    usage = since(seconds(spark, root), "period_start", params.as_of, params.lookback_days, True, DAY).filter("counted")
    return slots.peak_of(usage.groupBy("period_start").agg(F.sum("slot_ms").alias("slot_ms")))


def rank_error(k: int) -> float:
    """The error in rank of a quantile, as a share of the values, that sketches of size ``k`` keep to with
    a probability of 99 %. Up to ``k`` values a sketch is exact. The constants are fixed values."""
    return 2.296 / k**0.9021


def _quantile(sketch: Column, percent: int) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(percent / 100.0))


def sketched_recommendations(
    spark: SparkSession, root: str, params: SlotParams = SlotParams(), k: int = 4096
) -> DataFrame:
    """Sizes per reservation and merged, from the sketches of whole days within the look-back.

    The days in which the look-back begins and ends, and days without a complete rollup, are sketched
    from seconds. Cost grows with days and reservations, not with seconds.
    """
    require_utc(spark)
    _, complete = _marks(spark, root)
    end = instant(params.as_of)
    bound = days_before(end, params.lookback_days)
    stored = _stored(spark, root, SKETCHES, SKETCHES_SCHEMA)
    whole = (
        F.col(DAY).isin(sorted(complete)) & (F.col("window_minutes") == params.window_minutes)
        & (F.col(DAY).cast("timestamp") > bound) & (F.date_add(DAY, 1).cast("timestamp") <= end)
    )
    days = stored.filter(whole)
    usable = [r[DAY] for r in days.select(DAY).distinct().collect()]  # one row a day
    usage = since(seconds(spark, root), "period_start", params.as_of, params.lookback_days, partition=DAY)
    edges = sketches_of(usage.filter(~F.col(DAY).isin(usable)), params, k)
    merged = days.unionByName(edges.select(*days.columns)).groupBy("reservation_id", "merged").agg(
        F.kll_merge_agg_double("averages", k).alias("averages"), F.kll_merge_agg_double("maxima", k).alias("maxima"),
        (F.max("peak_ms") / 1000.0).alias("peak"),
    )
    sizes = merged.withColumns({
        "averages": F.array(_quantile(F.col("averages"), params.percentile)),
        "maxima": F.array(_quantile(F.col("maxima"), 90), _quantile(F.col("maxima"), 99)),
    })
    return slots.named_sizes(sizes, F.col("merged"))
