"""Rollups against the timeline they are made from, after late rows and early ends too."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from slotledger.params import PeakParams, SlotParams
from slotledger.plans import rollups, slots
from slotledger.sources.tables import read_table, write_table
from tests import rows
from tests.rows import at, dicts

PARAMS = SlotParams(as_of="2024-01-04 00:00:00", lookback_days=3)
DAYS = [datetime.date(2024, 1, d) for d in (1, 2, 3)]


def usage(spark, seed, day, n=300):
    rng = random.Random(seed)
    return rows.seconds(spark, *[
        dict(
            period_start=at(f"2024-01-0{day} 00:00:00") + datetime.timedelta(seconds=rng.randrange(7200)),
            reservation_id=rng.choice(["a:US.r", "b:US.s", None]), period_slot_ms=rng.choice([rng.randrange(90_000), None]),
            statement_type=rng.choice(["SELECT", "SCRIPT", None]), job_type=rng.choice(["QUERY", "QUERY", "LOAD"]),
        ) for _ in range(n)
    ])


@pytest.fixture
def root(spark, tmp_path):
    write_table(usage(spark, 1, 1).unionByName(usage(spark, 2, 2)).unionByName(usage(spark, 3, 3)), str(tmp_path), "jobs_timeline")
    return str(tmp_path)


def same(spark, root):
    timeline = read_table(spark, root, "jobs_timeline")
    for made, plain in (
        (rollups.all_slot_recommendations(spark, root, PARAMS), slots.all_slot_recommendations(timeline, PARAMS)),
        (rollups.sketched_recommendations(spark, root, PARAMS), slots.all_slot_recommendations(timeline, PARAMS)),
        (rollups.peak_slots(spark, root, PeakParams(as_of=PARAMS.as_of)), slots.peak_slots(timeline, PeakParams(as_of=PARAMS.as_of))),
    ):
        assert sorted(map(str, dicts(made))) == sorted(map(str, dicts(plain)))


def test_answers_are_those_of_the_timeline(spark, root):
    same(spark, root)  # without any rollup
    assert rollups.refresh(spark, root, PARAMS) == DAYS
    same(spark, root)
    timeline = read_table(spark, root, "jobs_timeline")
    both = dicts(rollups.slot_recommendations(spark, root, PARAMS)) + dicts(rollups.merged_slot_recommendation(spark, root, PARAMS))
    assert sorted(map(str, both)) == sorted(map(str, dicts(slots.all_slot_recommendations(timeline, PARAMS))))
    assert rollups.refresh(spark, root, PARAMS) == []


def test_late_rows_make_their_day_anew(spark, root):
    rollups.refresh(spark, root, PARAMS)
    write_table(usage(spark, 9, 2, 40), root, "jobs_timeline", mode="append")
    same(spark, root)
    assert rollups.refresh(spark, root, PARAMS) == [DAYS[1]]
    same(spark, root)
    stored = spark.read.parquet(f"{root}/{rollups.SECONDS}")
    assert stored.groupBy("period_start", "reservation_id", "counted").count().where("count > 1").count() == 0


def test_a_run_that_ended_early_leaves_no_mark(spark, root, monkeypatch):
    written = rollups._replace_days

    def fails(df, folder, name):
        if name == rollups.MARKS:
            raise RuntimeError("lost")
        written(df, folder, name)

    monkeypatch.setattr(rollups, "_replace_days", fails)
    with pytest.raises(RuntimeError):
        rollups.refresh(spark, root, PARAMS)
    monkeypatch.undo()
    same(spark, root)
    assert rollups.refresh(spark, root, PARAMS) == DAYS


def test_look_backs_that_begin_and_end_within_a_day(spark, root):
    rollups.refresh(spark, root, PARAMS)
    timeline = read_table(spark, root, "jobs_timeline")
    params = SlotParams(as_of="2024-01-03 01:00:00", lookback_days=2)
    plain = dicts(slots.all_slot_recommendations(timeline, params))
    for made in (rollups.all_slot_recommendations(spark, root, params), rollups.sketched_recommendations(spark, root, params)):
        assert sorted(map(str, dicts(made))) == sorted(map(str, plain))


def test_windows_must_divide_a_day(spark, root):
    with pytest.raises(ValueError, match="divide a day"):
        rollups.refresh(spark, root, SlotParams(window_minutes=7))


def test_complete_days_are_not_read_from_the_timeline(spark, root):
    rollups.refresh(spark, root, PARAMS)
    write_table(usage(spark, 9, 2, 40), root, "jobs_timeline", mode="append")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rollups.seconds(spark, root)._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.splitlines() if "FileScan" in line and "/jobs_timeline]" in line]
    assert "NOT period_date" in scan and "PartitionFilters" in scan


@pytest.mark.parametrize("k", [64, 512])
def test_merged_sketches_keep_to_their_error_over_thirty_days(spark, k):
    """Ranks of merged quantiles among all values, 30 days with 20,000 windows of very unequal sizes each."""
    day, value = F.col("id") % 30, F.exp(F.rand(5) * 9 + F.col("id") % 30 / 10)
    values = spark.range(600_000).select(day.alias("day"), value.alias("v")).cache()
    sketches = values.groupBy("day").agg(F.kll_sketch_agg_double("v", k).alias("s"))
    merged = sketches.agg(F.kll_merge_agg_double("s", k).alias("s"))
    for percent in (10, 50, 90, 99):
        q = merged.select(rollups._quantile(F.col("s"), percent)).first()[0]
        rank = values.where(F.col("v") <= q).count() / 600_000
        assert abs(rank - percent / 100) <= 1.5 * rollups.rank_error(k)
    values.unpersist()
