from datetime import timedelta

import pytest

from slotledger.params import PeakParams, SlotParams, UtilizationParams
from slotledger.plans import slots
from tests.rows import AS_OF, NOON, at, dicts, one, seconds, table

PARAMS = SlotParams(as_of=AS_OF)
UTIL = UtilizationParams(as_of=AS_OF)


def second(n, **kw):
    return dict(period_start=NOON + timedelta(seconds=n), **kw)


def test_windows_divide_by_their_full_length(spark):
    df = seconds(spark, *[second(n, period_slot_ms=300000) for n in range(3)], second(300, period_slot_ms=600000))
    found = dicts(slots.windowed_usage(slots.per_second_usage(df, PARAMS), ["reservation_id"], PARAMS).orderBy("window_start"))
    assert [(r["avg_slots"], r["max_slots"]) for r in found] == [(3.0, 300.0), (2.0, 600.0)]


def test_jobs_of_one_second_add_up(spark):
    df = seconds(spark, second(0, job_id="a", period_slot_ms=100000), second(0, job_id="b", period_slot_ms=150000))
    assert one(slots.slot_recommendations(df, PARAMS))["recommended_max_peak"] == 250
    assert one(slots.peak_slots(df, PeakParams(as_of=AS_OF))) == dict(peak_slots=250.0, suggested_max=500)
    # utilisation looks at single job-seconds
    assert one(slots.slot_utilization(df, UTIL))["max_slots"] == 150.0


def test_sizing_counts_scripts_and_loads_but_needs_a_reservation(spark):
    df = seconds(
        spark, second(0, statement_type="SCRIPT", period_slot_ms=100000), second(0, job_type="LOAD", period_slot_ms=100000),
        second(0, reservation_id=None, period_slot_ms=900000),
    )
    assert one(slots.slot_recommendations(df, PARAMS))["recommended_max_peak"] == 200
    assert dicts(slots.slot_utilization(df.filter("reservation_id is not null"), UTIL)) == []


def test_merged_peak_is_at_most_the_sum_of_peaks(spark):
    df = seconds(
        spark, second(0, reservation_id="a:US.x", period_slot_ms=500000), second(1, reservation_id="b:US.y", period_slot_ms=700000),
        second(0, reservation_id="b:US.y", period_slot_ms=100000),
    )
    rows = {r["reservation_id"]: r for r in dicts(slots.all_slot_recommendations(df, PARAMS))}
    assert rows["MERGED (Simulated)"]["recommended_max_peak"] == 700
    assert rows["MERGED (Simulated)"]["admin_project_id"] is None
    assert (rows["a:US.x"]["admin_project_id"], rows["a:US.x"]["clean_reservation_id"]) == ("a", "x")
    assert rows["a:US.x"]["recommended_max_peak"] + rows["b:US.y"]["recommended_max_peak"] == 1200


def test_merged_row_exists_without_usage(spark):
    row = one(slots.all_slot_recommendations(seconds(spark), PARAMS))
    assert row["reservation_id"] == "MERGED (Simulated)" and row["recommended_baseline"] is None


def test_sizing_bound_is_strict_and_peak_bound_inclusive(spark):
    df = seconds(spark, dict(period_start=at("2024-01-03 00:00:00")))
    assert dicts(slots.per_second_usage(df, SlotParams(as_of=AS_OF, lookback_days=1))) == []
    assert one(slots.peak_slots(df, PeakParams(as_of=AS_OF, lookback_days=1)))["peak_slots"] == 1.0
    assert one(slots.peak_slots(seconds(spark), PeakParams(as_of=AS_OF))) == dict(peak_slots=0.0, suggested_max=1000)


def reservations(spark):
    rows = [dict(admin_project_id=a, reservation_name=r, slot_capacity=100, autoscale=(m,))
            for a, r, m in [("adm", "r", 300), ("org", "o", 10), ("zzz", "z", 1)]]
    return table(spark, "reservations", *rows, edition="ENTERPRISE")


def test_current_reservations_follow_usage_or_fall_back(spark):
    org = SlotParams(as_of=AS_OF, org_project_id="org")
    found = one(slots.current_reservations(seconds(spark, second(0)), reservations(spark), org))
    assert found == dict(reservation_id="r", current_baseline=100, current_max_slots=300, edition="ENTERPRISE",
                         admin_project_id="adm", region="region-us")
    bare = seconds(spark, second(0, reservation_id="r"))
    assert one(slots.current_reservations(bare, reservations(spark), org))["admin_project_id"] == "org"
    assert dicts(slots.current_reservations(bare, reservations(spark), PARAMS)) == []


def test_utilization_averages(spark):
    df = seconds(
        spark, second(0, period_slot_ms=3, total_bytes_billed=100, total_bytes_processed=1),
        second(59, period_slot_ms=None, total_bytes_billed=None, total_bytes_processed=None),
    )
    row = one(slots.slot_utilization(df, UTIL))
    assert row["timestamp"] == "2024-01-03T07:00:00-05:00"
    # 3 / 60000 = 0.00005 is a tie and goes to the even digit
    assert row["time_average"] == 0.0
    assert (row["bytes_billed_avg"], row["bytes_processed_avg"], row["median_slots"]) == (1.67, 0.0167, 0)
    assert row["p90_slots"] == 0.003


@pytest.mark.parametrize("resolution, length, stamp", [
    ("MINUTE", 60000, "2024-01-03T07:00:00-05:00"),
    ("HOUR", 3600000, "2024-01-03T07:00:00-05:00"),
    ("DAY", 86400000, "2024-01-02T19:00:00-05:00"),
])
@pytest.mark.parametrize("exact", [False, True])
def test_resolutions(spark, resolution, length, stamp, exact):
    df = seconds(spark, *[second(n, period_slot_ms=n * 60000) for n in range(1, 11)])
    params = UtilizationParams(as_of=AS_OF, resolution=resolution, exact=exact)
    row = one(slots.slot_utilization(df, params))
    assert row["timestamp"] == stamp
    assert row["time_average"] == pytest.approx(55 * 60000 / length, abs=5e-5)
    # bytes divide by 60 whatever the resolution
    assert row["bytes_billed_avg"] == 10.0
    assert (row["p90_slots"], row["p99_slots"], row["max_slots"]) == (540.0, 600.0, 600.0)


def test_bucket_without_usage_values_keeps_its_row(spark):
    df = seconds(spark, second(0, period_slot_ms=None))
    for exact in (False, True):
        row = one(slots.slot_utilization(df, UtilizationParams(as_of=AS_OF, exact=exact)))
        assert (row["max_slots"], row["p90_slots"], row["time_average"]) == (0.0, 0.0, 0.0)


def test_newest_bucket_first_by_instant(spark):
    # 01:30 occurs twice in New York; text order would put the later one last
    early, late = at("2024-11-03 05:30:00"), at("2024-11-03 06:30:00")
    df = seconds(spark, dict(period_start=early), dict(period_start=late))
    found = dicts(slots.slot_utilization(df, UtilizationParams(as_of="2024-11-04 00:00:00")))
    assert [r["timestamp"] for r in found] == ["2024-11-03T01:30:00-05:00", "2024-11-03T01:30:00-04:00"]
    assert one(slots.utilization_peak(slots.slot_utilization(df, UtilizationParams(as_of="2024-11-04 00:00:00")))) == dict(
        peak_slots=1.0, suggested_max=500
    )


def test_unknown_zone_fails_before_any_job(spark):
    with pytest.raises(ValueError, match="Invalid timezone"):
        slots.slot_utilization(seconds(spark), UtilizationParams(timezone="Nowhere"))
