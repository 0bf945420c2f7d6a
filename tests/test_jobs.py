from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from slotledger.functions import costs
from slotledger.params import JobCostParams, SpenderParams
from slotledger.plans import jobs as plans
from slotledger.plans import spenders
from tests.rows import AS_OF, NOON, at, dicts, jobs, one

PARAMS = JobCostParams(as_of=AS_OF)


def lasting(**kw):
    return NOON + timedelta(**kw)


def test_cost_of_a_long_job(spark):
    found = one(plans.job_costs(jobs(spark, dict(total_bytes_billed=1024**4, total_slot_ms=120000 * 75)), PARAMS))
    assert found["avg_slots"] == found["effective_slots"] == 75
    assert found["billed_slots"] == 100
    assert found["on_demand_cost"] == 6.25
    assert found["editions_cost"] == pytest.approx(100 * 120000 / 3600000 * 0.06)
    assert found["category"] == costs.RESERVATION_CANDIDATE
    assert found["waste_savings"] == found["on_demand_cost"] - found["editions_cost"]


@pytest.mark.parametrize("ms, slot_ms, effective, billed", [
    (30000, 30000 * 10, 20.0, 20.0),           # spike factor 2, below the sharing limit
    (60000, 60000 * 50, 50.0, 50.0),           # no spike at exactly a minute, limit reached
    (60000, 60000 * 50 - 600, 49.99, 49.99),   # just below the limit
    (60000, 60000 * 51, 51.0, 100.0),
    (0, 1000, 0.0, 0.0),                       # no duration
    (60000, None, 0.0, 0.0),                   # no usage
])
def test_slots(spark, ms, slot_ms, effective, billed):
    found = one(plans.job_costs(jobs(spark, dict(end_time=lasting(milliseconds=ms), total_slot_ms=slot_ms)), PARAMS))
    assert found["effective_slots"] == pytest.approx(effective)
    assert found["billed_slots"] == pytest.approx(billed)


def test_unfinished_job_is_billed_a_minute(spark):
    found = one(plans.job_costs(jobs(spark, dict(end_time=None)), PARAMS))
    assert found["avg_slots"] == 0 and found["editions_cost"] == 0
    assert one(plans._costed(jobs(spark, dict(end_time=None)), PARAMS))["billed_ms"] == 60000


def test_sharing_limit_does_not_follow_the_step(spark):
    df = jobs(spark, dict(total_slot_ms=120000 * 60), dict(total_slot_ms=120000 * 49))
    found = dicts(plans.job_costs(df, JobCostParams(as_of=AS_OF, slot_step_size=200)).orderBy("job_id"))
    assert [r["billed_slots"] for r in found] == [200, 49]


def test_ratio_at_the_margin_is_uncertain(spark):
    pairs = spark.createDataFrame([(1.2, 1.0), (1.0, 1.2), (1.21, 1.0), (1.0, 1.21), (0.0, 0.0)], "od double, ed double")
    found = [r[0] for r in pairs.select(costs.cost_category(F.col("od"), F.col("ed"))).collect()]
    assert found == [costs.UNCERTAIN, costs.UNCERTAIN, costs.RESERVATION_CANDIDATE, costs.ON_DEMAND_CANDIDATE,
                     costs.UNCERTAIN]


def test_rows_that_count(spark):
    df = jobs(
        spark, dict(job_id="kept"), dict(job_id="kept_null_type", statement_type=None),
        dict(job_id="kept_null_cache", cache_hit=None), dict(job_id="script", statement_type="SCRIPT"),
        dict(job_id="load", job_type="LOAD"), dict(job_id="running", state="RUNNING"),
        dict(job_id="cached", cache_hit=True), dict(job_id="small", total_bytes_billed=10485759),
        dict(job_id="kept_small", total_bytes_billed=10485760), dict(job_id="null_bytes", total_bytes_billed=None),
        dict(job_id="at_bound", creation_time=at("2024-01-01 00:00:00")),
        dict(job_id="kept_after_bound", creation_time=at("2024-01-01 00:00:00.000001")),
    )
    assert {r["job_id"] for r in dicts(plans.job_costs(df, PARAMS))} == {
        "kept", "kept_null_type", "kept_null_cache", "kept_small", "kept_after_bound"
    }


def test_limit_comes_before_the_totals_and_ties_are_stable(spark):
    df = jobs(spark, *[dict(job_id=f"j{n}", project_id=f"p{n}") for n in range(5)])
    limited = JobCostParams(as_of=AS_OF, limit_jobs=2)
    assert {r["project_id"] for r in dicts(plans.project_cost_summary(df, limited))} == {"p0", "p1"}
    everything = JobCostParams(as_of=AS_OF, limit_jobs=None)
    assert len(dicts(plans.project_cost_summary(df, everything))) == 5


def test_errors_add_to_the_error_tax(spark):
    df = jobs(spark, dict(error_result=("quota", None, None)), dict())
    found = one(plans.project_cost_summary(df, PARAMS))
    assert found["editions_error_tax"] == pytest.approx(found["total_editions_cost"] / 2)


def test_top_jobs_are_filtered_before_the_cut(spark):
    df = jobs(
        spark, dict(job_id="big", total_bytes_billed=1024**4, total_slot_ms=1),
        dict(job_id="slow", total_slot_ms=120000 * 1000),
    )
    both = dicts(plans.top_jobs(df, PARAMS))
    assert [(r["job_id"], r["better_plan"], r["current_plan"]) for r in both] == [
        ("big", "Editions", "On-Demand"), ("slow", "On-Demand", "On-Demand")
    ]
    assert both[1]["savings_pct"] == 0 and 0 < both[0]["savings_pct"] <= 100
    cut = JobCostParams(as_of=AS_OF, limit_top_jobs=1, category_filter="On-Demand")
    assert [r["job_id"] for r in dicts(plans.top_jobs(df, cut))] == ["slow"]


def test_no_jobs(spark):
    assert dicts(plans.job_costs(jobs(spark), PARAMS)) == []
    assert dicts(plans.project_cost_summary(jobs(spark), PARAMS)) == []
    assert dicts(spenders.top_spenders(jobs(spark), SpenderParams(as_of=AS_OF))) == []


def test_spenders_count_scripts_and_unknown_users(spark):
    df = jobs(
        spark, dict(user_email=None, total_bytes_billed=None, total_slot_ms=None), dict(user_email="b", statement_type="SCRIPT"),
        dict(user_email="b"), dict(user_email="a", total_bytes_billed=2 * 10**9), dict(user_email="c", job_type="LOAD"),
    )
    found = dicts(spenders.top_spenders(df, SpenderParams(as_of=AS_OF)))
    # equal bytes are ordered by user, users without bytes come last
    assert [(r["user_email"], r["query_count"], r["total_bytes_billed"]) for r in found] == [
        ("a", 1, 2 * 10**9), ("b", 2, 2 * 10**9), (None, 1, 0)
    ]
    assert [r["total_slot_hours"] for r in found] == [0.03, 0.07, 0.0]
    assert len(dicts(spenders.top_spenders(df, SpenderParams(as_of=AS_OF, limit_users=2)))) == 2
