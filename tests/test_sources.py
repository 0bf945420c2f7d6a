import json

import pytest
from pyspark.sql import functions as F

from slotledger.functions import times
from slotledger.params import JobCostParams, SlotParams, StorageParams
from slotledger.plans import jobs as job_plans
from slotledger.plans import matrix, slots, spenders, storage, trickle
from slotledger.sources import tables
from tests import rows
from tests.rows import AS_OF, at, dicts, one


def test_logs_are_stored_by_day_and_read_back(spark, tmp_path):
    given = rows.jobs(
        spark, dict(job_id="a", creation_time=at("2024-01-01 23:59:59")), dict(job_id="b", creation_time=at("2024-01-03 10:00:00")),
        dict(job_id="c", creation_time=at("2024-01-03 00:00:00"), error_result=("quota", None, None)),
    )
    tables.write_table(given, str(tmp_path), "jobs")
    assert sorted(p.name for p in (tmp_path / "jobs").glob("creation_date=*")) == [
        "creation_date=2024-01-01", "creation_date=2024-01-03"
    ]
    back = tables.read_table(spark, str(tmp_path), "jobs")
    assert sorted(back.drop("creation_date").collect()) == sorted(given.collect())
    shaped = {r["job_id"]: (r["has_error"], r["query_hash"]) for r in dicts(tables.shape_jobs(back))}
    assert shaped == {"a": (False, "h"), "b": (False, "h"), "c": (True, "h")}
    found = job_plans.job_costs(back, JobCostParams(as_of=AS_OF, lookback_days=1))
    # c lies on the bound, which is left out
    assert {r["job_id"] for r in dicts(found)} == {"b"}


def test_second_of_the_bound_day_is_kept(spark, tmp_path):
    """The day filter must not cut rows of the day in which the look-back starts."""
    given = rows.seconds(spark, dict(period_start=at("2024-01-02 12:00:01")), dict(period_start=at("2024-01-02 12:00:00")))
    tables.write_table(given, str(tmp_path), "jobs_timeline")
    back = tables.read_table(spark, str(tmp_path), "jobs_timeline")
    params = SlotParams(as_of="2024-01-03 12:00:00", lookback_days=1)
    assert [r["period_start"].second for r in dicts(slots.per_second_usage(back, params))] == [1]


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_plain_tables_in_other_formats(spark, tmp_path, fmt):
    given = rows.table(
        spark, "reservations",
        dict(admin_project_id="a", reservation_name="r", edition="ENTERPRISE", slot_capacity=5, autoscale=(7,)),
    )
    tables.write_table(given, str(tmp_path), "reservations", fmt)
    back = tables.shape_reservations(tables.read_table(spark, str(tmp_path), "reservations", fmt))
    assert one(back)["max_slots"] == 7


def test_nested_and_flat_columns_give_the_same_shape(spark):
    log = rows.changes(spark, ("2024-01-01 00:00:00", "CREATE", 5, 1))
    nested = tables.shape_reservation_changes(log)
    flat = tables.shape_reservation_changes(nested.drop("autoscale"))
    assert one(nested)["current_slots"] == one(flat)["current_slots"] == 5
    assert tables.shape_jobs(rows.jobs(spark, {}).drop("error_result", "query_info")).columns


@pytest.mark.parametrize("admin, org, scope", [
    ("adm", "org", "adm"), (None, "org", "org"), ("", "org", "org"), (" ", " org ", "org"), (None, None, None),
])
def test_scope(admin, org, scope):
    assert tables.chosen_scope(admin, org) == scope


SAMPLE = [
    {"id": 1, "project": "p", "dataset": "d", "logical_cost": 10.0, "physical_cost": 7.5, "recommendation": "Physical", "savings": 2.5},
    {"id": 2, "project": "p", "dataset": "e", "logical_cost": 3, "physical_cost": 4.25, "recommendation": "Logical", "savings": 1.25},
]


def test_forecast_sample(spark, tmp_path):
    path = tmp_path / "sample.json"
    path.write_text(json.dumps(SAMPLE, indent=2))
    found = tables.read_forecast_sample(spark, str(path))
    assert dicts(found.orderBy("id")) == SAMPLE
    gap = F.abs(F.col("logical_cost") - F.col("physical_cost"))
    assert found.filter(F.abs(gap - F.col("savings")) > 0.02).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_results_are_written_as_records(spark, tmp_path, fmt):
    status = storage.org_storage_status(rows.table(spark, "organization_options"), StorageParams())
    tables.write_result(status, str(tmp_path / "out"), fmt)
    assert one(spark.read.format(fmt).load(str(tmp_path / "out")))["current_model"] == "LOGICAL"


def test_every_plan_refuses_a_session_that_is_not_utc(spark, inputs, tmp_path):
    """Days are pruned in the session's zone, so that another one would lose rows."""
    plans = {
        "jobs": lambda: job_plans.job_costs(inputs.jobs), "spenders": lambda: spenders.top_spenders(inputs.jobs),
        "sizing": lambda: slots.slot_recommendations(inputs.jobs_timeline), "peak": lambda: slots.peak_slots(inputs.jobs_timeline),
        "utilization": lambda: slots.slot_utilization(inputs.jobs_timeline),
        "matrix": lambda: matrix.baseline_cost_matrix(inputs.jobs_timeline), "trickle": lambda: trickle.trickle_hours(inputs.jobs),
        "attribution": lambda: times.between_days(inputs.jobs, "creation_time", times.day("2024-01-01"), times.day("2024-01-02")),
        "write": lambda: tables.write_table(inputs.jobs, str(tmp_path / "t"), "jobs"),
    }
    frames = inputs.jobs, inputs.jobs_timeline
    assert all(frames)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        for name, build in plans.items():
            with pytest.raises(ValueError, match="UTC"):
                build()
                pytest.fail(name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def viewed(spark):
    """Two jobs, which overlapping views show: the organisation's both, two projects' one each."""
    jobs = rows.jobs(spark, dict(job_id="a", project_id="p1", user_email="x"), dict(job_id="b", project_id="p2", user_email="y"))
    seen = {"org": ["a", "b"], "p1": ["a", "b"], "p2": ["b"]}
    views = [jobs.where(F.col("job_id").isin(ids)).withColumn("view_project", F.lit(view)) for view, ids in seen.items()]
    return views[0].unionByName(views[1]).unionByName(views[2])


@pytest.mark.parametrize("scope, expected", [
    (dict(admin_project_id="p2", org_project_id="org"), {"b"}),
    (dict(admin_project_id=" ", org_project_id="org"), {"a", "b"}),
    (dict(admin_project_id="p1"), {"a", "b"}),
    (dict(home_project_id="p1"), {"a"}),
    (dict(org_project_id="absent"), set()),
])
def test_one_view_of_several_is_read(spark, tmp_path, scope, expected):
    tables.write_table(viewed(spark), str(tmp_path), "jobs")
    assert sorted(p.name for p in (tmp_path / "jobs").glob("view_project=*")) == ["view_project=org", "view_project=p1", "view_project=p2"]
    back = tables.read_table(spark, str(tmp_path), "jobs", views=True)
    for table in (viewed(spark), back):
        found = tables.in_view(table, JobCostParams(**scope))
        assert sorted(r["job_id"] for r in dicts(found)) == sorted(expected) and "view_project" not in found.columns
        costs = job_plans.job_costs(table, JobCostParams(as_of=AS_OF, **scope))
        assert sorted(r["job_id"] for r in dicts(costs)) == sorted(expected)


def test_several_views_without_a_project_are_refused(spark):
    with pytest.raises(ValueError, match="name the project"):
        tables.in_view(viewed(spark), JobCostParams())
    with pytest.raises(ValueError, match="view_project"):
        spenders.top_spenders(viewed(spark))


def test_a_table_of_one_view_needs_no_project(spark):
    plain = rows.jobs(spark, {}, {})
    assert tables.in_view(plain, JobCostParams(admin_project_id="other")).count() == 2


def test_a_view_without_days_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    given = spark.range(3_000).select(
        F.timestamp_seconds(F.col("id") + 1704067200).alias("change_timestamp"), F.lit("p").alias("project_id"),
        F.col("id").cast("string").alias("capacity_commitment_id"), F.lit("CREATE").alias("action"),
        F.lit(100).alias("slot_count"), F.lit("ACTIVE").alias("state"), F.lit("ENTERPRISE").alias("edition"),
        F.when(F.col("id") % 10 == 0, "other").otherwise("org-main").alias(tables.VIEW),
    )
    tables.write_table(given, str(tmp_path), "capacity_commitment_changes")
    root = tmp_path / "capacity_commitment_changes"
    assert len([*(root / f"{tables.VIEW}=org-main").glob("*.parquet")]) >= 20
    back = spark.read.parquet(str(root)).select(*given.columns)
    assert back.exceptAll(given).count() == given.exceptAll(back).count() == 0
    largest = back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert largest <= 300


def test_logs_are_cut_by_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    given = rows.jobs(spark, *[dict(job_id=str(k), creation_time=at("2024-01-03 10:00:00")) for k in range(1)])
    given = given.drop("creation_time").crossJoin(
        spark.range(2_000).select(F.timestamp_seconds(F.col("id") + 1704067200).alias("creation_time"))
    )
    tables.write_table(given, str(tmp_path), "jobs")
    back = tables.read_table(spark, str(tmp_path), "jobs")
    assert back.count() == 2_000
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 200


def test_derived_numbers_and_seconds_are_those_of_the_plain_text(spark):
    """Numbers by blocks against one window, with nulls, equal times and repeated rows."""
    from checks import inputs as derived

    base = [(k, None if k % 17 == 0 else 1704067200000000 + (k * 7919 % 400) * 1_000_000 * (k % 3)) for k in range(300)]
    base += [(None, 1704067200000000), (None, None), *base[:20]]
    jobs_base = spark.createDataFrame(base, "event_id long, us long")
    jobs_base.createOrReplaceTempView("numbered_jobs_base")
    plain = spark.sql(
        "select us, event_id % 3 as rid, row_number() over (partition by event_id % 3 order by us, event_id) as k from numbered_jobs_base"
    )
    found = derived.numbered(jobs_base, 3)
    assert found.schema.simpleString() == plain.schema.simpleString()
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(rid" in plan and ", minute" in plan.split("row_number()")[1]
    for name in ("reservation_changes", "capacity_commitment_changes"):
        assert derived.NUMBERED.search(derived.TEXTS[name])

    jobs = spark.createDataFrame(
        [("a", "p", "r", "QUERY", None, 5, 6, 1704067200500000, 4500, 9001), ("b", "p", None, None, "SELECT", None, 7, 1704067201000000, 0, None)],
        "job_id string, project_id string, reservation_id string, job_type string, statement_type string, total_bytes_billed long, "
        "total_bytes_processed long, us long, dur_ms long, total_slot_ms long",
    )
    texts = [derived.TEXTS["jobs_timeline"], derived.SPARK_TEXTS["jobs_timeline"]]
    for k, text in enumerate(texts):
        for token, value in derived.DIALECTS["spark"].items():
            text = text.replace(token, value)
        texts[k] = spark.sql(text.replace("from jobs", "from {jobs}"), jobs=jobs)
    assert texts[0].schema.simpleString() == texts[1].schema.simpleString()
    assert texts[0].exceptAll(texts[1]).count() == texts[1].exceptAll(texts[0]).count() == 0 and texts[1].count() == 6
