from datetime import timedelta

import pytest

from slotledger.params import TrickleParams
from slotledger.plans import trickle
from tests.rows import AS_OF, NOON, at, dicts, jobs, one, table

PARAMS = TrickleParams(as_of=AS_OF, min_hourly_queries=2)


def quick(n, seconds=1, **kw):
    start = NOON + timedelta(seconds=n)
    base = dict(creation_time=start, start_time=start, end_time=start + timedelta(seconds=seconds), total_slot_ms=10)
    return {**base, **kw}


def texts(spark, *rows):
    return table(spark, "jobs_text", *rows, project_id="p", creation_time=NOON)


def test_hours_above_the_minimum_only(spark):
    df = jobs(spark, *[quick(n) for n in range(3)], *[quick(n + 3600) for n in range(2)])
    found = one(trickle.trickle_hours(df, PARAMS))
    assert (found["hour_bucket"].hour, found["reservation_id"], found["hourly_queries"]) == (12, "adm:US.r", 3)


def test_default_limits(spark):
    many = [quick(n) for n in range(61)]
    assert one(trickle.trickle_hours(jobs(spark, *many), TrickleParams(as_of=AS_OF)))["hourly_queries"] == 61
    assert dicts(trickle.trickle_hours(jobs(spark, *many[:60]), TrickleParams(as_of=AS_OF))) == []
    heavy = jobs(spark, *many, total_slot_ms=None)
    assert dicts(trickle.trickle_hours(heavy.replace(10, 100000, ["total_slot_ms"]), TrickleParams(as_of=AS_OF))) == []


def test_projects_weigh_the_same(spark):
    # one slow job in its own project outweighs many fast ones: (1 + 9) / 2 is not below 5
    rows = [quick(n, project_id="fast") for n in range(50)] + [quick(99, seconds=9, project_id="slow")]
    assert dicts(trickle.trickle_hours(jobs(spark, *rows), PARAMS)) == []
    rows[-1] = quick(99, seconds=8, project_id="slow")
    assert one(trickle.trickle_hours(jobs(spark, *rows), PARAMS))["hourly_queries"] == 51


def test_jobs_without_an_end_count_but_have_no_duration(spark):
    rows = [quick(n) for n in range(3)] + [quick(5, end_time=None)]
    row = one(trickle.hourly_profile(trickle.reserved_queries(jobs(spark, *rows), PARAMS)))
    assert (row["query_count"], row["median_duration_seconds"]) == (4, 1)
    alone = [quick(n, end_time=None) for n in range(3)]
    assert dicts(trickle.trickle_hours(jobs(spark, *alone), PARAMS)) == []


def test_reservation_and_script_rules(spark):
    rows = [quick(0), quick(1, statement_type=None), quick(2, statement_type="SCRIPT"), quick(3, reservation_id=None),
            quick(4, job_type="LOAD")]
    row = one(trickle.hourly_profile(trickle.reserved_queries(jobs(spark, *rows), PARAMS)))
    assert row["query_count"] == 2


def test_summary_names_the_three_busiest_projects(spark):
    rows = [quick(n, project_id=p) for p, size in [("d", 5), ("a", 3), ("b", 3), ("c", 3)] for n in range(size)]
    rows += [quick(n + 3600, project_id="a") for n in range(3)]
    found = one(trickle.trickle_summary(jobs(spark, *rows), PARAMS))
    assert found == dict(reservation_id="adm:US.r", total_flagged_hours=2, peak_hourly_queries=14,
                         top_projects="a (6), d (5), b (3)", advice="Consider Baseline")


def test_summary_without_project_names(spark):
    df = jobs(spark, *[quick(n, project_id=None) for n in range(3)])
    found = one(trickle.trickle_summary(df, PARAMS))
    assert (found["total_flagged_hours"], found["top_projects"]) == (1, None)


def test_heatmap_has_every_cell(spark):
    flagged = spark.createDataFrame(
        [(at("2024-01-03 12:00:00"), 4), (at("2024-01-10 12:00:00"), 6), (at("2024-01-07 03:00:00"), 5)],
        "hour_bucket timestamp, hourly_queries long",
    )
    found = dicts(trickle.trickle_heatmap(flagged, TrickleParams(timezone="America/New_York")))
    assert len(found) == 168 and sum(r["queries"] for r in found) == 15
    busy = {(r["hour"], r["weekday"]): r["intensity"] for r in found if r["queries"]}
    # Wednesday 07:00, and Sunday 03:00 UTC is Saturday evening
    assert busy == {(7, 3): 1.0, (22, 6): 0.5}
    empty = dicts(trickle.trickle_heatmap(flagged.limit(0), TrickleParams()))
    assert len(empty) == 168 and {r["intensity"] for r in empty} == {0.0}


def test_top_queries(spark):
    rows = [quick(n, job_id=f"a{n}", query_info=(("h1",),)) for n in range(4)]
    rows += [quick(n, job_id=f"b{n}", query_info=None, seconds=6, total_bytes_processed=None) for n in range(3)]
    rows += [quick(n + 7200, job_id=f"c{n}", query_info=(("rare",),)) for n in range(2)]
    relaxed = TrickleParams(as_of=AS_OF, min_hourly_queries=2, max_median_seconds=7)
    found = dicts(trickle.trickle_top_queries(
        jobs(spark, *rows),
        texts(spark, dict(job_id="a0", query="x" * 600), dict(job_id="a0", project_id="other", query="no"), dict(job_id="a1", query="no")),
        relaxed,
    ))
    assert [(r["example_job_id"], r["frequency"]) for r in found] == [("a0", 4), ("b0", 3)]
    assert [r["query"] for r in found] == ["x" * 600, "Query text not found"]
    shown = dicts(trickle.with_display_columns(spark.createDataFrame([("x" * 600, "N/A", 1.0)], "query string, recommendation string, avg_bytes_processed double")))
    assert shown[0]["query"] == "x" * 500 + "..."
    assert [r["avg_duration_seconds"] for r in found] == [1.0, 6.0]
    assert [r["avg_bytes_processed"] for r in found] == [1e9, 0.0]
    assert {r["recommendation"] for r in found} == {"N/A"}


def test_top_queries_without_durations_give_no_advice(spark):
    rows = [quick(n, total_bytes_processed=1) for n in range(3)] + [
        quick(n, query_info=(("open",),), end_time=None, total_bytes_processed=1, job_id=f"z{n}") for n in range(2)
    ]
    found = dicts(trickle.with_display_columns(trickle.trickle_top_queries(jobs(spark, *rows), texts(spark), PARAMS)))
    assert [(r["badge"], r["avg_duration_seconds"]) for r in found] == [("Candidate", 1.0), ("N/A", 0.0)]


def test_repeated_and_missing_texts_keep_one_row(spark):
    df = jobs(spark, *[quick(n) for n in range(3)])
    twice = texts(spark, dict(job_id="j0", query="select 1"), dict(job_id="j0", query=None))
    assert one(trickle.trickle_top_queries(df, twice, PARAMS))["query"] in ("select 1", "Query text not found")
    null_text = texts(spark, dict(job_id="j0", query=None))
    assert one(trickle.trickle_top_queries(df, null_text, PARAMS))["query"] == "Query text not found"


@pytest.mark.parametrize("limit", [1, 3])
def test_number_of_queries(spark, limit):
    rows = [quick(n, query_info=((f"h{n}",),)) for n in range(5)]
    params = TrickleParams(as_of=AS_OF, min_hourly_queries=2, top_queries=limit)
    assert len(dicts(trickle.trickle_top_queries(jobs(spark, *rows), texts(spark), params))) == limit
