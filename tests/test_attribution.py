import json

import pytest
from pyspark.sql import functions as F

from slotledger.params import AttributionParams
from slotledger.plans.attribution import cost_attribution, priced_reservations, project_usage
from slotledger.sources.config import read_rates, with_rule
from tests.rows import at, dicts, jobs, one

JANUARY = AttributionParams("2024-01-01", "2024-01-31")
HOUR = 3600000


def rates(spark, *rows, rule="A", central=None):
    plain = spark.createDataFrame(list(rows), "reservation_key string, sku_rate double, total_admin_bill double")
    return with_rule(plain, rule, central)


def use(project, hours, reservation="adm:US.r", **kw):
    return dict(project_id=project, total_slot_ms=None if hours is None else int(hours * HOUR), reservation_id=reservation, **kw)


def charged(df):
    return {
        (r["project_id"], r["reservation_id"]): (
            r["direct_usage_cost_usd"], r["allocated_waste_cost_usd"], r["total_cost_attribution_usd"]
        )
        for r in dicts(df)
    }


def test_waste_is_shared_by_usage(spark):
    df = jobs(spark, use("a", 30), use("b", 10))
    assert charged(cost_attribution(df, rates(spark, ("r", 1.0, 100.0)), JANUARY)) == {
        ("a", "adm:US.r"): (30.0, 45.0, 75.0), ("b", "adm:US.r"): (10.0, 15.0, 25.0)
    }


def test_bill_below_usage_leaves_no_waste(spark):
    df = jobs(spark, use("a", 30))
    assert charged(cost_attribution(df, rates(spark, ("r", 1.0, 10.0)), JANUARY))["a", "adm:US.r"] == (30.0, 0.0, 30.0)


def test_central_project_takes_the_waste(spark):
    df = jobs(spark, use("a", 30), use("b", 10))
    rule_b = cost_attribution(df, rates(spark, ("r", 1.0, 100.0), rule="B", central="it"), JANUARY)
    assert charged(rule_b) == {
        ("a", "adm:US.r"): (30.0, 0.0, 30.0), ("b", "adm:US.r"): (10.0, 0.0, 10.0), ("it", "adm:US.r"): (0.0, 60.0, 60.0)
    }
    for central in (None, ""):
        lost = cost_attribution(df, rates(spark, ("r", 1.0, 100.0), rule="B", central=central), JANUARY)
        assert set(charged(lost)) == {("a", "adm:US.r"), ("b", "adm:US.r")}
    no_waste = cost_attribution(df, rates(spark, ("r", 1.0, 40.0), rule="B", central="it"), JANUARY)
    assert ("it", "adm:US.r") not in charged(no_waste)
    unknown = cost_attribution(df, rates(spark, ("r", 1.0, 100.0), rule="C", central="it"), JANUARY)
    assert sum(v[1] for v in charged(unknown).values()) == 0


def test_both_rules_charge_the_same_total(inputs):
    params = AttributionParams("2024-01-01", "2024-01-03")
    totals = []
    for rule, central in (("A", None), ("B", "it")):
        found = cost_attribution(inputs.jobs, with_rule(inputs.attribution_config, rule, central), params)
        totals.append(found.agg(F.sum("total_cost_attribution_usd")).first()[0])
    assert totals[0] == pytest.approx(totals[1], abs=0.5)


def test_direct_and_waste_add_up_to_the_bill(inputs):
    found = cost_attribution(
        inputs.jobs, with_rule(inputs.attribution_config), AttributionParams("2024-01-01", "2024-01-03")
    ).filter("reservation_id = 'admin-a:US.res-a'")
    assert found.agg(F.sum("total_cost_attribution_usd")).first()[0] == pytest.approx(4800.02, abs=0.1)


def test_short_id_is_tried_before_the_full_id(spark):
    df = jobs(spark, use("a", 10), use("a", 10, "adm:x"), use("a", 10, "full:US.y"), use("a", 10, "bare"), use("a", 10, "none"))
    found = priced_reservations(
        project_usage(df, JANUARY),
        rates(spark, ("r", 1.0, 0.0), ("adm:US.r", 9.0, 0.0), ("x", 2.0, 0.0), ("full:US.y", 3.0, 0.0), ("bare", 4.0, 0.0)),
    )
    assert {r["reservation_id"]: r["sku_rate"] for r in dicts(found)} == {
        "adm:US.r": 1.0, "adm:x": 2.0, "full:US.y": 3.0, "bare": 4.0
    }


def test_usage_rules(spark):
    df = jobs(
        spark, use("first", 1, creation_time=at("2024-01-01 00:00:00")), use("last", 1, creation_time=at("2024-01-31 23:59:59.999999")),
        use("before", 1, creation_time=at("2023-12-31 23:59:59")), use("after", 1, creation_time=at("2024-02-01 00:00:00")),
        use("script", 1, statement_type="SCRIPT"), use("null_type", 1, statement_type=None), use("load", 1, job_type="LOAD"),
        use("none", 1, reservation=None),
    )
    assert {r["project_id"] for r in dicts(project_usage(df, JANUARY))} == {"first", "last"}
    assert {r["project_id"] for r in dicts(project_usage(df, AttributionParams(as_of="2024-02-10")))} == {"first", "last"}


def test_no_usage_on_a_reservation(spark):
    # a NULL sum counts as zero, and shares of nothing are zero
    df = jobs(spark, use("a", None), use("b", 0))
    found = charged(cost_attribution(df, rates(spark, ("r", 1.0, 100.0)), JANUARY))
    assert found == {("a", "adm:US.r"): (0.0, 0.0, 0.0), ("b", "adm:US.r"): (0.0, 0.0, 0.0)}
    assert dicts(cost_attribution(jobs(spark), rates(spark, ("r", 1.0, 100.0)), JANUARY)) == []


CONFIG = {
    "waste_rule": "B", "central_cost_center_project": "it", "borrowing_rule": "lender_pays",
    "reservations": {"r": {"sku_rate": 0.5, "total_admin_bill": 10.0}, "s": {"sku_rate": 1, "total_admin_bill": 2}},
}


def written(tmp_path, content):
    path = tmp_path / "config.json"
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=2))
    return str(path)


def test_config_file(spark, tmp_path):
    found = dicts(read_rates(spark, written(tmp_path, CONFIG)).orderBy("reservation_key"))
    assert found[0] == dict(reservation_key="r", sku_rate=0.5, total_admin_bill=10.0, waste_rule="B", central_project="it")
    assert (found[1]["sku_rate"], found[1]["total_admin_bill"]) == (1.0, 2.0)
    df = jobs(spark, use("a", 4))
    assert charged(cost_attribution(df, read_rates(spark, written(tmp_path, CONFIG)), JANUARY))["it", "adm:US.r"][1] == 8.0


def test_config_defaults(spark, tmp_path):
    assert dicts(read_rates(spark, str(tmp_path / "missing.json"))) == []
    assert dicts(read_rates(spark, written(tmp_path, "{not json"))) == []
    broken = {"reservations": {"r": {"sku_rate": 0.5}}}
    assert dicts(read_rates(spark, written(tmp_path, broken))) == []
    assert dicts(read_rates(spark, written(tmp_path, {"waste_rule": "B"}))) == []
    text_rate = {"reservations": {"r": {"sku_rate": "much", "total_admin_bill": 1}}}
    assert dicts(read_rates(spark, written(tmp_path, text_rate))) == []
    plain = {"reservations": {"r": {"sku_rate": 0.5, "total_admin_bill": 1.0}}}
    assert one(read_rates(spark, written(tmp_path, plain)))["waste_rule"] == "A"
