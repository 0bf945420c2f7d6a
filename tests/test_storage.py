import pytest
from pyspark.sql import functions as F

from slotledger.params import StorageParams
from slotledger.plans import storage
from tests.rows import dicts, one, table

G = 1024**3


def tables(spark, *rows):
    return table(spark, "table_storage", *rows, project_id="p", table_schema="d", total_physical_bytes=1)


def options(spark, *rows):
    return table(spark, "schemata_options", *rows, option_name="storage_billing_model", option_value="PHYSICAL")


def test_forecast_of_one_dataset(spark):
    found = one(storage.storage_forecast(
        tables(
            spark,
            dict(active_logical_bytes=100 * G, long_term_logical_bytes=50 * G, active_physical_bytes=30 * G,
                 time_travel_physical_bytes=10 * G, fail_safe_physical_bytes=5 * G, long_term_physical_bytes=20 * G),
        ),
        StorageParams(time_travel_rescale=0.5),
    ))
    assert found["forecast_logical"] == pytest.approx(100 * 0.02 + 50 * 0.01)
    assert found["forecast_physical"] == pytest.approx((30 - 10) * 0.04 + 5 * 0.04 + 5 * 0.04 + 20 * 0.02)


def test_null_bytes_count_as_zero_and_empty_tables_are_left_out(spark):
    df = tables(spark, dict(active_logical_bytes=G), dict(active_logical_bytes=7 * G, total_physical_bytes=0),
                dict(active_logical_bytes=7 * G, total_physical_bytes=None))
    found = one(storage.storage_forecast(df))
    assert found["forecast_logical"] == pytest.approx(0.02)
    assert found["forecast_physical"] == 0


def dearer_logical(saving_gib=100):
    return dict(active_logical_bytes=2 * saving_gib * G, active_physical_bytes=0)


def test_only_the_dearer_model_is_reported(spark):
    df = tables(spark, dict(table_schema="a", **dearer_logical()), dict(table_schema="b", **dearer_logical()))
    found = dicts(storage.storage_recommendations(df, options(spark, dict(project_id="p", schema_name="b"))))
    assert [(r["dataset_name"], r["currently_on"], r["better_on"]) for r in found] == [("a", "logical", "physical")]
    assert found[0]["monthly_savings_pct"] == 1.0
    assert found[0]["ddl"] == "ALTER SCHEMA `p.a` SET OPTIONS(storage_billing_model='physical' );"


def test_membership_needs_project_and_dataset(spark):
    df = tables(spark, dict(table_schema="a", **dearer_logical()))
    other = options(spark, dict(project_id="q", schema_name="a"), dict(project_id="p", schema_name="a", option_name="x"))
    assert one(storage.storage_recommendations(df, other))["currently_on"] == "logical"


def test_savings_equal_to_the_minimum_are_dropped(spark):
    df = tables(spark, dearer_logical())
    none = options(spark)
    saving = one(storage.storage_recommendations(df, none))["monthly_savings"]
    assert not dicts(storage.storage_recommendations(df, none, StorageParams(min_monthly_saving=saving)))
    assert not dicts(storage.storage_recommendations(df, none, StorageParams(min_monthly_saving_pct=1.0)))
    assert dicts(storage.storage_recommendations(df, none, StorageParams(min_monthly_saving_pct=0.999)))


def test_physical_dataset_without_cost_gives_no_division_by_zero(spark):
    # on physical at no cost; equal forecasts prefer logical, and a saving of 0 is not above the minimum
    df = tables(spark, dict(active_logical_bytes=0))
    on = options(spark, dict(project_id="p", schema_name="d"))
    assert not dicts(storage.storage_recommendations(df, on))
    assert not dicts(storage.storage_recommendations(df, on, StorageParams(min_monthly_saving=-1.0)))


def test_time_travel_hours_in_statement(spark):
    df = tables(spark, dearer_logical())
    found = one(storage.storage_recommendations(df, options(spark), StorageParams(time_travel_hours=168)))
    assert found["ddl"].endswith("storage_billing_model='physical', max_time_travel_hours=168.0);")


def test_kpis_of_nothing(spark):
    empty = storage.storage_recommendations(tables(spark), options(spark))
    assert one(storage.storage_kpis(empty)) == dict(total_savings=0.0, datasets=0, opportunities=0)


@pytest.mark.parametrize("value, model, optimal", [
    ([], "LOGICAL", False), (["PHYSICAL"], "PHYSICAL", True), (["LOGICAL"], "LOGICAL", False), ([None], None, False),
])
def test_org_status(spark, value, model, optimal):
    rows = [dict(option_name="default_storage_billing_model", option_value=v) for v in value]
    df = table(spark, "organization_options", *rows, dict(option_name="other", option_value="PHYSICAL"))
    found = one(storage.org_storage_status(df))
    assert (found["current_model"], found["is_optimized"]) == (model, optimal)
    assert (found["ddl"] is None) == optimal


def test_savings_are_the_gap_between_the_forecasts(inputs):
    off = storage.storage_recommendations(inputs.table_storage, inputs.schemata_options).filter(
        F.abs(F.col("monthly_savings") - F.abs(F.col("forecast_logical") - F.col("forecast_physical"))) > 1e-9
    )
    assert off.count() == 0
