"""The first rows of an order, few and many."""

import pytest
from pyspark.sql import functions as F

from slotledger.operators import topk


def values(spark, kind):
    number = {
        "spread": F.col("id") * 7919 % 100_003 - 50_000,
        "ties": F.col("id") % 3,
        "equal": F.lit(5),
        "wide": F.when(F.col("id") % 5 == 0, -1).otherwise(1) * F.pow(F.lit(2.0), F.col("id") % 63).cast("long"),
        "nulls": F.when(F.col("id") % 4 > 0, F.col("id") % 1000),
    }[kind]
    return spark.range(5000).select("id", number.cast("long").alias("v"), F.lit("x").alias("_bin_like"))


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "wide", "nulls"])
@pytest.mark.parametrize("n", [1, 700, 4999, 5000, 9000])
def test_many_rows_are_those_of_a_sort(spark, monkeypatch, kind, n):
    df = values(spark, kind)
    monkeypatch.setattr(topk, "MERGED_ROWS", 0)
    found = topk.most(df, "v", ["id"], n)
    assert found.columns == df.columns
    want = df.orderBy(F.desc_nulls_last("v"), "id").limit(n).collect()
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want)


def test_a_million_rows_need_no_single_task(spark):
    df = spark.range(3_000_000).select("id", (F.col("id") * 7919 % 1_000_003).alias("v"))
    found = topk.most(df, "v", ["id"], 1_000_000)
    assert found.count() == 1_000_000
    assert found.agg(F.min("v")).first()[0] == df.orderBy(F.desc("v"), "id").limit(1_000_000).agg(F.min("v")).first()[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    # what meets in one task are counts: of bins, and of blocks
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    for n, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert any("Aggregate" in after for after in lines[n + 1:n + 4])


def test_empty(spark, monkeypatch):
    monkeypatch.setattr(topk, "MERGED_ROWS", 0)
    assert topk.most(values(spark, "spread").where("id < 0"), "v", ["id"], 10).collect() == []
