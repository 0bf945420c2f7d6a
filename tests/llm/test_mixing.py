"""Mixing against the definition: water filling by rounds, copies by whole numbers crossed."""

import math
import re

import pytest
from pyspark.sql import functions as F

from slotledger.llm import mixing
from slotledger.llm.queries import op13_systematic_mix
from tests.conftest import SF_DIR
from tests.llm.rows import CLASHING, words


def rows_of(spark, rows):
    """Documents of (doc_id, source, text) with columns whose names the operator uses inside."""
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "size", "copies", "weight", "target", "_rate"]})


def levels(sizes, weights=(5, 2, 1), most=3):
    """Targets by rounds: what stops at its limit leaves the rest to the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), sum(sizes.values())
    while free:
        share = sum(weight[s] for s in free)
        stop = {s for s in free if most * sizes[s] * share <= weight[s] * rest}
        if not stop:
            return out | {s: weight[s] * rest / share for s in free}
        out |= {s: float(most * sizes[s]) for s in stop}
        rest -= sum(most * sizes[s] for s in stop)
        free -= stop
    return out


def checked(mixed, docs):
    """Sizes, targets and copies of a mix against its documents."""
    sizes, longest = {}, {}
    for _, source, text in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        longest[source] = max(longest.get(source, 0), n)
    want, taken = levels(sizes), dict.fromkeys(sizes, 0)
    have = mixed.collect()
    assert len(have) == len(docs)
    for row in have:
        assert row.source_size == sizes[row.source] and math.isclose(row.target, want[row.source], rel_tol=1e-12)
        assert 0 <= row.copies <= 3
        rate = row.target / row.source_size if row.source_size else 0
        assert math.floor(rate) <= row.copies <= math.ceil(rate)
        taken[row.source] += row.copies * row.size
    for source, n in taken.items():
        assert abs(n - want[source]) <= longest[source]
    return sorted((tuple(r) for r in have), key=str)


SAMPLES = {
    "hot": [(k, "b" if k % 3 else f"s{k % 11}", words(k, 1 + k % 40)) for k in range(400)],
    "awkward": [
        (1, None, "a b"), (2, None, None), (3, "", "c\x85d e"), (None, "é", words(1, 9)), (None, "é", words(1, 9)), (4, "z", ""),
        (5, "𝔸", words(2, 50)), (5, "𝔸", words(3, 50)), (6, "￿", "x" * 9000), (7, "z", " \t\n"),
    ],
    "one source": [(k, "a", words(k, 20)) for k in range(30)],
    "no words": [(k, "ab"[k % 2], None) for k in range(4)],
    "copies": [(k, "a" if k < 250 else f"s{k % 7}", "same text of five words") for k in range(300)],
    "one large": [(k, "a", words(k, 2000 if k == 0 else 5)) for k in range(50)] + [(99, "b", words(1, 3))],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_targets_and_copies(spark, name):
    docs = SAMPLES[name]
    assert checked(mixing.mix(rows_of(spark, docs)), docs) == checked(mixing.mix(rows_of(spark, docs[::-1]).repartition(3)), docs)


def test_many_sources_are_numbered_over_ranges(spark):
    docs = [(k, f"s{k * 7919 % 1000}", words(k, 1 + k % 13)) for k in range(1500)]
    checked(mixing.mix(rows_of(spark, docs)), docs)


def test_weights_and_limit_are_parameters(spark):
    docs = SAMPLES["hot"]
    mixed = mixing.mix(rows_of(spark, docs), mixing.MixParams(weights=(1,), most=1, seed="other"))
    assert {r.copies for r in mixed.collect()} == {1}


def test_empty_table(spark):
    assert mixing.mix(rows_of(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(rows_of(spark, SAMPLES["hot"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["hot", "awkward"])
def test_emitted_rows_are_the_copies(spark, name):
    docs = rows_of(spark, SAMPLES[name])
    mixed = mixing.mix(docs)
    rows = mixing.emitted(docs, mixed)
    assert rows.columns == [*docs.columns, "copy"]
    assert rows.count() == sum(r.copies for r in mixed.collect())
    assert all(r.copy <= 6 for r in rows.collect())


def test_query_keeps_the_definition_on_the_samples(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "text").collect()]
    mixed = op13_systematic_mix(spark, SF_DIR)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.floor(F.col("target") / F.col("source_size")))
    checked(mixed.withColumn("copies", copies.cast("long")), docs)
