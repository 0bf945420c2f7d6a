import math
import random
from datetime import timedelta

import pytest

from slotledger.params import MatrixParams
from slotledger.plans import matrix
from tests.rows import AS_OF, NOON, dicts, seconds


def usage(spark, minute_ms):
    rows = [dict(period_start=NOON + timedelta(minutes=n), period_slot_ms=ms) for n, ms in enumerate(minute_ms)]
    return seconds(spark, *rows)


def naive(minute_ms, params):
    """By definition: a baseline serves the part of each minute below it, autoscaling the rest."""
    slots = [(ms or 0) / 60000 for ms in minute_ms]
    hours, step = params.lookback_days * 24.0, params.step_size
    bands = [math.ceil(a / step) for a in slots]
    for k in range(math.ceil(params.max_baseline / step) + 1):
        base = k * step
        served = sum(min(a, base) for a in slots) / 60
        monthly = (sum(slots) / 60 - served) * 730 / hours
        used = min(served, base * hours) / (base * hours) if base else 0.0
        yield base, bands.count(k), used * 100, monthly, monthly * params.payg_price + base * 730 * params.commit_3yr_price


@pytest.mark.parametrize("top, step", [(200, 10), (105, 10), (30, 50), (0, 50)])
def test_matches_the_naive_form(spark, top, step):
    rng = random.Random(top)
    minute_ms = [rng.choice([0, None, 60000 * 50, rng.randrange(60000 * 150)]) for _ in range(300)]
    params = MatrixParams(as_of=AS_OF, max_baseline=top, step_size=step)
    found = dicts(matrix.baseline_cost_matrix(usage(spark, minute_ms), params))
    expected = list(naive(minute_ms, params))
    assert [(r["slots"], r["minutes"]) for r in found] == [(e[0], e[1]) for e in expected]
    for row, (_, _, used, monthly, total) in zip(found, expected):
        assert row["utilization_pct"] == pytest.approx(used, abs=0.0051)
        assert row["autoscale_slot_hours"] == pytest.approx(monthly, abs=0.51)
        assert row["total_3yr"] == pytest.approx(total, abs=0.0051)


def test_bands_and_the_minutes_above_them_cover_all_minutes(spark):
    minute_ms = [0, 60000 * 50, 60000 * 50 + 1, 60000 * 100, 60000 * 1000]
    params = MatrixParams(as_of=AS_OF, max_baseline=100)
    bands = matrix.band_histogram(matrix.minute_usage(usage(spark, minute_ms), params), params)
    assert [r["minutes"] for r in dicts(bands.orderBy("k"))] == [1, 1, 2, 1]
    found = dicts(matrix.baseline_cost_matrix(usage(spark, minute_ms), params))
    assert [r["bucket"] for r in found] == ["[0 → 0]", "[0 → 50]", "[50 → 100]"]
    assert [r["minutes"] for r in found] == [1, 1, 2]


def test_utilization_falls_as_the_baseline_rises(spark):
    rng = random.Random(1)
    rows = usage(spark, [rng.randrange(60000 * 400) for _ in range(500)])
    found = dicts(matrix.baseline_cost_matrix(rows, MatrixParams(as_of=AS_OF, max_baseline=1000)))
    shares = [r["utilization_pct"] for r in found[1:]]
    assert shares == sorted(shares, reverse=True)
    over = [r["autoscale_slot_hours"] for r in found]
    assert over == sorted(over, reverse=True)


def test_no_usage_gives_no_matrix(spark):
    found = matrix.baseline_cost_matrix(seconds(spark), MatrixParams(as_of=AS_OF))
    assert dicts(found) == []
    assert dicts(matrix.best_baseline_per_plan(found)) == []


def test_best_baseline_takes_the_larger_of_equal_costs(spark):
    rows = [(0, 5.0, 9.0, 1.0, 7.0), (50, 4.0, 8.0, 1.0, 6.0), (100, 4.0, 9.0, 2.0, 5.0)]
    columns = "slots long, total_payg double, total_1yr double, total_3yr double, autoscale_slot_months double"
    found = dicts(matrix.best_baseline_per_plan(spark.createDataFrame(rows, columns)))
    assert [(r["plan"], r["slots"], r["cost"], r["autoscale_slot_months"]) for r in found] == [
        ("PAYG (0 Commit)", 100, 4.0, 5.0), ("1 Year Commit", 50, 8.0, 6.0), ("3 Year Commit", 50, 1.0, 6.0)
    ]
