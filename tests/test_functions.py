import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from slotledger.functions import costs, ids, times
from slotledger.functions.rounding import round_columns, to_nearest
from slotledger.operators import quantiles
from slotledger.session import require_utc
from tests.rows import at


def values(spark, xs, kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"x {kind}")


def test_rounding_follows_the_stored_value(spark):
    rng = random.Random(5)
    xs = [0.125, 0.375, 2.675, 1.005, 0.015, 2.5, -0.125, -2.675, 0.0, 1e17 + 2, 0.005, 1e-9, 4503599627370497.5]
    xs += [rng.randrange(-10**7, 10**7) / 1000 for _ in range(2000)]
    xs += [rng.uniform(-1e9, 1e9) for _ in range(2000)]
    xs += [rng.randrange(10**6) / 2**rng.randrange(1, 12) for _ in range(2000)]
    for digits in (0, 2, 3, 4):
        df = values(spark, xs).withColumn("r", F.col("x"))
        got = [r.r for r in round_columns(df, {"r": digits}).collect()]
        assert got == [float(round(x, digits)) for x in xs]


def test_nearest_fifty_takes_the_even_multiple(spark):
    xs = [0.0, 24.9, 25.0, 75.0, 125.0, 126.0, 1e6 + 25]
    got = [r[0] for r in values(spark, xs).select(to_nearest(F.col("x"), 50)).collect()]
    assert got == [int(round(x / 50.0) * 50) for x in xs] == [0, 0, 0, 100, 100, 150, 1000000]


@pytest.mark.parametrize("given, short, shown, admin, clean", [
    ("adm:US.res", "res", "res", "adm", "res"),
    ("adm:res", "res", "adm:res", "adm", "res"),
    ("US.res", "res", "res", None, "res"),
    ("res", "res", "res", None, "res"),
    ("a.b:US.r", "r", "r", "a", "r"),
    (":US.r", "r", "r", "", "r"),
    (".x:r", "x:r", "x:r", "", "r"),
    (None, None, None, None, None),
])
def test_reservation_ids(spark, given, short, shown, admin, clean):
    x = F.col("x")
    row = values(spark, [given], "string").select(
        ids.short_id(x), ids.display_id(x), ids.admin_project(x), ids.clean_id(x), ids.names_admin_project(x)
    ).first()
    assert tuple(row) == (short, shown, admin, clean, None if given is None else bool(admin))


def test_iso_text_over_a_clock_change(spark):
    stamps = [at("2024-11-03 05:30:00"), at("2024-11-03 06:30:00"), at("2024-07-01 00:00:00")]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp")
    got = [r[0] for r in df.select(times.iso_text(F.col("ts"), "America/New_York")).collect()]
    assert got == ["2024-11-03T01:30:00-04:00", "2024-11-03T01:30:00-05:00", "2024-06-30T20:00:00-04:00"]
    assert df.select(times.iso_text(F.col("ts"))).first()[0] == "2024-11-03T05:30:00+00:00"


def test_unknown_zone_is_an_error():
    with pytest.raises(ValueError, match="Invalid timezone: Mars/Base"):
        times.checked_zone("Mars/Base")


def test_sessions_in_other_zones_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="must be UTC"):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_instants_are_utc_unless_they_say_otherwise(spark):
    given = ["2024-01-04 00:00:00", "2024-01-04T02:00:00+02:00", datetime(2024, 1, 4)]
    row = spark.range(1).select(*[F.unix_seconds(times.instant(g)) for g in given]).first()
    assert set(row) == {1704326400}


@pytest.mark.parametrize("now, first, last", [
    ("2024-03-31 23:00:00", date(2024, 2, 1), date(2024, 2, 29)),
    ("2024-01-01 00:00:00", date(2023, 12, 1), date(2023, 12, 31)),
])
def test_previous_month(spark, now, first, last):
    assert tuple(spark.range(1).select(*times.previous_month(now)).first()) == (first, last)


def test_whole_units_truncate(spark):
    df = spark.createDataFrame([(at("2024-01-01 00:00:00.900"), at("2024-01-01 00:00:02.800"))], "a timestamp, b timestamp")
    found = df.select(times.whole_seconds(F.col("a"), F.col("b")), times.whole_milliseconds(F.col("a"), F.col("b")))
    assert tuple(found.first()) == (1, 1900)


@pytest.mark.parametrize("peak, limit", [(None, 1000), (0.0, 1000), (0.1, 500), (500.0, 500), (500.1, 1000)])
def test_suggested_maximum(spark, peak, limit):
    assert values(spark, [peak]).select(costs.suggested_maximum(F.col("x"))).first()[0] == limit


def test_shown_text(spark):
    texts = ["a" * 500, "a" * 501, None, ""]
    got = [r[0] for r in values(spark, texts, "string").select(costs.shown_text(F.col("x"))).collect()]
    assert got == ["a" * 500, "a" * 500 + "...", "Query text not found", ""]


def test_advice(spark):
    pairs = [(104857599.0, 4.9), (104857600.0, 4.9), (0.0, 5.0), (0.0, None)]
    df = spark.createDataFrame(pairs, "b double, s double")
    advice = costs.short_query_advice(F.col("b"), F.col("s"))
    assert [r[0] for r in df.select(costs.advice_badge(advice)).collect()] == ["Candidate", "N/A", "N/A", "N/A"]


def test_exact_percentiles_match_sorting(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0, 1, 5, rng.randrange(10**9)])) for _ in range(5000)]
    rows += [("one", 7), ("null", None), ("tie", 2), ("tie", 2)] + [("small", n) for n in range(10)]
    df = spark.createDataFrame(rows, "k string, v long")
    percents = {"p0": 0, "p50": 50, "p90": 90, "p99": 99, "p100": 100}
    got = {r["k"]: r for r in quantiles.exact(df, "k", "v", percents).collect()}
    assert "null" not in got
    for key in ("hot", "one", "tie", "small"):
        ordered = sorted(v for k, v in rows if k == key)
        for name, percent in percents.items():
            assert got[key][name] == ordered[max(-(-len(ordered) * percent // 100), 1) - 1]


def test_sketch_is_close_on_a_long_group(spark):
    df = spark.range(200000).select(F.col("id").alias("v"))
    low, high = df.agg(quantiles.sketch("v", [90, 99]).alias("q")).first()["q"]
    assert abs(low - 180000) <= 40 and abs(high - 198000) <= 40
