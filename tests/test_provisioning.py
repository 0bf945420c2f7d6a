import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from slotledger.operators.blocks import BLOCK, asof_backward, in_blocks, lag_row, running_steps
from slotledger.operators.grids import repeated
from slotledger.params import ProvisioningParams, UtilizationParams
from slotledger.plans import provisioning
from tests.rows import AS_OF, at, changes, commitments, dicts, one, seconds

PARAMS = ProvisioningParams(as_of=AS_OF, lookback_days=1)


def timeline(spark, log, committed=(), params=PARAMS):
    found = provisioning.provisioning_timeline(changes(spark, *log), commitments(spark, *committed), params)
    found = provisioning.repeated_timeline(found)
    return [
        (f"{r['change_timestamp']:%d %H:%M:%S}", f"{r['end_timestamp']:%d %H:%M:%S}",
         r["current_slots"], r["baseline_slots"], r["capacity_slots"])
        for r in dicts(found.orderBy("change_timestamp", "end_timestamp"))
    ]


def hours(spark, log, committed=()):
    steps = provisioning.provisioning_steps(changes(spark, *log), commitments(spark, *committed), PARAMS)
    return one(provisioning.provisioned_slot_hours(steps))


def test_empty_logs_give_the_two_ends(spark):
    assert timeline(spark, []) == [("03 00:00:00", "04 00:00:00", 0, 0, 0), ("04 00:00:00", "04 00:00:00", 0, 0, 0)]
    assert hours(spark, []) == dict(autoscaled_slot_hours=0.0, baseline_slot_hours=0.0, total_slot_hours=0.0,
                                    autoscaled_share=None, baseline_share=None)


def test_create_update_delete(spark):
    log = [
        ("2024-01-02 10:00:00", "CREATE", 100, 200),
        ("2024-01-03 06:00:00", "UPDATE", 150, 200),
        ("2024-01-03 12:00:00", "DELETE", 150, 200),
    ]
    assert timeline(spark, log) == [
        ("03 00:00:00", "03 06:00:00", 100, 200, 0), ("03 06:00:00", "03 12:00:00", 150, 200, 0),
        ("03 12:00:00", "04 00:00:00", 0, 0, 0), ("04 00:00:00", "04 00:00:00", 0, 0, 0),
    ]
    found = hours(spark, log)
    assert found["autoscaled_slot_hours"] == 100 * 6 + 150 * 6
    assert found["baseline_slot_hours"] == 200 * 12
    assert found["autoscaled_share"] == pytest.approx(1500 / 3900)


def test_commitments_cover_the_baseline(spark):
    log = [("2024-01-02 10:00:00", "CREATE", 0, 300)]
    committed = [("2024-01-02 10:00:00", "CREATE", 100), ("2024-01-03 12:00:00", "UPDATE", 500)]
    assert hours(spark, log, committed)["baseline_slot_hours"] == 200 * 12
    assert timeline(spark, log, committed)[1][2:] == (0, 300, 500)


def test_missing_levels(spark):
    log = [
        ("2024-01-03 01:00:00", "CREATE", None, 10),   # no level: nothing added
        ("2024-01-03 02:00:00", "UPDATE", 40, 10),     # no earlier level: the new one
        ("2024-01-03 03:00:00", "UPDATE", None, 10),   # level gone: the old one is taken away
        ("2024-01-03 04:00:00", "UPDATE", None, 10),
    ]
    assert [r[2] for r in timeline(spark, log)] == [0, 0, 40, 0, 0, 0]


def test_deletion_counts_once_and_other_actions_do_not(spark):
    log = [
        ("2024-01-03 01:00:00", "CREATE", 50, 0), ("2024-01-03 02:00:00", "DELETE", 50, 0),
        ("2024-01-03 03:00:00", "DELETE", 50, 0), ("2024-01-03 04:00:00", "RENAME", 50, 0),
    ]
    assert [r[2] for r in timeline(spark, log)] == [0, 50, 0, 0, 0, 0]


def test_update_after_deletion_takes_the_old_level_twice(spark):
    log = [
        ("2024-01-03 01:00:00", "CREATE", 50, 0), ("2024-01-03 02:00:00", "DELETE", 50, 0),
        ("2024-01-03 03:00:00", "UPDATE", 20, 0),
    ]
    assert [r[2] for r in timeline(spark, log)] == [0, 50, 0, -30, -30]


def test_equal_times_share_their_totals_and_multiply(spark):
    log = [("2024-01-03 06:00:00", "CREATE", 10, 0, "a"), ("2024-01-03 06:00:00", "CREATE", 20, 0, "b")]
    committed = [("2024-01-03 06:00:00", "CREATE", 5)]
    noon = ("03 06:00:00", "03 06:00:00", 30, 0, 5)
    assert timeline(spark, log, committed) == [
        ("03 00:00:00", "03 06:00:00", 0, 0, 0), noon, ("03 06:00:00", "04 00:00:00", 30, 0, 5),
        ("04 00:00:00", "04 00:00:00", 30, 0, 5),
    ]
    twice = timeline(spark, log, [*committed, ("2024-01-03 06:00:00", "UPDATE", 5)])
    assert twice.count(noon) == 3


def test_times_are_cut_to_seconds_after_the_next_time_is_taken(spark):
    log = [("2024-01-03 06:00:00.200", "CREATE", 10, 0), ("2024-01-03 06:00:00.900", "UPDATE", 20, 0)]
    assert timeline(spark, log)[1:3] == [
        ("03 06:00:00", "03 06:00:00", 10, 0, 0), ("03 06:00:00", "04 00:00:00", 20, 0, 0)
    ]


def test_edition_and_end_are_filtered_before_the_lag(spark):
    log = changes(spark, ("2024-01-03 01:00:00", "CREATE", 10, 0), ("2024-01-03 02:00:00", "UPDATE", 30, 0))
    other = log.withColumn("edition", F.when(F.col("action") == "CREATE", "STANDARD").otherwise("ENTERPRISE"))
    found = provisioning.reservation_deltas(other, PARAMS)
    # the update has no predecessor within its edition
    assert one(found)["current_delta"] == 30
    late = changes(spark, ("2024-01-04 00:00:00.000001", "CREATE", 10, 0))
    assert dicts(provisioning.reservation_deltas(late, PARAMS)) == []


def test_only_active_commitments_count(spark):
    log = commitments(spark, ("2024-01-03 01:00:00", "CREATE", 10), ("2024-01-03 02:00:00", "UPDATE", 30))
    pending = log.withColumn("state", F.when(F.col("action") == "CREATE", "PENDING").otherwise("ACTIVE"))
    assert one(provisioning.commitment_deltas(pending, PARAMS))["capacity_delta"] == 30


def test_long_logs_over_many_blocks(spark, many_blocks):
    """Levels of several reservations, replayed in order, against the timeline."""
    rng = random.Random(9)
    log, now = [], at("2023-12-30 00:00:00")
    while now < at("2024-01-03 23:00:00"):
        now += timedelta(seconds=rng.randrange(1, 4000))
        log.append((f"{now:%Y-%m-%d %H:%M:%S}", "UPDATE", rng.randrange(500), rng.randrange(300), rng.choice("abc")))
    found = timeline(spark, log, params=ProvisioningParams(as_of=AS_OF, lookback_days=2))
    levels, expected = {}, []
    for when, _, current, base, name in log:
        levels[name] = (current, base)
        total = tuple(sum(v[k] for v in levels.values()) for k in (0, 1))
        if when < "2024-01-02 00:00:00":
            before = total
        else:
            expected.append((when[8:], *total))
    expected = [("02 00:00:00", *before), *expected, ("04 00:00:00", *expected[-1][1:])]
    assert [(r[0], r[2], r[3]) for r in found] == expected
    assert [r[1] for r in found[:-1]] == [r[0] for r in found[1:]]


def test_utilization_takes_the_latest_change(spark):
    usage = seconds(
        spark, *[dict(period_start=at(f"2024-01-03 {t}")) for t in ("00:30:00", "06:00:10", "06:01:00", "23:59:00")]
    )
    log = changes(spark, ("2024-01-03 06:00:00.500", "CREATE", 10, 40), ("2024-01-03 06:00:00.900", "UPDATE", 20, 50))
    found = dicts(provisioning.utilization_vs_provisioned(
        usage, log, commitments(spark), UtilizationParams(as_of=AS_OF, timezone="UTC"), PARAMS
    ))
    assert [(r["timestamp"][11:16], r["baseline_slots"], r["current_slots"]) for r in found] == [
        ("00:30", 0, 0), ("06:00", 50, 20), ("06:01", 50, 20), ("23:59", 50, 20)
    ]
    # buckets before the span have nothing provisioned
    older = seconds(spark, dict(period_start=at("2024-01-02 12:00:00")))
    row = one(provisioning.utilization_vs_provisioned(
        older, log, commitments(spark), UtilizationParams(as_of=AS_OF, timezone="UTC"), PARAMS
    ))
    assert (row["baseline_slots"], row["current_slots"]) == (0, 0)


def random_times(rng, n, spread=40 * 3600):
    return [at("2024-01-01 00:00:00") + timedelta(seconds=rng.randrange(spread)) for _ in range(n)]


def test_asof_matches_brute_force(spark, many_blocks):
    rng = random.Random(4)
    left = [(n, rng.choice(["a", "b", "c", None]), t) for n, t in enumerate(random_times(rng, 300))]
    right = [(rng.choice(["a", "b", None]), t, n) for n, t in enumerate(random_times(rng, 60))]
    left += [(1000, "a", None), (1001, "a", at("2030-01-01 00:00:00")), (1002, "a", at("2000-01-01 00:00:00"))]
    right += [("a", None, 7), ("c", None, 8)]
    found = asof_backward(
        spark.createDataFrame(left, "id int, k string, t timestamp"),
        spark.createDataFrame(right, "k string, at timestamp, v int"),
        "t", "at", ["v"], by=["k"], sequence=["v"],
    )
    got = {r["id"]: r["v"] for r in found.collect()}
    assert len(got) == len(left)
    for key, k, t in left:
        seen = [(when, v) for kk, when, v in right if kk == k and when and t and when <= t]
        assert got[key] == (max(seen)[1] if seen else None)


def test_lag_matches_brute_force(spark, many_blocks):
    rng = random.Random(6)
    rows = [(n, rng.choice(["hot", "hot", "x", None]), t) for n, t in enumerate(random_times(rng, 300, 10 * 86400))]
    df = spark.createDataFrame(rows, "id int, k string, t timestamp")
    got = {r["id"]: r["before"] and r["before"]["id"] for r in lag_row(df, ["k"], ["t", "id"], ["id"], "before").collect()}
    for key, k, t in rows:
        earlier = [(when, other) for other, kk, when in rows if kk == k and (when, other) < (t, key)]
        assert got[key] == (max(earlier)[1] if earlier else None)


def test_running_steps_match_brute_force(spark, many_blocks):
    rng = random.Random(8)
    stamps = sorted(set(random_times(rng, 200)))
    rows = [(t, rng.randrange(-5, 9)) for t in stamps]
    got = running_steps(spark.createDataFrame(rows, "t timestamp, v long"), "t", ["v"], "later").orderBy("t").collect()
    total = 0
    for n, row in enumerate(got):
        total += rows[n][1]
        assert row["v"] == total
        assert (row["later"] is None) == (n == len(rows) - 1)
        if row["later"] is not None:
            assert row["later"] == got[n + 1]["t"]


def crowd(spark, n):
    """Logs with n creations each at one instant."""
    name = F.concat(F.lit("r"), F.col("id").cast("string"))
    reservation = changes(spark, ("2024-01-03 06:00:00", "CREATE", 2, 3)).drop("reservation_name")
    commitment = commitments(spark, ("2024-01-03 06:00:00", "CREATE", 1)).drop("capacity_commitment_id")
    ids = spark.range(n)
    return (
        ids.join(reservation).select(*reservation.columns, name.alias("reservation_name")),
        ids.join(commitment).select(*commitment.columns, name.alias("capacity_commitment_id")),
    )


def test_entries_at_one_instant_are_run_lengths(spark):
    """50,000 reservations and as many commitments at one time make 2.5 thousand million entries of the joined logs."""
    logs = crowd(spark, 50_000)
    rows = provisioning.provisioning_timeline(*logs, PARAMS).orderBy("change_timestamp").collect()
    assert [r.copies for r in rows] == [1, 50_000 * 50_000, 1]
    assert tuple(rows[1])[2:5] == (100_000, 150_000, 50_000)
    found = one(provisioning.provisioned_slot_hours(provisioning.provisioning_steps(*logs, PARAMS)))
    assert found["autoscaled_slot_hours"] == 100_000 * 18 and found["baseline_slot_hours"] == 100_000 * 18


def test_repeated_rows_come_in_chunks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 25), ("d", 10), ("e", 11)], "k string, n long")
    rows = sorted(tuple(r) for r in repeated(df, "n", "copy", chunk=10).select("k", "copy").collect())
    assert rows == sorted((k, c) for k, n in (("a", 1), ("c", 25), ("d", 10), ("e", 11)) for c in range(1, n + 1))
    big = spark.createDataFrame([("x", 3_000_000)], "k string, n long")
    assert repeated(big, "n", "copy").agg(F.count("*"), F.min("copy"), F.max("copy")).first()[:] == (3_000_000, 1, 3_000_000)


def crowded_log(spark, n):
    """Nine tenths of a log in one hour of one key, the rest over ten days and keys."""
    hot, second = F.col("id") % 10 < 9, F.col("id") * 7919 % 3600
    start = F.lit(1704067200)
    return spark.range(n).select(
        F.col("id").alias("id"), F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 31)).alias("k"),
        F.timestamp_seconds(F.when(hot, start + second).otherwise(start + F.col("id") * 104729 % 864000)).alias("t"),
    )


@pytest.fixture
def many_blocks(spark):
    """Small tables are one block otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("order", [["k", "t", "id"], ["t", "id"]])
def test_no_block_has_more_than_twice_its_share(spark, many_blocks, order):
    blocks = in_blocks(crowded_log(spark, 200_000), order)
    sizes = [r["count"] for r in blocks.groupBy(F.spark_partition_id().alias("task"), BLOCK).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) == 8
    assert max(sizes) <= 2 * 200_000 / 8
    # a block is one task, and blocks follow each other in the order
    assert blocks.select(F.spark_partition_id().alias("task"), BLOCK).distinct().count() == 8
    ends = blocks.groupBy(BLOCK).agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).orderBy(BLOCK).collect()
    assert all(a.high < b.low for a, b in zip(ends, ends[1:]))


def test_crowded_log_in_order(spark, many_blocks):
    log = crowded_log(spark, 4000)
    rows = sorted((r.k, r.t, r.id) for r in log.collect())
    before = {row[2]: (rows[n - 1][2] if n and rows[n - 1][0] == row[0] else None) for n, row in enumerate(rows)}
    got = lag_row(log, ["k"], ["t", "id"], ["id"], "before").collect()
    assert {r.id: r.before and r.before["id"] for r in got} == before
    changes_seen = log.where("id % 50 = 3").select("k", F.col("t").alias("at"), F.col("id").alias("v"))
    seen = asof_backward(log, changes_seen, "t", "at", ["v"], by=["k"], sequence=["v"]).collect()
    for r in seen:
        earlier = [(t, v) for k, t, v in rows if v % 50 == 3 and k == r.k and t <= r.t]
        assert r.v == (max(earlier)[1] if earlier else None)
    points = log.groupBy("t").agg(F.count("*").alias("n"))
    total = 0
    steps = running_steps(points, "t", ["n"], "later").orderBy("t").collect()
    counts = {}
    for _, t, _ in rows:
        counts[t] = counts.get(t, 0) + 1
    for row, later in zip(steps, [*steps[1:], None]):
        total += counts[row.t]
        assert (row.n, row.later) == (total, later and later.t)


def test_logs_of_several_admin_projects(spark):
    log = changes(spark, ("2024-01-03 01:00:00", "CREATE", 10, 0)).unionByName(
        changes(spark, ("2024-01-03 02:00:00", "CREATE", 5, 0)).withColumn("project_id", F.lit("other"))
    )
    both = provisioning.reservation_deltas(log, PARAMS)
    assert sorted(r["current_delta"] for r in dicts(both)) == [5, 10]
    named = ProvisioningParams(as_of=AS_OF, lookback_days=1, admin_project_id="other", org_project_id="adm")
    assert one(provisioning.reservation_deltas(log, named))["current_delta"] == 5
    fallback = ProvisioningParams(as_of=AS_OF, lookback_days=1, admin_project_id="", org_project_id="adm")
    assert one(provisioning.reservation_deltas(log, fallback))["current_delta"] == 10
