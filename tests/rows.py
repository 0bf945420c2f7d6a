"""Hand-made metadata rows: defaults for every column, overridden per row."""

from datetime import datetime, timedelta, timezone

from slotledger import schemas

NOON = datetime(2024, 1, 3, 12, tzinfo=timezone.utc)
AS_OF = "2024-01-04 00:00:00"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def table(spark, name, *rows, **defaults):
    schema = schemas.TABLES[name]
    unknown = {k for r in rows for k in r} - set(schema.names)
    assert not unknown, unknown
    data = [tuple({**defaults, **row}.get(n) for n in schema.names) for row in rows]
    return spark.createDataFrame(data, schema)


def jobs(spark, *rows, **changes):
    defaults = dict(
        job_id="j", user_email="u@x", project_id="p", reservation_id="adm:US.r", state="DONE", job_type="QUERY",
        statement_type="SELECT", creation_time=NOON, start_time=NOON, end_time=NOON + timedelta(minutes=2),
        total_bytes_billed=10**9, total_bytes_processed=10**9, total_slot_ms=120000, cache_hit=False,
        error_result=None, query_info=(("h",),),
    )
    numbered = [{"job_id": f"j{n}", **row} for n, row in enumerate(rows)]
    return table(spark, "jobs", *numbered, **{**defaults, **changes})


def seconds(spark, *rows, **changes):
    defaults = dict(
        period_start=NOON, job_id="j", project_id="p", reservation_id="adm:US.r", job_type="QUERY",
        statement_type="SELECT", period_slot_ms=1000, total_bytes_billed=60, total_bytes_processed=60,
    )
    return table(spark, "jobs_timeline", *rows, **{**defaults, **changes})


def changes(spark, *rows):
    """Rows of (time, action, autoscaled, baseline) for one reservation, or with a fifth name."""
    full = [
        dict(change_timestamp=at(r[0]), action=r[1], autoscale=(r[2],), slot_capacity=r[3],
             reservation_name=r[4] if len(r) > 4 else "r")
        for r in rows
    ]
    return table(spark, "reservation_changes", *full, project_id="adm", edition="ENTERPRISE")


def commitments(spark, *rows):
    full = [dict(change_timestamp=at(r[0]), action=r[1], slot_count=r[2]) for r in rows]
    return table(
        spark, "capacity_commitment_changes", *full, capacity_commitment_id="c", state="ACTIVE", edition="ENTERPRISE"
    )


def dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]


def one(df):
    rows = dicts(df)
    assert len(rows) == 1, rows
    return rows[0]
