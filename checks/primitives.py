"""Single operators as checked queries: scans, filters, projections, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import AS_OF, Inputs, duckdb_sql
from checks.reports import (
    DELTAS_SQL, END, PROFILE_SQL, TRICKLE_PARAMS, USED_SQL, in_text, six_places,
)
from slotledger import params as p
from slotledger.functions import costs, ids, times
from slotledger.functions import predicates as only
from slotledger.functions.rounding import round_columns, to_nearest
from slotledger.operators import quantiles
from slotledger.operators.blocks import asof_backward, lag_row, running_steps
from slotledger.operators.topk import first_of_each, listed
from slotledger.plans import attribution, matrix, provisioning, slots, storage, trickle
from slotledger.sources.config import with_rule
from slotledger.sources.tables import chosen_scope, in_scope

COUNTED = "select project_id, count(*) as n, cast(sum(dur_ms) as bigint) as dur_ms from jobs where {where} group by all"


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy("project_id").agg(F.count("*").alias("n"), F.sum("dur_ms").alias("dur_ms"))


def job_filter(keep, where: str):
    """A predicate over jobs, compared by the rows it keeps in each project."""
    return (lambda i: counted(keep(i.jobs)), duckdb_sql(COUNTED.format(where=where), "jobs"))


def second_filter(keep, where: str):
    return (
        lambda i: keep(i.jobs_timeline).groupBy("project_id").agg(
            F.count("*").alias("n"), F.sum("period_slot_ms").alias("slot_ms")
        ),
        duckdb_sql(
            "select project_id, count(*) as n, cast(sum(period_slot_ms) as bigint) as slot_ms from jobs_timeline"
            f" where {where} group by all",
            "jobs_timeline",
        ),
    )


FILTERS = {
    "filter_lookback_strict": second_filter(
        lambda df: times.since(df, "period_start", "2024-01-03 00:00:05", 1),
        "period_start > timestamp '2024-01-02 00:00:05' and period_start <= timestamp '2024-01-03 00:00:05'",
    ),
    "filter_lookback_inclusive": second_filter(
        lambda df: times.since(df, "period_start", "2024-01-03 00:00:05", 1, inclusive=True),
        "period_start >= timestamp '2024-01-02 00:00:05' and period_start <= timestamp '2024-01-03 00:00:05'",
    ),
    "filter_billing_days": job_filter(
        lambda df: times.between_days(df, "creation_time", times.day("2024-01-02"), times.day("2024-01-02")),
        "creation_time >= timestamp '2024-01-02' and creation_time < timestamp '2024-01-03'",
    ),
    "filter_previous_month": job_filter(
        lambda df: times.between_days(df, "creation_time", *times.previous_month("2024-02-29 23:59:59")),
        "creation_time >= timestamp '2024-01-01' and creation_time < timestamp '2024-02-01'",
    ),
    "filter_queries": job_filter(lambda df: df.filter(only.is_query()), "job_type = 'QUERY'"),
    "filter_scripts_keeping_null": job_filter(
        lambda df: df.filter(only.not_script()), "statement_type <> 'SCRIPT' or statement_type is null"
    ),
    "filter_scripts_dropping_null": job_filter(
        lambda df: df.filter(only.known_not_script()), "statement_type <> 'SCRIPT'"
    ),
    "filter_done": job_filter(lambda df: df.filter(only.is_done()), "state = 'DONE'"),
    "filter_not_cached": job_filter(lambda df: df.filter(only.not_cached()), "coalesce(cache_hit, false) = false"),
    "filter_minimum_bytes": job_filter(
        lambda df: df.filter(only.billed_at_least(10485760)), "total_bytes_billed >= 10485760"
    ),
    "filter_on_reservation": job_filter(lambda df: df.filter(only.on_reservation()), "reservation_id is not null"),
    "scan_jobs_in_scope": job_filter(
        lambda df: in_scope(df, chosen_scope("  ", " project-3 ")), "project_id = 'project-3'"
    ),
    "scan_jobs_without_scope": job_filter(lambda df: in_scope(df, chosen_scope(None, "")), "true"),
    "filter_category": (
        lambda i: i.jobs.select("project_id", costs.cost_category(F.col("dur_ms"), F.lit(2000.0)).alias("category"))
        .filter(F.col("category").contains("Reservation")).groupBy("category").agg(F.count("*").alias("n")),
        duckdb_sql(
            "select 'Strong Reservation Candidate (High IO / Low CPU)' as category, count(*) as n from jobs"
            " where dur_ms > 2000e0 * 1.2e0",
            "jobs",
        ),
    ),
}

# ---------------------------------------------------------------- projections


def durations(i: Inputs) -> DataFrame:
    run = times.whole_milliseconds(F.col("start_time"), F.col("end_time"))
    rows = i.jobs.select("job_id", run.alias("run_ms"), "total_slot_ms", "has_error")
    actual = F.coalesce("run_ms", F.lit(0))
    return rows.select(
        "job_id", "has_error",
        F.nullif(F.col("run_ms"), F.lit(0)).alias("actual_ms"),
        F.greatest("run_ms", F.lit(60000)).cast("long").alias("billed_ms"),
        costs.average_slots(F.col("total_slot_ms"), actual).alias("avg_slots"),
        costs.spike_factor(actual).alias("spike"),
        costs.billed_slots(costs.average_slots(F.col("total_slot_ms"), actual), 50).alias("billed_slots"),
    )


def identifiers(i: Inputs) -> DataFrame:
    res = F.col("reservation_id")
    forms = [res, F.regexp_replace(res, "\\.", ":"), F.substring_index(res, ":", -1)]
    return (
        i.jobs.select(F.explode(F.array(*forms)).alias("reservation_id"))
        .groupBy("reservation_id").agg(F.count("*").alias("n"))
        .select(
            "reservation_id", "n", ids.short_id(res).alias("short_id"), ids.display_id(res).alias("display_id"),
            ids.admin_project(res).alias("admin_project"), ids.clean_id(res).alias("clean_id"),
        )
    )


def time_parts(i: Inputs) -> DataFrame:
    ts = F.col("creation_time")
    hour, weekday = times.hour_and_weekday(ts, "Asia/Kolkata")
    rows = i.jobs.select(
        "job_id", F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd HH:mm:ss").alias("minute"),
        F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd HH:mm:ss").alias("day"),
        F.date_format(times.tumbling(ts, 7), "yyyy-MM-dd HH:mm:ss").alias("window_7m"),
        times.iso_text(F.date_trunc("second", ts), "Asia/Kolkata").alias("local_iso"),
        hour.alias("hour"), weekday.alias("weekday"),
        times.whole_seconds(ts, F.col("end_time")).alias("seconds"),
    )
    return rows


def rounded(i: Inputs) -> DataFrame:
    lines = i.sample("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount") / 8).alias("x")
    ).withColumns({f"x{d}": F.col("x") for d in (0, 2, 3, 4)})
    lines = round_columns(lines, {f"x{d}": d for d in (0, 2, 3, 4)})
    return lines.withColumn("nearest_50", to_nearest(F.col("x"), 50)).drop("x")


def texts_shown(i: Inputs) -> DataFrame:
    texts = i.jobs_text.select("job_id", "query")
    return i.jobs.select("job_id").join(texts, "job_id", "left").select("job_id", costs.shown_text(F.col("query")).alias("shown"))


PROJECTIONS = {
    "project_job_durations": (
        durations,
        duckdb_sql(
            """with d as (select *, datesub('millisecond', start_time, end_time) as ms from jobs),
            a as (select *, case when coalesce(ms, 0) <> 0 and total_slot_ms is not null
              then total_slot_ms / (ms * 1e0) else 0 end as avg_slots from d)
            select job_id, has_error, nullif(ms, 0) as actual_ms, greatest(ms, 60000) as billed_ms, avg_slots,
             case when coalesce(ms, 0) < 60000 then 1e0 + 2e0 * (1e0 - coalesce(ms, 0) / 60000e0) else 1e0 end as spike,
             case when avg_slots < 50 then avg_slots else ceil(avg_slots / 50) * 50 end as billed_slots from a""",
            "jobs",
        ),
    ),
    "project_reservation_ids": (
        identifiers,
        duckdb_sql(
            """with r as (select unnest([reservation_id, replace(reservation_id, '.', ':'),
              split(reservation_id, ':')[-1]]) as reservation_id from jobs)
            select reservation_id, count(*) as n,
             case when contains(reservation_id, '.') then split(reservation_id, '.')[-1]
              else split(reservation_id, ':')[-1] end as short_id,
             split(reservation_id, '.')[-1] as display_id,
             case when contains(reservation_id, ':') then split(replace(reservation_id, '.', ':'), ':')[1] end
              as admin_project,
             split(replace(reservation_id, '.', ':'), ':')[-1] as clean_id
            from r group by reservation_id""",
            "jobs",
        ),
    ),
    "project_time_parts": (
        time_parts,
        duckdb_sql(
            """select job_id, strftime(date_trunc('minute', creation_time), '%Y-%m-%d %H:%M:%S') as "minute",
             strftime(date_trunc('day', creation_time), '%Y-%m-%d %H:%M:%S') as "day",
             strftime(time_bucket(interval '7 minutes', creation_time, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S')
              as window_7m,
             strftime(creation_time + interval '330 minutes', '%Y-%m-%dT%H:%M:%S') || '+05:30' as local_iso,
             cast(hour(creation_time + interval '330 minutes') as integer) as hour,
             cast(dayofweek(creation_time + interval '330 minutes') as integer) as weekday,
             datesub('second', creation_time, end_time) as seconds from jobs""",
            "jobs",
        ),
    ),
    "project_rounding": (
        rounded,
        """with r as (select l_orderkey, l_linenumber, l_extendedprice * l_discount / 8e0 as x from lineitem)
        select l_orderkey, l_linenumber, cast(printf('%.0f', x) as double) as x0, cast(printf('%.2f', x) as double) as x2,
         cast(printf('%.3f', x) as double) as x3, cast(printf('%.4f', x) as double) as x4,
         cast(round_even(x / 50e0, 0) * 50 as bigint) as nearest_50 from r""",
    ),
    "project_query_text": (
        texts_shown,
        duckdb_sql(
            """select j.job_id, case when length(t.query) > 500 then substr(t.query, 1, 500) || '...'
             else coalesce(t.query, 'Query text not found') end as shown from jobs j left join jobs_text t using (job_id)""",
            "jobs", "jobs_text",
        ),
    ),
}

# ---------------------------------------------------------------- joins


def changes_seen(i: Inputs) -> DataFrame:
    """The latest change of one of three reservations at the time of each job, by reservation."""
    name = F.concat(F.lit("res-"), (F.substring("job_id", 5, 20).cast("long") % 3).cast("string"))
    jobs = i.jobs.select("job_id", "creation_time", name.alias("reservation_name"))
    seen = asof_backward(
        jobs, i.reservation_changes, "creation_time", "change_timestamp", ["action", "slot_capacity"],
        by=["reservation_name"],
    )
    return seen.groupBy("reservation_name", "action").agg(
        F.count("*").alias("n"), F.sum("slot_capacity").alias("capacity")
    )


def both_logs(i: Inputs) -> DataFrame:
    """Hourly activity of both change logs, whichever has any."""
    def hourly(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.date_trunc("hour", "change_timestamp").alias("hour")).agg(F.count("*").alias(name))

    joined = hourly(i.reservation_changes, "reservation_n").join(
        hourly(i.capacity_commitment_changes, "commitment_n"), "hour", "full"
    )
    return in_text(joined, "hour")


def rated(i: Inputs) -> DataFrame:
    usage = attribution.project_usage(i.jobs, p.AttributionParams("2024-01-01", "2024-01-03"))
    found = attribution.priced_reservations(usage, with_rule(i.attribution_config))
    return found.select("reservation_id", "total_hours", "sku_rate", "total_admin_bill", "waste")


JOINS = {
    "join_membership_flag": (
        lambda i: storage.dataset_bytes(i.table_storage).select("project_name", "dataset_name")
        .join(storage.physical_datasets(i.schemata_options).withColumn("hit", F.lit(True)),
              ["project_name", "dataset_name"], "left")
        .select("project_name", "dataset_name", F.col("hit").isNotNull().alias("on_physical")),
        duckdb_sql(
            """select distinct project_id as project_name, table_schema as dataset_name,
             (project_id, table_schema) in (select (project_id, schema_name) from schemata_options
              where option_name = 'storage_billing_model' and option_value = 'PHYSICAL') as on_physical
            from table_storage where total_physical_bytes > 0""",
            "table_storage", "schemata_options",
        ),
    ),
    "join_asof_by_reservation": (
        changes_seen,
        duckdb_sql(
            """with j as (select job_id, creation_time, 'res-' || (cast(substr(job_id, 5) as bigint) % 3)
              as reservation_name from jobs),
            s as (select j.*, c.action, c.slot_capacity from j asof left join reservation_changes c
              on j.reservation_name = c.reservation_name and j.creation_time >= c.change_timestamp)
            select reservation_name, action, count(*) as n, cast(sum(slot_capacity) as bigint) as capacity
            from s group by all""",
            "jobs", "reservation_changes",
        ),
    ),
    "join_full_outer_change_logs": (
        both_logs,
        duckdb_sql(
            """with r as (select date_trunc('hour', change_timestamp) as h, count(*) as reservation_n
              from reservation_changes group by all),
            c as (select date_trunc('hour', change_timestamp) as h, count(*) as commitment_n
              from capacity_commitment_changes group by all)
            select strftime(h, '%Y-%m-%dT%H:%M:%S+00:00') as hour, reservation_n, commitment_n
            from r full outer join c using (h)""",
            "reservation_changes", "capacity_commitment_changes",
        ),
    ),
    "join_flagged_project_hours": (
        lambda i: in_text(trickle.flagged_project_hours(i.jobs, TRICKLE_PARAMS), "hour_bucket"),
        duckdb_sql(
            "with " + PROFILE_SQL + """ select strftime(hour_bucket, '%Y-%m-%dT%H:%M:%S+00:00') as hour_bucket,
            reservation_id, project_id, query_count, hourly_queries
            from prof join flag using (hour_bucket, reservation_id)""",
            "jobs",
        ),
    ),
    "join_rates_short_then_full": (
        rated,
        duckdb_sql(
            """with u as (select reservation_id, sum(total_slot_ms) / 3600000e0 as h from jobs
              where creation_time >= timestamp '2024-01-01' and creation_time < timestamp '2024-01-04'
               and job_type = 'QUERY' and statement_type <> 'SCRIPT' and reservation_id is not null group by all),
            s as (select *, case when contains(reservation_id, '.') then split(reservation_id, '.')[-1]
              else split(reservation_id, ':')[-1] end as sid from u)
            select s.reservation_id, h as total_hours, coalesce(a.sku_rate, b.sku_rate) as sku_rate,
             coalesce(a.total_admin_bill, b.total_admin_bill) as total_admin_bill,
             greatest(0, coalesce(a.total_admin_bill, b.total_admin_bill) - h * coalesce(a.sku_rate, b.sku_rate)) as waste
            from s left join attribution_config a on a.reservation_key = sid
             left join attribution_config b on b.reservation_key = s.reservation_id
            where coalesce(a.sku_rate, b.sku_rate) is not null""",
            "jobs", "attribution_config",
        ),
    ),
}

# ---------------------------------------------------------------- aggregates


def windows(i: Inputs, merged: bool) -> DataFrame:
    params = p.SlotParams(as_of=AS_OF)
    seconds = slots.per_second_usage(i.jobs_timeline, params)
    if merged:
        found = slots.windowed_usage(slots.merged_per_second(seconds), [], params)
    else:
        found = slots.windowed_usage(seconds, ["reservation_id"], params)
    return six_places(in_text(found, "window_start"), "avg_slots", "max_slots")


def profile(i: Inputs) -> DataFrame:
    found = trickle.hourly_profile(trickle.reserved_queries(i.jobs, TRICKLE_PARAMS))
    return six_places(in_text(found, "hour_bucket"), "avg_slots_per_query")


def window_sql(keys: str, which: str) -> str:
    return duckdb_sql(
        f"with {USED_SQL.format(us=300000000)} select strftime(w, '%Y-%m-%dT%H:%M:%S+00:00') as window_start, {keys}"
        f" round(held, 6) as avg_slots, round(top, 6) as max_slots from span where who {which} 'MERGED (Simulated)'",
        "jobs_timeline",
    )


MINUTES_WHERE = """period_start >= timestamp '2023-12-28 00:00:00'
 and period_start <= timestamp '2024-01-04 00:00:00' and job_type = 'QUERY'
 and (statement_type <> 'SCRIPT' or statement_type is null)"""

AGGREGATES = {
    "aggregate_dataset_bytes": (
        lambda i: storage.dataset_bytes(i.table_storage),
        duckdb_sql(
            "select project_id as project_name, table_schema as dataset_name, "
            + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in storage.BYTE_COLUMNS)
            + " from table_storage where total_physical_bytes > 0 group by all",
            "table_storage",
        ),
    ),
    "aggregate_slot_windows": (lambda i: windows(i, False), window_sql("who as reservation_id,", "<>")),
    "aggregate_merged_slot_windows": (lambda i: windows(i, True), window_sql("", "=")),
    "aggregate_minute_usage": (
        lambda i: in_text(matrix.minute_usage(i.jobs_timeline, p.MatrixParams(as_of=AS_OF)), "usage_minute"),
        duckdb_sql(
            "select strftime(date_trunc('minute', period_start), '%Y-%m-%dT%H:%M:%S+00:00') as usage_minute,"
            " cast(coalesce(sum(period_slot_ms), 0) as bigint) as slot_ms"
            f" from jobs_timeline where {MINUTES_WHERE} group by 1",
            "jobs_timeline",
        ),
    ),
    "aggregate_band_histogram": (
        lambda i: matrix.band_histogram(
            matrix.minute_usage(i.jobs_timeline, p.MatrixParams(as_of=AS_OF)), p.MatrixParams(max_baseline=100, step_size=5)
        ),
        duckdb_sql(
            f"""with m as (select date_trunc('minute', period_start) as m,
              cast(coalesce(sum(period_slot_ms), 0) as bigint) as ms from jobs_timeline where {MINUTES_WHERE} group by 1),
            b as (select least(cast(ceil(ms / 300000e0) as bigint), 21) as k, count(*) as minutes,
              cast(sum(ms) as bigint) as slot_ms from m group by 1),
            g as (select unnest(range(0, 22)) as k)
            select k, k * 5 as slots, coalesce(minutes, 0) as minutes, coalesce(slot_ms, 0) as slot_ms
            from g left join b using (k)""",
            "jobs_timeline",
        ),
    ),
    "aggregate_exact_percentiles": (
        lambda i: quantiles.exact(
            i.jobs_timeline, "reservation_id", "period_slot_ms", {"p0": 0, "p50": 50, "p90": 90, "p99": 99, "p100": 100}
        ),
        duckdb_sql(
            "select reservation_id, "
            + ", ".join(f"quantile_disc(period_slot_ms, {q / 100}) as p{q}" for q in (0, 50, 90, 99, 100))
            + " from jobs_timeline where reservation_id is not null group by all",
            "jobs_timeline",
        ),
    ),
    "aggregate_hourly_profile": (
        profile,
        duckdb_sql(
            "with " + PROFILE_SQL + """ select strftime(hour_bucket, '%Y-%m-%dT%H:%M:%S+00:00') as hour_bucket,
             reservation_id, project_id, query_count, round(avg_slots, 6) as avg_slots_per_query,
             med as median_duration_seconds from prof""",
            "jobs",
        ),
    ),
    "aggregate_project_usage": (
        lambda i: attribution.project_usage(i.jobs, p.AttributionParams("2024-01-01", "2024-01-02")),
        duckdb_sql(
            """select project_id, reservation_id, cast(coalesce(sum(total_slot_ms), 0) as bigint) as slot_ms from jobs
            where creation_time >= timestamp '2024-01-01' and creation_time < timestamp '2024-01-03'
             and job_type = 'QUERY' and statement_type <> 'SCRIPT' and reservation_id is not null group by all""",
            "jobs",
        ),
    ),
    "aggregate_distinct_projects": (
        lambda i: i.table_storage.select("project_id").distinct(),
        duckdb_sql("select distinct project_id from table_storage", "table_storage"),
    ),
}

# ---------------------------------------------------------------- windows

LOG_PARAMS = p.ProvisioningParams(as_of=AS_OF)
LOG_SQL = "with " + DELTAS_SQL.format(end=END, edition="ENTERPRISE")


def previous_jobs(i: Inputs, jobs: DataFrame | None = None) -> DataFrame:
    """The previous job of each user, within and across days."""
    rows = (i.jobs if jobs is None else jobs).select("user_email", "creation_time", "job_id", "total_slot_ms")
    lagged = lag_row(rows, ["user_email"], ["creation_time", "job_id"], ["job_id", "total_slot_ms"], "before")
    return lagged.select("job_id", F.col("before.job_id").alias("previous_job"),
                         F.col("before.total_slot_ms").alias("previous_slot_ms"))


def running_bytes(i: Inputs) -> DataFrame:
    """Bytes processed so far by second, and the second with the next job."""
    points = i.jobs.groupBy(F.date_trunc("second", "creation_time").alias("second")).agg(
        F.sum("total_bytes_processed").alias("so_far")
    )
    return in_text(running_steps(points, "second", ["so_far"], "next_second"), "second", "next_second")


def three_busiest(i: Inputs) -> DataFrame:
    users = i.jobs.groupBy("reservation_id", "user_email").agg(F.count("*").alias("n"))
    return first_of_each(users, ["reservation_id"], [F.desc("n"), "user_email"], 3)


WINDOWS = {
    "window_reservation_deltas": (
        lambda i: in_text(
            provisioning.reservation_deltas(i.reservation_changes, LOG_PARAMS)
            .withColumn("change_timestamp", F.date_trunc("second", "change_timestamp")), "change_timestamp"
        ),
        duckdb_sql(
            LOG_SQL + """ select strftime(change_timestamp, '%Y-%m-%dT%H:%M:%S+00:00') as change_timestamp,
             reservation_name, cast(cur as bigint) as current_delta, cast(base as bigint) as baseline_delta from rdelta""",
            "reservation_changes", "capacity_commitment_changes",
        ),
    ),
    "window_commitment_deltas": (
        lambda i: in_text(
            provisioning.commitment_deltas(i.capacity_commitment_changes, LOG_PARAMS)
            .withColumn("change_timestamp", F.date_trunc("second", "change_timestamp")), "change_timestamp"
        ),
        duckdb_sql(
            LOG_SQL + """ select strftime(change_timestamp, '%Y-%m-%dT%H:%M:%S+00:00') as change_timestamp,
             capacity_commitment_id, cast(cap as bigint) as capacity_delta from cdelta""",
            "reservation_changes", "capacity_commitment_changes",
        ),
    ),
    "window_previous_job": (
        previous_jobs,
        duckdb_sql(
            """select job_id, lag(job_id) over w as previous_job, lag(total_slot_ms) over w as previous_slot_ms
            from jobs window w as (partition by user_email order by creation_time, job_id)""",
            "jobs",
        ),
    ),
    # nine tenths of the jobs are one user's, in one hour
    "window_previous_job_crowded": (
        lambda i: previous_jobs(i, i.jobs_crowded),
        duckdb_sql(
            """select job_id, lag(job_id) over w as previous_job, lag(total_slot_ms) over w as previous_slot_ms
            from jobs_crowded window w as (partition by user_email order by creation_time, job_id)""",
            "jobs_crowded",
        ),
    ),
    "join_asof_crowded": (
        lambda i: asof_backward(
            i.jobs_crowded.select("job_id", "user_email", "creation_time"),
            i.jobs_crowded.where("substr(job_id, -1) = '3'").select("user_email", "creation_time", F.col("total_slot_ms").alias("latest")),
            "creation_time", "creation_time", ["latest"], by=["user_email"], sequence=["latest"],
        ).select("job_id", "latest"),
        duckdb_sql(
            """with l as (select user_email, creation_time, max(coalesce(total_slot_ms, -1)) as latest from jobs_crowded
             where substr(job_id, -1) = '3' group by all)
            select job_id, nullif(latest, -1) as latest from jobs_crowded j asof left join l
            on j.user_email = l.user_email and j.creation_time >= l.creation_time""",
            "jobs_crowded",
        ),
    ),
    "window_running_total": (
        running_bytes,
        duckdb_sql(
            """with s as (select date_trunc('second', creation_time) as s, sum(total_bytes_processed) as b
              from jobs group by all)
            select strftime(s, '%Y-%m-%dT%H:%M:%S+00:00') as second,
             cast(sum(b) over (order by s range between unbounded preceding and current row) as bigint) as so_far,
             strftime(lead(s) over (order by s), '%Y-%m-%dT%H:%M:%S+00:00') as next_second from s""",
            "jobs",
        ),
    ),
    "window_top_three": (
        three_busiest,
        duckdb_sql(
            """select * from (select reservation_id, user_email, count(*) as n,
              row_number() over (partition by reservation_id order by count(*) desc, user_email) as rank
             from jobs group by reservation_id, user_email) where rank <= 3""",
            "jobs",
        ),
    ),
    "aggregate_ordered_text": (
        lambda i: three_busiest(i).groupBy("reservation_id").agg(listed("concat(user_email, ' (', n, ')')", "rank").alias("users")),
        duckdb_sql(
            """with t as (select reservation_id, user_email, count(*) as n,
              row_number() over (partition by reservation_id order by count(*) desc, user_email) as rank
             from jobs group by reservation_id, user_email)
            select reservation_id, string_agg(user_email || ' (' || n || ')', ', ' order by rank) as users
            from t where rank <= 3 group by reservation_id""",
            "jobs",
        ),
    ),
}

PRIMITIVES = {**FILTERS, **PROJECTIONS, **JOINS, **AGGREGATES, **WINDOWS}
