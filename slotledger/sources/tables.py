"""Metadata tables: reading, shaping to the columns the analyses use, writing.

Log tables are laid out in directories by the UTC day of their time column, so that a look-back
reads only the days it needs. The same jobs and changes can be collected through several projects,
each of which sees a part of them. Such a table holds all these views, in directories by the project
that was asked (``view_project``); an analysis reads one of them, and each row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger import schemas
from slotledger.params import Scoped
from slotledger.session import require_utc

VIEW = "view_project"

# Time column and day-partition column of each log table
DAY_PARTITIONS = {
    "jobs": ("creation_time", "creation_date"),
    "jobs_timeline": ("period_start", "period_date"),
    "jobs_text": ("creation_time", "creation_date"),
}

#: Rows that a task sorts and writes, where there are more than the session's tasks would take.
TASK_ROWS = 1_000_000


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", views: bool = False) -> DataFrame:
    """Read ``root/name`` with its declared schema and, for logs, its day partition.

    ``views`` tells that the table holds several views and is divided by their project.
    """
    schema = T.StructType([*schemas.TABLES[name].fields])
    if views:
        schema = schema.add(VIEW, T.StringType())
    if name in DAY_PARTITIONS:
        schema = schema.add(DAY_PARTITIONS[name][1], T.DateType())
    return spark.read.schema(schema).format(fmt).load(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write a metadata table; one with several views is split by their project, and logs by UTC day.

    Logs are sorted by time. Ranges of equal size, so that a busy day or a large view is written by
    many tasks, and as many as the rows need: the session's number, or one for each ``TASK_ROWS``.
    """
    require_utc(df.sparkSession)
    parts, order = ([VIEW], [VIEW]) if VIEW in df.columns else ([], [])
    # a view of a table without days is cut by the columns that can be put in order
    within = [f.name for f in df.schema if f.name != VIEW and isinstance(f.dataType, T.AtomicType)]
    if name in DAY_PARTITIONS:
        ts, part = DAY_PARTITIONS[name]
        df, parts, order, within = df.withColumn(part, F.to_date(ts)), [*parts, part], [*order, ts], []
    if order:
        needed = -(-df.count() // TASK_ROWS)
        tasks = [needed] if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
        df = df.repartitionByRange(*tasks, *order, *within).sortWithinPartitions(*order)
    df.write.mode(mode).format(fmt).partitionBy(*parts).save(f"{root}/{name}")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """The result sink: records in parquet, JSON or any other Spark format."""
    df.write.mode(mode).format(fmt).save(path)


def read_forecast_sample(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of dataset forecasts."""
    return spark.read.schema(schemas.STORAGE_FORECAST_SAMPLE).option("multiLine", True).json(path)


def chosen_scope(admin_project: str | None, org_project: str | None) -> str | None:
    """The project whose view is read: the admin project, else the organisation's, else none."""
    for candidate in (admin_project, org_project):
        if candidate and candidate.strip():
            return candidate.strip()
    return None


def in_view(df: DataFrame, params: Scoped) -> DataFrame:
    """The rows of the chosen view, where ``df`` holds several; each row once.

    The project is resolved here, so the filter reaches the directories. Without an admin project or
    an organisation's, the account's own project is asked, and answers with its own rows.
    """
    if VIEW not in df.columns:
        return df
    project = chosen_scope(params.admin_project_id, params.org_project_id)
    if project is not None:
        return df.filter(F.col(VIEW) == project).drop(VIEW)
    home = chosen_scope(params.home_project_id, None)
    if home is None:
        raise ValueError(f"the table holds several views ({VIEW}); name the project whose view is meant")
    own = df.filter(F.col(VIEW) == home).drop(VIEW)
    return own.filter(F.col("project_id") == home) if "project_id" in own.columns else own


def in_admin_project(df: DataFrame, params: Scoped) -> DataFrame:
    """Changes of one admin project: its view, or its own entries in a log of several projects.

    Without a project and without views, entries of all projects are of one organisation's log.
    """
    if VIEW in df.columns:
        return in_view(df, params)
    return in_scope(df, chosen_scope(params.admin_project_id, params.org_project_id))


def in_scope(df: DataFrame, scope: str | None, column: str = "project_id") -> DataFrame:
    """Rows of one scope, or every row when there is none."""
    return df if scope is None else df.filter(F.col(column) == scope)


def _has_field(schema: T.StructType, path: str) -> bool:
    for name in path.split("."):
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def _alias(df: DataFrame, name: str, path: str, value: Column) -> DataFrame:
    if name in df.columns or not _has_field(df.schema, path):
        return df
    return df.withColumn(name, value)


def shape_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``has_error`` and ``query_hash`` from the nested columns, where not there already."""
    jobs = _alias(jobs, "has_error", "error_result", F.col("error_result").isNotNull())
    path = "query_info.query_hashes.normalized_literals"
    return _alias(jobs, "query_hash", path, F.col(path))


def shape_reservations(reservations: DataFrame) -> DataFrame:
    return _alias(reservations, "max_slots", "autoscale.max_slots", F.col("autoscale.max_slots"))


def shape_reservation_changes(changes: DataFrame) -> DataFrame:
    return _alias(changes, "current_slots", "autoscale.current_slots", F.col("autoscale.current_slots"))
