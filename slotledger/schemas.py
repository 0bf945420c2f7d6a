"""Explicit schemas of the metadata tables; no reader infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, D, TS = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TABLE_STORAGE = _table(
    ("project_id", S), ("table_schema", S), ("table_name", S),
    ("active_logical_bytes", L), ("long_term_logical_bytes", L),
    ("active_physical_bytes", L), ("time_travel_physical_bytes", L),
    ("fail_safe_physical_bytes", L), ("long_term_physical_bytes", L),
    ("total_physical_bytes", L),
)

SCHEMATA_OPTIONS = _table(("project_id", S), ("schema_name", S), ("option_name", S), ("option_value", S))

ORGANIZATION_OPTIONS = _table(("option_name", S), ("option_value", S))

JOBS = _table(
    ("job_id", S), ("user_email", S), ("project_id", S), ("reservation_id", S),
    ("state", S), ("job_type", S), ("statement_type", S),
    ("creation_time", TS), ("start_time", TS), ("end_time", TS),
    ("total_bytes_billed", L), ("total_bytes_processed", L), ("total_slot_ms", L),
    ("cache_hit", B),
    ("error_result", _table(("reason", S), ("location", S), ("message", S))),
    ("query_info", _table(("query_hashes", _table(("normalized_literals", S))))),
)

JOBS_TEXT = _table(("project_id", S), ("job_id", S), ("creation_time", TS), ("query", S))

JOBS_TIMELINE = _table(
    ("period_start", TS), ("job_id", S), ("project_id", S), ("reservation_id", S),
    ("job_type", S), ("statement_type", S),
    ("period_slot_ms", L), ("total_bytes_billed", L), ("total_bytes_processed", L),
)

RESERVATIONS = _table(
    ("admin_project_id", S), ("reservation_name", S), ("edition", S), ("slot_capacity", L),
    ("autoscale", _table(("max_slots", L))),
)

RESERVATION_CHANGES = _table(
    ("change_timestamp", TS), ("project_id", S), ("reservation_name", S), ("action", S), ("edition", S),
    ("slot_capacity", L), ("autoscale", _table(("current_slots", L))),
)

CAPACITY_COMMITMENT_CHANGES = _table(
    ("change_timestamp", TS), ("project_id", S), ("capacity_commitment_id", S), ("action", S), ("state", S),
    ("edition", S), ("slot_count", L),
)

ATTRIBUTION_CONFIG = _table(
    ("waste_rule", S), ("central_cost_center_project", S), ("borrowing_rule", S),
    ("reservations", T.MapType(S, _table(("sku_rate", D), ("total_admin_bill", D)))),
)

STORAGE_FORECAST_SAMPLE = _table(
    ("id", L), ("project", S), ("dataset", S), ("logical_cost", D), ("physical_cost", D),
    ("recommendation", S), ("savings", D),
)

TABLES = {
    "table_storage": TABLE_STORAGE,
    "schemata_options": SCHEMATA_OPTIONS,
    "organization_options": ORGANIZATION_OPTIONS,
    "jobs": JOBS,
    "jobs_text": JOBS_TEXT,
    "jobs_timeline": JOBS_TIMELINE,
    "reservations": RESERVATIONS,
    "reservation_changes": RESERVATION_CHANGES,
    "capacity_commitment_changes": CAPACITY_COMMITMENT_CHANGES,
}
