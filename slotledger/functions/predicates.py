"""Row predicates shared by the analyses. Their treatment of NULL differs on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_query() -> Column:
    return F.col("job_type") == "QUERY"


def not_script() -> Column:
    """A missing statement type counts as not a script."""
    return (F.col("statement_type") != "SCRIPT") | F.col("statement_type").isNull()


def known_not_script() -> Column:
    """A missing statement type is dropped."""
    return F.col("statement_type") != "SCRIPT"


def is_done() -> Column:
    return F.col("state") == "DONE"


def not_cached() -> Column:
    return ~F.coalesce(F.col("cache_hit"), F.lit(False))


def billed_at_least(floor: int) -> Column:
    return F.col("total_bytes_billed") >= floor


def on_reservation() -> Column:
    return F.col("reservation_id").isNotNull()


def has_physical_bytes() -> Column:
    return F.col("total_physical_bytes") > 0


def came_after(action: Column) -> Column:
    """Whether the previous action left the object alive; no previous action means no."""
    return F.coalesce(action.isin("CREATE", "UPDATE"), F.lit(False))
