"""Instants, look-back bounds, truncation and ISO text as Column expressions."""

from __future__ import annotations

from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.session import require_utc


def instant(value: datetime | str | None) -> Column:
    """A UTC timestamp literal; values without a zone are UTC, none means now."""
    if value is None:
        return F.current_timestamp()
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment.astimezone(timezone.utc).isoformat()).cast("timestamp")


def days_before(moment: Column, days: int) -> Column:
    return moment - F.make_dt_interval(F.lit(int(days)))


def since(
    df: DataFrame,
    ts: str,
    as_of: datetime | str | None,
    days: int,
    inclusive: bool = False,
    partition: str | None = None,
) -> DataFrame:
    """Rows after ``as_of - days`` and up to ``as_of``. A date partition column, where present, is
    filtered too, so that whole directories are skipped before any file footer is read."""
    require_utc(df.sparkSession)
    end = instant(as_of)
    bound = days_before(end, days)
    kept = df.filter((F.col(ts) >= bound if inclusive else F.col(ts) > bound) & (F.col(ts) <= end))
    if partition and partition in df.columns:
        kept = kept.filter(F.col(partition).between(F.to_date(bound), F.to_date(end)))
    return kept


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def previous_month(as_of: datetime | str | None) -> tuple[Column, Column]:
    """First and last day of the calendar month before ``as_of``."""
    in_month = F.add_months(F.to_date(instant(as_of)), -1)
    return F.trunc(in_month, "month"), F.last_day(in_month)


def between_days(df: DataFrame, ts: str, first: Column, last: Column, partition: str | None = None) -> DataFrame:
    """Rows from ``first`` to ``last``, both days included, as a half-open range."""
    require_utc(df.sparkSession)
    kept = df.filter(
        (F.col(ts) >= first.cast("timestamp")) & (F.col(ts) < F.date_add(last, 1).cast("timestamp"))
    )
    if partition and partition in df.columns:
        kept = kept.filter(F.col(partition).between(first, last))
    return kept


def checked_zone(name: str) -> str:
    """The zone name, if the zone exists."""
    try:
        ZoneInfo(name)
    except Exception as error:
        raise ValueError(f"Invalid timezone: {name}") from error
    return name


def iso_text(ts: Column, zone: str = "UTC") -> Column:
    """ISO-8601 text with offset for a whole-second timestamp, in ``zone``."""
    local = F.from_utc_timestamp(ts, checked_zone(zone))
    offset = ((F.unix_seconds(local) - F.unix_seconds(ts)) / 60).cast("int")
    size = F.abs(offset)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(offset < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def hour_and_weekday(ts: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """Hour of day and weekday with Sunday as 0, in ``zone``."""
    local = F.from_utc_timestamp(ts, checked_zone(zone))
    return F.hour(local), F.dayofweek(local) - 1


def tumbling(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned window that holds ``ts``."""
    return F.window(ts, f"{int(minutes)} minutes").getField("start")


def whole_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def whole_milliseconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)
