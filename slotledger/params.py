"""Parameters of the analyses. Field defaults are fixed values of the product."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

Instant = datetime | str | None
Day = date | str | None


@dataclass(frozen=True, kw_only=True)
class Scoped:
    """Whose view is read of tables that hold several: the admin project's, else the organisation's.

    Without either it is the view of the account's own project, and of that project's own rows alone.
    """

    admin_project_id: str | None = None
    org_project_id: str | None = None
    home_project_id: str | None = None


@dataclass(frozen=True)
class StorageParams:
    active_logical_price: float = 0.02
    long_term_logical_price: float = 0.01
    active_physical_price: float = 0.04
    long_term_physical_price: float = 0.02
    time_travel_rescale: float = 1.0
    time_travel_hours: float | None = None
    min_monthly_saving: float = 0.0
    min_monthly_saving_pct: float = 0.0
    region: str = "region-us"


@dataclass(frozen=True)
class JobCostParams(Scoped):
    on_demand_rate_per_tb: float = 6.25
    edition_slot_hr_rate: float = 0.06
    slot_step_size: int = 50
    lookback_days: int = 3
    min_bytes_billed: int = 10485760
    limit_jobs: int | None = None  # the product's report costs the 1000 largest
    limit_top_jobs: int | None = None  # and lists 500
    category_filter: str = ""
    as_of: Instant = None


@dataclass(frozen=True)
class SlotParams(Scoped):
    lookback_days: int = 7
    window_minutes: int = 5
    percentile: int = 90
    accuracy: int = 10000
    region: str = "region-us"
    as_of: Instant = None


@dataclass(frozen=True)
class UtilizationParams(Scoped):
    lookback_days: int = 7
    timezone: str = "America/New_York"
    resolution: str = "MINUTE"
    accuracy: int = 10000
    exact: bool = False
    as_of: Instant = None


@dataclass(frozen=True)
class MatrixParams(Scoped):
    lookback_days: int = 7
    max_baseline: int = 10000
    step_size: int = 50
    payg_price: float = 0.06
    commit_1yr_price: float = 0.048
    commit_3yr_price: float = 0.036
    as_of: Instant = None


@dataclass(frozen=True)
class ProvisioningParams(Scoped):
    lookback_days: int = 7
    edition: str = "ENTERPRISE"
    as_of: Instant = None


@dataclass(frozen=True)
class PeakParams(Scoped):
    lookback_days: int = 30
    as_of: Instant = None


@dataclass(frozen=True)
class TrickleParams(Scoped):
    lookback_days: int = 7
    min_hourly_queries: int = 60
    max_avg_slots: float = 100.0
    max_median_seconds: float = 5.0
    top_projects: int = 3
    top_queries: int = 10
    shown_length: int = 500
    timezone: str = "UTC"
    as_of: Instant = None


@dataclass(frozen=True)
class SpenderParams(Scoped):
    lookback_days: int = 7
    od_price: float = 6.25
    ed_price: float = 0.06
    limit_users: int = 50
    as_of: Instant = None


@dataclass(frozen=True)
class AttributionParams(Scoped):
    """Both dates are inclusive; left out, they are the calendar month before ``as_of``."""

    billing_month_start: Day = None
    billing_month_end: Day = None
    as_of: Instant = None
