"""Units and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
GIB = 1024**3
TB = 1024**4
MIB = 1024**2
SLOT_HOUR_MS = 3600000.0
MONTH_HOURS = 730.0
MIN_BILLED_MS = 60000
SHARED_SLOT_LIMIT = 50
COST_MARGIN = 1.2
SHORT_QUERY_BYTES = 100 * MIB
SHORT_QUERY_SECONDS = 5
PEAK_UNIT = 500
PEAK_FALLBACK = 1000
TEXT_LIMIT = 500
RESERVATION_CANDIDATE = "Strong Reservation Candidate (High IO / Low CPU)"
ON_DEMAND_CANDIDATE = "Strong On-Demand Candidate (Low IO / High CPU)"
UNCERTAIN = "Balanced / Uncertain"
SHORT_QUERY_ADVICE = (
    "Candidate for Short Query Optimization. "
    "Consider enabling Advanced Runtime and Optional Job Creation."
)
NO_ADVICE = "N/A"
BASELINE_ADVICE = "Consider Baseline"
TEXT_MISSING = "Query text not found"
MERGED_NAME = "MERGED (Simulated)"


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def gib(x: Column) -> Column:
    return or_zero(x) / GIB


def terabytes(x: Column) -> Column:
    return or_zero(x) / TB


def megabytes(x: Column) -> Column:
    return or_zero(x) / MIB


def slot_hours(slot_ms: Column) -> Column:
    return or_zero(slot_ms) / SLOT_HOUR_MS


def average_slots(slot_ms: Column, duration_ms: Column) -> Column:
    """Slots held over the run, 0 without a duration or without usage."""
    return F.when((duration_ms != 0) & slot_ms.isNotNull(), slot_ms / duration_ms).otherwise(F.lit(0.0))


def spike_factor(duration_ms: Column) -> Column:
    """Peak over average: 3 at no duration, falling to 1 at a minute."""
    return F.when(duration_ms < 60000, 1.0 + 2.0 * (1.0 - duration_ms / 60000.0)).otherwise(F.lit(1.0))


def billed_slots(effective: Column, step: int) -> Column:
    """Small queries share slots; larger ones are billed in whole steps. The limit does not follow the step."""
    return F.when(effective < SHARED_SLOT_LIMIT, effective).otherwise((F.ceil(effective / step) * step).cast("double"))


def cost_category(on_demand: Column, editions: Column) -> Column:
    return (
        F.when(on_demand > editions * COST_MARGIN, RESERVATION_CANDIDATE)
        .when(editions > on_demand * COST_MARGIN, ON_DEMAND_CANDIDATE)
        .otherwise(UNCERTAIN)
    )


def cheaper_plan(on_demand: Column, editions: Column) -> Column:
    return F.when(on_demand <= editions, "On-Demand").otherwise("Editions")


def saving_percent(saving: Column, on_demand: Column, editions: Column) -> Column:
    """Saving against the dearer plan, as a percentage; losses count as 0."""
    dearer = F.greatest(on_demand, editions)
    return F.when(saving > 0, saving / F.when(dearer == 0, 1.0).otherwise(dearer) * 100).otherwise(F.lit(0.0))


def short_query_advice(avg_bytes: Column, avg_seconds: Column) -> Column:
    return F.when(
        (avg_bytes < SHORT_QUERY_BYTES) & (avg_seconds < SHORT_QUERY_SECONDS), SHORT_QUERY_ADVICE
    ).otherwise(NO_ADVICE)


def advice_badge(advice: Column) -> Column:
    return F.when(advice != NO_ADVICE, "Candidate").otherwise(NO_ADVICE)


def shown_text(text: Column, length: int = TEXT_LIMIT) -> Column:
    """Query text for display: a default for missing text, and the start of long text."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(
        F.coalesce(text, F.lit(TEXT_MISSING))
    )


def suggested_maximum(peak: Column) -> Column:
    """The peak rounded up to a clean limit, with a fallback when there is no peak."""
    rounded = F.ceil(or_zero(peak) / PEAK_UNIT) * PEAK_UNIT
    return F.when(rounded == 0, PEAK_FALLBACK).otherwise(rounded).cast("long")
