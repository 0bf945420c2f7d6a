"""Reservation identifiers, written ``project:location.name``, ``location.name`` or ``name``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_id(reservation_id: Column) -> Column:
    """The part after the last dot."""
    return F.substring_index(reservation_id, ".", -1)


def short_id(reservation_id: Column) -> Column:
    """The part after the last dot or, without a dot, after the last colon."""
    return F.when(reservation_id.contains("."), F.substring_index(reservation_id, ".", -1)).otherwise(
        F.substring_index(reservation_id, ":", -1)
    )


def _with_colons(reservation_id: Column) -> Column:
    return F.replace(reservation_id, F.lit("."), F.lit(":"))


def admin_project(reservation_id: Column) -> Column:
    """The owning project, the first part, where the identifier has a colon."""
    return F.when(reservation_id.contains(":"), F.substring_index(_with_colons(reservation_id), ":", 1))


def names_admin_project(reservation_id: Column) -> Column:
    """Whether :func:`admin_project` is there and not empty, without taking the identifier apart."""
    return (
        reservation_id.contains(":") & ~reservation_id.startswith(":") & ~reservation_id.startswith(".")
    )


def clean_id(reservation_id: Column) -> Column:
    """The last part, whatever parts it from the rest."""
    return F.substring_index(_with_colons(reservation_id), ":", -1)
