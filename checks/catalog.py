"""All checked queries: name to (Spark build, oracle SQL)."""

from __future__ import annotations

from checks.primitives import PRIMITIVES
from checks.reports import REPORTS

CHECKS = {**REPORTS, **PRIMITIVES}
