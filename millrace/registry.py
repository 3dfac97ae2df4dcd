"""Every query of the core operators by name, with its SQL."""

from __future__ import annotations

from millrace.plans.queries import queries
from millrace.plans.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]
