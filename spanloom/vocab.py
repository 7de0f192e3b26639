"""Closed vocabularies (fixed values), worst or lowest first as noted, and ranks in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RISK_ORDER = ["critical", "high", "medium", "low", "none", "unknown"]  # worst first
ENFORCEMENT_ORDER = ["block", "quarantine", "require_approval", "redact", "mask", "anonymize", "encrypt", "escalate", "notify", "warn", "log_only", "audit", "allow"]  # strictest first
SENSITIVITY_ORDER = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]  # lowest first
ENTITY_KIND_ORDER = ["user", "client", "agent", "tool", "llm", "service"]
RISK_LEVELS_SHOWN = ["critical", "high", "medium", "low", "none"]


def rank(value: Column, order: list[str]) -> Column:
    """1-based place in the list; what is null or not in it comes after all."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def at_rank(r: Column, order: list[str]) -> Column:
    """The value at a 1-based place; null outside of the list."""
    return F.get(F.array(*map(F.lit, order)), r - 1)
