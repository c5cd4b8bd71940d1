"""Score -> label ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderpulse.schemas import (
    RELIABILITY_BOUNDS, RELIABILITY_DEFAULT, RELIABILITY_LABELS, TIER_BOUNDS, TIER_DEFAULT,
)


def _chain(score: Column, bounds, default: str) -> Column:
    expr = None
    for bound, label in bounds:
        expr = F.when(score >= bound, label) if expr is None else expr.when(score >= bound, label)
    return expr.otherwise(default)


def tier(score: Column) -> Column:
    return _chain(score, TIER_BOUNDS, TIER_DEFAULT)


def reliability(score: Column) -> Column:
    return _chain(score, RELIABILITY_BOUNDS, RELIABILITY_DEFAULT)


def reliability_label(symbol: Column) -> Column:
    """Export label (P32): the blue symbol is ALTA, yellow MÉDIA, anything else BAIXA."""
    return (F.when(symbol == "🔵", RELIABILITY_LABELS["🔵"])
            .when(symbol == "🟡", RELIABILITY_LABELS["🟡"])
            .otherwise(RELIABILITY_LABELS["🔴"]))
