"""All oracle SQL statements, gathered from the per-area modules."""

from orderpulse.plans import (  # noqa: F401
    oracle_alerts, oracle_cycles, oracle_extract, oracle_normalize, oracle_summary,
)
from orderpulse.plans import oracle_reports  # noqa: F401,E402
from orderpulse.plans.oracle import ORACLE  # noqa: F401
