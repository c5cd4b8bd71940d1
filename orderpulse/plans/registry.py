"""Query registry: one entry per operator group of SURVEY section 2.

Every query takes ``(spark, data_dir)``, reads the driver tables through an
adapter and returns a lazy DataFrame. Each has an oracle SQL statement with the
same column names (``oracle.py``) unless the operator is not SQL-expressible.
Doubles are rounded in both so that summation order does not change the
comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.sources import adapters as A

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


def tx_tpch(spark, d):
    return A.tpch(spark, d)


def tx_orders(spark, d):
    return A.tpch_orders(spark, d)


def tx_events(spark, d):
    return A.events(spark, d)


TPCH_REF = A.TPCH_REFERENCE_DATE
EVENTS_REF = A.EVENTS_REFERENCE_DATE

# Query modules register themselves on import.
from orderpulse.plans import (  # noqa: E402,F401
    q_alerts, q_cycles, q_extract, q_metrics, q_normalize, q_products, q_reports, q_stats, q_store, q_summary,
)
