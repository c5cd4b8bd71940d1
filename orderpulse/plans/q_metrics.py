"""Registered queries: customer and product metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderpulse.operators import metrics as M
from orderpulse.plans.registry import (
    EVENTS_REF, TPCH_REF, query, rounded, tx_events, tx_orders, tx_tpch,
)

BASE_ROUND = {"monetary": 2, "gm_cliente": 4}


@query("customer_base")
def customer_base(spark, d):
    """A01-A03 on one row per order."""
    return rounded(M.customer_base(tx_orders(spark, d), TPCH_REF), BASE_ROUND)


@query("customer_base_lines")
def customer_base_lines(spark, d):
    """A01-A03 on line items (turnover over rows, as the reference counts it)."""
    return rounded(M.customer_base(tx_tpch(spark, d), TPCH_REF), BASE_ROUND)


@query("customer_rfm")
def customer_rfm(spark, d):
    """A04, A05, W03, J05, U04, P25 on line items."""
    df = M.customer_rfm(tx_tpch(spark, d), TPCH_REF)
    return rounded(df.select("client", "recency", "frequency", "monetary", "segment_weight",
                             "rfm_score", "tier"),
                   {"monetary": 2, "segment_weight": 8, "rfm_score": 8})


@query("customer_rfm_orders")
def customer_rfm_orders(spark, d):
    """RFM on one row per order (distinct-order frequencies, many rank ties)."""
    df = M.customer_rfm(tx_orders(spark, d), TPCH_REF)
    return rounded(df.select("client", "segment_weight", "rfm_score", "tier"),
                   {"segment_weight": 8, "rfm_score": 8})
