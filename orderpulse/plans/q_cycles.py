"""Registered queries: cycle model and cohorts."""

from __future__ import annotations

from orderpulse.operators import cycles as CY
from orderpulse.plans.registry import TPCH_REF, query, rounded, tx_orders, tx_tpch

_R = {"revenue": 2, "avg_qty": 6, "mean_gap": 6, "gap_cv": 6, "cycle_consumption_pct": 6}


@query("cycle_customer")
def cycle_customer(spark, d):
    """D01 per client on one row per order."""
    c = CY.cycle_metrics(tx_orders(spark, d), ["client"], TPCH_REF).drop("avg_ticket")
    return rounded(c, _R)


@query("cycle_customer_sku")
def cycle_customer_sku(spark, d):
    """D02 per (client, brand)."""
    c = CY.cycle_metrics(tx_tpch(spark, d), ["client", "sku"], TPCH_REF).drop("avg_ticket")
    return rounded(c, _R)


@query("window_status")
def window_status(spark, d):
    """D03/D04 per client."""
    s = CY.window_status(CY.cycle_metrics(tx_orders(spark, d), ["client"], TPCH_REF))
    return rounded(s.select("client", "days_since", "cycle_days", "purchase_days", "cycle_ratio", "status"),
                   {"cycle_ratio": 8})


@query("priority_items")
def priority_items(spark, d):
    """D06/D07 per (client, brand), ordered list without texts."""
    p = CY.priority_items(tx_tpch(spark, d), TPCH_REF)
    return rounded(p.select("client", "sku", "status", "risk_level", "value_rank", "frequency_rank",
                            "confidence", "priority_score"),
                   {"value_rank": 8, "frequency_rank": 8, "confidence": 6, "priority_score": 6})


@query("instability")
def instability(spark, d):
    """D09 per client on one row per order."""
    c = CY.instability(CY.cycle_metrics(tx_orders(spark, d), ["client"], TPCH_REF))
    return rounded(c.select("client", "n_gaps", "gap_cv", "type"), {"gap_cv": 6})


@query("cohort_retention")
def cohort_retention(spark, d):
    """Monthly cohorts of first purchase."""
    return rounded(CY.cohort_retention(tx_orders(spark, d)), {"retention": 8})
