"""Registered queries: products, KPIs, history."""

from __future__ import annotations

from orderpulse.operators import metrics as M
from orderpulse.plans.registry import TPCH_REF, query, rounded, tx_orders, tx_tpch


@query("product_analytics")
def product_analytics(spark, d):
    """A06-A10 per brand."""
    return rounded(M.product_analytics(tx_tpch(spark, d)),
                   {"revenue": 2, "turnover_median": 4,
                    "growth_zscore": 6, "growth_yoy": 6})


@query("product_analytics_part")
def product_analytics_part(spark, d):
    """A06-A10 per part key (many SKUs, sparse months)."""
    from orderpulse.sources.adapters import tpch
    return rounded(M.product_analytics(tpch(spark, d, sku="part")),
                   {"revenue": 2, "turnover_median": 4,
                    "growth_zscore": 6, "growth_yoy": 6})


@query("product_monthly")
def product_monthly(spark, d):
    """Revenue per brand and month."""
    return rounded(M.product_monthly(tx_tpch(spark, d)), {"revenue": 2})


@query("client_growth")
def client_growth(spark, d):
    """A09/A10 on monthly revenue per client."""
    g = M.series_growth(M.product_monthly(tx_tpch(spark, d), key="client"), "client")
    return rounded(g.select("client", "n_months", "growth_zscore", "growth_yoy"),
                   {"growth_zscore": 6, "growth_yoy": 6})


@query("hero_threshold")
def hero_threshold(spark, d):
    """80th percentile of revenue per part key."""
    from orderpulse.sources.adapters import tpch
    return rounded(M.hero_threshold(tpch(spark, d, sku="part")), {"hero_threshold": 4})


@query("general_kpis")
def general_kpis(spark, d):
    """A11, A12 on one row per order."""
    return rounded(M.general_kpis(tx_orders(spark, d), TPCH_REF),
                   {"total_revenue": 2, "avg_recency": 6, "avg_frequency": 6,
                    "ruptura_projetada_media": 6})


@query("general_kpis_lines")
def general_kpis_lines(spark, d):
    """A11, A12 on line items."""
    return rounded(M.general_kpis(tx_tpch(spark, d), TPCH_REF),
                   {"total_revenue": 2, "avg_recency": 6, "avg_frequency": 6,
                    "ruptura_projetada_media": 6})


@query("projected_stockout")
def projected_stockout(spark, d):
    """A12 per client on one row per order."""
    return rounded(M.projected_stockout(tx_orders(spark, d), TPCH_REF), {"gm_cliente": 4})


@query("monthly_history")
def monthly_history(spark, d):
    """Monthly revenue, orders, clients, volume, ticket."""
    return rounded(M.monthly_history(tx_tpch(spark, d)),
                   {"receita_total": 2, "volume": 2})


@query("behaviour_sheet")
def behaviour_sheet(spark, d):
    """KPI rows and client counts per tier."""
    tx = tx_tpch(spark, d)
    return M.behaviour_sheet(M.general_kpis(tx, TPCH_REF), M.customer_rfm(tx, TPCH_REF))
