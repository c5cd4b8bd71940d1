"""Registered queries: summaries, panel tables, top-k and report sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderpulse.operators import metrics as M
from orderpulse.operators import summary as SU
from orderpulse.plans import reports as RP
from orderpulse.plans.registry import TPCH_REF, query, rounded, tx_orders, tx_tpch
from orderpulse.sources.adapters import tpch


@query("dataset_summary")
def dataset_summary(spark, d):
    """A16 (+T04, A32) flattened to scalars."""
    s = SU.dataset_summary(tx_tpch(spark, d), TPCH_REF)
    return rounded(s.select(
        "n_clientes", "n_skus", "inicio", "fim", "meses",
        F.array_join("regioes", ",").alias("regioes"), "total_revenue", "hero_share_value",
        "hero_share_ratio",
        F.array_join(F.transform("top_products", lambda x: x["sku"]), ",").alias("top_skus")),
        {"total_revenue": 2, "hero_share_value": 2, "hero_share_ratio": 8})


@query("top_products")
def top_products(spark, d):
    """Top 5 (part, name) by revenue."""
    return SU.top_products(tpch(spark, d, sku="part"), 5)


@query("regions")
def regions(spark, d):
    """Sorted distinct regions."""
    return SU.regions(tx_tpch(spark, d)).select(F.array_join("regioes", ",").alias("regioes"))


@query("first_cities")
def first_cities(spark, d):
    """First 10 distinct nations in arrival order, sorted."""
    return SU.first_values(tx_tpch(spark, d), "city", 10)


@query("top_cities")
def top_cities(spark, d):
    """10 most frequent nations."""
    return SU.top_counts(tx_tpch(spark, d), "city", 10)


@query("light_summary")
def light_summary(spark, d):
    """A17 scalars."""
    return SU.light_summary(tx_tpch(spark, d))


@query("panel_kpis")
def panel_kpis(spark, d):
    """A19."""
    return SU.panel_kpis(tx_tpch(spark, d))


@query("rfm_summary")
def rfm_summary(spark, d):
    """A20 over the per-order customer base."""
    return rounded(SU.rfm_summary(M.customer_base(tx_orders(spark, d), TPCH_REF)), {"mean": 6})


@query("product_radar")
def product_radar(spark, d):
    """A21 per (brand, part name)."""
    return rounded(SU.product_radar(tx_tpch(spark, d)), {"penetration": 8})


@query("client_sku_potential")
def client_sku_potential(spark, d):
    """A22 per (client, brand)."""
    return SU.client_sku_potential(tx_tpch(spark, d))


@query("kpi_payload")
def kpi_payload(spark, d):
    """A31 from the per-order customer base."""
    return SU.kpi_payload(M.customer_base(tx_orders(spark, d), TPCH_REF))


@query("product_ranking")
def product_ranking(spark, d):
    """All parts ranked by revenue."""
    return SU.product_ranking(tpch(spark, d, sku="part"), "receita")


@query("product_ranking_qty")
def product_ranking_qty(spark, d):
    """Brands ranked by quantity."""
    return SU.product_ranking(tx_tpch(spark, d), "quantidade")


@query("relationship_sheet")
def relationship_sheet(spark, d):
    """P33 on the per-order customer base."""
    return RP.relationship_sheet(M.customer_base(tx_orders(spark, d), TPCH_REF))
