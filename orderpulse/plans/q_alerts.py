"""Registered queries: segmentation and alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderpulse.operators import alerts as AL
from orderpulse.operators import segments as SG
from orderpulse.plans.registry import EVENTS_REF, TPCH_REF, query, rounded, tx_events, tx_tpch


@query("pdv_vectors")
def pdv_vectors(spark, d):
    """A28 per client on line items."""
    return rounded(SG.pdv_vectors(tx_tpch(spark, d)), {"freq": 6})


@query("pdv_baseline")
def pdv_baseline(spark, d):
    """Cluster means and medians."""
    return rounded(SG.pdv_baseline(SG.pdv_vectors(tx_tpch(spark, d))),
                   {"mean_mix": 6, "mean_volume": 6, "mean_freq": 6, "mean_giro": 6})


@query("pdv_scores")
def pdv_scores(spark, d):
    """PDV score and trigger flags per client."""
    s = SG.pdv_scores(tx_tpch(spark, d))
    return rounded(s.select("client", "mix", "volume", "freq", "giro_mediano", "score",
                            "trig_mix", "trig_volume", "trig_turnover"), {"freq": 6})


@query("segment_rollup")
def segment_rollup(spark, d):
    """A15 per market segment."""
    return SG.segment_rollup(tx_tpch(spark, d))


@query("alerts_rupture")
def alerts_rupture(spark, d):
    """R01 per (client, brand), with the client's PDV triggers."""
    a = AL.rupture_alerts(tx_tpch(spark, d), TPCH_REF)
    return rounded(a.select("client", "sku", "type", "dias_sem_compra", "giro_mediano", "confianca",
                            "reliability", "prob_recompra", "ic_low", "ic_high",
                            "suggested_deadline", "triggers"),
                   {"confianca": 6, "ic_low": 6, "ic_high": 6})


@query("alerts_drop")
def alerts_drop(spark, d):
    """R02 per client on monthly revenue."""
    a = AL.drop_alerts(tx_tpch(spark, d))
    return rounded(a.select("client", "type", "zscore", "yoy", "queda_pct", "score", "reliability",
                            "suggested_deadline", "triggers"),
                   {"zscore": 6, "yoy": 6, "queda_pct": 6, "score": 6})


@query("alerts_outlier")
def alerts_outlier(spark, d):
    """R03 per (user, event type) on event values."""
    a = AL.outlier_alerts(tx_events(spark, d))
    return rounded(a.select("client", "sku", "type", "valor", "media", "direcao", "delta",
                            "reliability", "cv_giro", "survival", "suggested_deadline", "triggers"),
                   {"media": 6, "delta": 6, "cv_giro": 6})


@query("alerts_all")
def alerts_all(spark, d):
    """The three rules in one frame (line items)."""
    a = AL.rico_alerts(tx_tpch(spark, d), TPCH_REF, dataset_id="tpch")
    return a.select("dataset_id", "client", "sku", "type", "reliability", "suggested_deadline")


@query("alerts_summary")
def alerts_summary(spark, d):
    """A18 over the R00 alerts: total, per type, per reliability."""
    return AL.alerts_summary(AL.rico_alerts(tx_tpch(spark, d), TPCH_REF))


@query("alerts_filtered")
def alerts_filtered(spark, d):
    """rupture alerts with the red symbol, restricted to the RICO types."""
    a = AL.rico_alerts(tx_tpch(spark, d), TPCH_REF)
    a = AL.filter_alerts(a, alert_type="ruptura", reliability_symbol="🔴",
                         types=["ruptura", "queda_brusca", "outlier_volume"])
    return a.select("client", "sku", "type", "reliability")


@query("min_rupture")
def min_rupture(spark, d):
    """M01 per (client, product name)."""
    return AL.min_rupture(tx_tpch(spark, d), TPCH_REF)


@query("inactive_clients")
def inactive_clients(spark, d):
    """No order in the last 90 days."""
    return AL.inactive_clients(tx_tpch(spark, d), TPCH_REF)


@query("growth_clients")
def growth_clients(spark, d):
    """Last 90 days above 1.2 x the 90 days before."""
    return AL.growth_clients(tx_tpch(spark, d), TPCH_REF)


@query("single_purchase")
def single_purchase(spark, d):
    """(client, product name) bought once, over 120 days ago."""
    return AL.single_purchase(tx_tpch(spark, d), TPCH_REF)


@query("minimum_alerts")
def minimum_alerts(spark, d):
    """M01-M04 with the union of their columns."""
    return AL.minimum_alerts(tx_tpch(spark, d), TPCH_REF).select("cliente", "produto", "tipo", "status")
