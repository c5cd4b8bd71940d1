"""Registered queries: statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderpulse.operators import stats as S
from orderpulse.operators.gaps import gap_cv, gaps, weighted_gaps
from orderpulse.operators.ordered import with_previous
from orderpulse.plans.registry import query, rounded, tx_events, tx_tpch

PAIR = ["client", "sku"]


@query("pair_gaps")
def pair_gaps(spark, d):
    """Floor-day gap to the previous line of the same (client, brand)."""
    g = gaps(tx_tpch(spark, d), PAIR)
    return g.select("client", "sku", "order_id", "ingest_seq", "gap")


@query("repurchase_probability")
def repurchase_probability(spark, d):
    """A23 per (client, brand) with a 90-day window."""
    g = weighted_gaps(tx_tpch(spark, d), PAIR)
    return S.repurchase_probability(g, PAIR, 90)


@query("turnover_interval")
def turnover_interval(spark, d):
    """A24 per (user, event type): 95% percentile interval of gaps."""
    g = weighted_gaps(tx_events(spark, d), PAIR)
    return rounded(S.turnover_interval(g, PAIR, 0.95), {"ic_low": 6, "ic_high": 6})


@query("turnover_cv")
def turnover_cv(spark, d):
    """A25 per (client, brand): coefficient of variation of the gaps."""
    g = weighted_gaps(tx_tpch(spark, d), PAIR)
    return rounded(g.groupBy(*PAIR).agg(gap_cv().alias("cv_giro")), {"cv_giro": 8})


@query("survival_score")
def survival_score(spark, d):
    """A26 per (user, event type) over its last 6 events: value above 10 counts as success."""
    last6 = S.last_rows(tx_events(spark, d), PAIR, 6)
    return last6.groupBy(*PAIR).agg(S.survival(F.col("qty") > 10).alias("survival"))


@query("volume_outliers")
def volume_outliers(spark, d):
    """W04 per (user, event type): |z| > 3 against the pair's mean and sigma_pop."""
    o = S.volume_outliers(tx_events(spark, d), PAIR, "qty", 3.0)
    return rounded(o.select("client", "sku", "order_id", "qty", "zscore"), {"zscore": 6})


@query("last_n_rows")
def last_n_rows(spark, d):
    """Last 6 events per (user, event type)."""
    return S.last_rows(tx_events(spark, d), PAIR, 6).select("client", "sku", "order_id", "_rank") \
        .withColumnRenamed("_rank", "rank_desc")


@query("qty_diff_cv")
def qty_diff_cv(spark, d):
    """W10 + A25: CV of consecutive value differences per (user, event type)."""
    p = with_previous(tx_events(spark, d), PAIR, ["date", "ingest_seq"], ["qty"])
    diff = F.col("qty") - F.col("prev_qty")
    return rounded(p.groupBy(*PAIR).agg(S.cv(diff).alias("cv_diff")), {"cv_diff": 6})
