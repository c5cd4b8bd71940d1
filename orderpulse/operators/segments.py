"""PDV behaviour segmentation (A28-A30) and the segment roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.dates import floor_days
from orderpulse.functions.numbers import money_sum
from orderpulse.operators.gaps import median_gap, weighted_gaps
from orderpulse.operators.ranks import exact_quantiles, numbered_in_order
from orderpulse.session import materialize, stored_once
from orderpulse.schemas import (
    TRIGGER_MIX, TRIGGER_TURNOVER, TRIGGER_VOLUME, UNCLASSIFIED_SEGMENT,
)


def pdv_vectors(tx: DataFrame) -> DataFrame:
    """Per client: ``mix`` (distinct SKUs), ``volume`` (sum of qty), ``freq``
    (orders per 30 days of active span, span below 30 days counts as one) and
    ``giro_mediano`` (median gap between consecutive rows) (A28)."""
    tx = stored_once(tx, ["client", "sku", "order_id", "qty", "date"]).where(F.col("client").isNotNull())
    v = tx.groupBy("client").agg(
        F.count_distinct("order_id").alias("_orders"),
        F.count_distinct("sku").alias("mix"),
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("volume"),
        F.max("date").alias("_last"), F.min("date").alias("_first"))
    v = v.join(weighted_gaps(tx, ["client"]).groupBy("client").agg(median_gap().alias("giro_mediano")), "client")
    span = floor_days(F.col("_last"), F.col("_first")) / 30.0
    return v.select(
        "client", "mix", "volume",
        (F.col("_orders") / F.greatest(F.lit(1.0), span)).alias("freq"),
        F.coalesce("giro_mediano", F.lit(0.0)).alias("giro_mediano"))


def pdv_baseline(vectors: DataFrame) -> DataFrame:
    """One row: cluster means of the vector and medians of mix and volume."""
    means = vectors.agg(F.avg("mix").alias("mean_mix"), F.avg("volume").alias("mean_volume"),
                        F.avg("freq").alias("mean_freq"), F.avg("giro_mediano").alias("mean_giro"))
    med_mix = exact_quantiles(vectors, "mix", [0.5], ["median_mix"])
    med_vol = exact_quantiles(vectors, "volume", [0.5], ["median_volume"])
    return means.crossJoin(med_mix).crossJoin(med_vol)


def pdv_scores(tx: DataFrame, peso_mix: float = 0.35, peso_volume: float = 0.35,
               peso_frequencia: float = 0.30) -> DataFrame:
    """Per client: ``score``, trigger flags, ``gatilhos`` (texts) and
    ``justificativa`` (A30); ``pdv_order`` numbers them (T03)."""
    # read by the baseline's eager quantile jobs and by the scores: computed once
    v = materialize(pdv_vectors(tx))
    df = v.crossJoin(pdv_baseline(v))                      # baseline is one row
    score = (F.col("mix") / F.greatest(F.lit(1.0), F.col("mean_mix")) * peso_mix
             + F.col("volume") / F.greatest(F.lit(1.0), F.col("mean_volume")) * peso_volume
             + F.col("freq") / F.greatest(F.lit(1.0), F.col("mean_freq")) * peso_frequencia)
    t_mix = F.col("mix") < F.col("median_mix")
    t_vol = F.col("volume") < F.col("median_volume") * 0.5
    t_giro = F.col("giro_mediano") > F.col("mean_giro") * 1.5
    gatilhos = F.filter(F.array(F.when(t_mix, F.lit(TRIGGER_MIX)), F.when(t_vol, F.lit(TRIGGER_VOLUME)),
                                F.when(t_giro, F.lit(TRIGGER_TURNOVER))), lambda x: x.isNotNull())
    return df.select(
        "client", "mix", "volume", "freq", "giro_mediano",
        F.bround(score, 4).alias("score"),
        t_mix.alias("trig_mix"), t_vol.alias("trig_volume"), t_giro.alias("trig_turnover"),
        gatilhos.alias("gatilhos"),
        F.format_string("Mix %d SKUs, volume %.0f itens, freq. %.2f/mês",
                        F.col("mix"), F.bround("volume", 0), F.bround("freq", 2)).alias("justificativa"))


def pdv_order(scores: DataFrame) -> DataFrame:
    """``position`` by falling score, then client."""
    return numbered_in_order(scores, [F.desc_nulls_last("score"), F.asc("client")], "position")


def segment_rollup(tx: DataFrame) -> DataFrame:
    """Per segment (missing -> 'Não classificado'): distinct clients, revenue,
    row count as orders, revenue per row (A15)."""
    seg = F.coalesce(F.col("segment"), F.lit(UNCLASSIFIED_SEGMENT)).alias("segment")
    r = tx.groupBy(seg).agg(
        F.count_distinct("client").alias("total_clients"),
        money_sum(F.col("subtotal")).alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"))
    return r.withColumn("avg_ticket", F.when(F.col("total_orders") > 0,
                                             F.col("total_revenue") / F.col("total_orders"))
                        .otherwise(F.lit(0.0)))
