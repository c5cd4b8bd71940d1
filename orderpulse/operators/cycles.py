"""Purchase-cycle model (D01-D07, D09): documented targets of the reference.

A purchase is a distinct (key, calendar day); the cycle of a key is the median
floor-day gap between its consecutive purchase days (robust to outliers, D05),
its mean gap is reported next to it. Weights and thresholds the documents leave
open are ours and named as parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.functions.dates import add_days, floor_days, ts_literal
from orderpulse.functions.numbers import money_sum
from orderpulse.operators.gaps import gap_cv, mean_gap, median_gap, rows_with_gap, weighted_gaps
from orderpulse.operators.ranks import avg_rank_pcts, numbered_in_order
from orderpulse.session import stored_once

# Window-status bounds on days_since / cycle (fixed by the documents).
STATUS_BOUNDS = [(0.50, "frio"), (0.80, "aquecimento")]
STATUS_ATTACK_MAX = 1.20
# Ours: below this many distinct purchase days the history is insufficient.
MIN_PURCHASE_DAYS = 3
# Ours: priority weights (D06) and status scores.
PRIORITY_WEIGHTS = {"status": 0.40, "value": 0.25, "frequency": 0.20, "confidence": 0.15}
STATUS_SCORE = {"ataque": 1.0, "risco": 0.8, "aquecimento": 0.5, "frio": 0.2, "insufficient_history": 0.0}
RISK_LEVEL = {"risco": "alto", "ataque": "medio", "aquecimento": "baixo", "frio": "baixo",
              "insufficient_history": "indefinido"}
# Ours: instability alert (D09) = CV of gaps above this with at least MIN_GAPS gaps.
INSTABILITY_CV = 1.0
INSTABILITY_MIN_GAPS = 4


def cycle_metrics(tx: DataFrame, keys: Sequence[str], reference_date) -> DataFrame:
    """D01 (keys = client) / D02 (keys = client, sku): last order, days since,
    orders, revenue, ticket, avg qty, cycle (median gap of purchase days),
    mean gap, expected next date, cycle consumption, delay vs cycle, gap CV."""
    keys = list(keys)
    ref = ts_literal(reference_date)
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    t = stored_once(tx, [*keys, "date", "order_id", "subtotal", "qty"]).where(present)
    day = t.select(*keys, F.to_timestamp_ntz(F.col("date").cast("date")).alias("date"))
    g = weighted_gaps(day, keys, distinct=True).groupBy(*keys).agg(
        F.sum("weight").alias("purchase_days"), median_gap().alias("cycle_days"), mean_gap().alias("mean_gap"),
        gap_cv().alias("gap_cv"), rows_with_gap().alias("n_gaps"))
    base = t.groupBy(*keys).agg(
        F.max("date").alias("last_order"), F.count_distinct("order_id").alias("orders"),
        money_sum(F.col("subtotal")).alias("revenue"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("_qty"))
    df = base.join(g, keys, "left")
    since = floor_days(ref, F.col("last_order"))
    cyc = F.col("cycle_days")
    return df.select(
        *keys, "last_order", since.alias("days_since"), "orders", "revenue",
        (F.col("revenue") / F.col("orders")).alias("avg_ticket"),
        (F.col("_qty") / F.col("orders")).alias("avg_qty"), "purchase_days", "n_gaps",
        cyc.alias("cycle_days"), "mean_gap", "gap_cv",
        F.when(cyc > 0, add_days(F.col("last_order"), cyc)).alias("expected_next"),
        F.when(cyc > 0, since / cyc * 100).alias("cycle_consumption_pct"),
        F.when(cyc > 0, since - cyc).alias("delay_days"))


def window_status(cycles: DataFrame, min_purchase_days: int = MIN_PURCHASE_DAYS) -> DataFrame:
    """Status from days_since / cycle: < .50 frio, < .80 aquecimento,
    <= 1.20 ataque, > 1.20 risco; no cycle or too few purchase days ->
    insufficient_history (never attacked automatically)."""
    ratio = F.col("days_since") / F.col("cycle_days")
    insufficient = (F.col("purchase_days") < min_purchase_days) | F.col("cycle_days").isNull() | \
        (F.col("cycle_days") == 0)
    status = (F.when(insufficient, "insufficient_history")
              .when(ratio < STATUS_BOUNDS[0][0], STATUS_BOUNDS[0][1])
              .when(ratio < STATUS_BOUNDS[1][0], STATUS_BOUNDS[1][1])
              .when(ratio <= STATUS_ATTACK_MAX, "ataque").otherwise("risco"))
    return cycles.withColumn("cycle_ratio", F.when(~insufficient, ratio)).withColumn("status", status)


def _map_col(c, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def priority_items(tx: DataFrame, reference_date, keys: Sequence[str] = ("client", "sku"),
                   weights: dict = PRIORITY_WEIGHTS) -> DataFrame:
    """Priority score = status score, value rank, frequency rank and
    confidence (1 / (1 + gap CV)) weighted; risk level; diagnosis, action and
    message texts. Ranks are global average-rank percentiles (distributed)."""
    # ranked twice and returned: computed once, each ranking scans its column
    st = stored_once(window_status(cycle_metrics(tx, keys, reference_date)))
    st = avg_rank_pcts(st, {"revenue": "value_rank", "orders": "frequency_rank"})
    conf = F.when(F.col("status") == "insufficient_history", F.lit(0.0)) \
        .otherwise(1.0 / (1.0 + F.coalesce(F.col("gap_cv"), F.lit(0.0))))
    st = st.withColumn("confidence", conf)
    score = (weights["status"] * _map_col(F.col("status"), STATUS_SCORE, 0.0)
             + weights["value"] * F.col("value_rank") + weights["frequency"] * F.col("frequency_rank")
             + weights["confidence"] * F.col("confidence"))
    st = st.withColumn("priority_score", score) \
        .withColumn("risk_level", _map_col(F.col("status"), RISK_LEVEL, "indefinido"))
    label = F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys])
    return st.withColumn("diagnosis", F.format_string(
        "%s: %d dias desde a última compra, ciclo de %.0f dias (%s).", label, F.col("days_since"),
        F.coalesce(F.col("cycle_days"), F.lit(0.0)), F.col("status"))) \
        .withColumn("action", _map_col(F.col("status"), {
            "ataque": "Contatar agora: janela de recompra aberta.",
            "risco": "Recuperar: compra atrasada em relação ao ciclo.",
            "aquecimento": "Preparar oferta para a próxima janela.",
            "frio": "Aguardar: ciclo recém-iniciado.",
            "insufficient_history": "Coletar mais histórico antes de agir."}, "")) \
        .withColumn("message", F.concat(F.col("action"), F.lit(" "), F.col("diagnosis")))


def operational_list(items: DataFrame, status: str | None = None, client: str | None = None,
                     sku: str | None = None, risk_level: str | None = None,
                     min_confidence: float | None = None) -> DataFrame:
    """Filtered priority list, highest priority first."""
    for col, val in (("status", status), ("client", client), ("sku", sku), ("risk_level", risk_level)):
        if val is not None:
            items = items.where(F.col(col) == val)
    if min_confidence is not None:
        items = items.where(F.col("confidence") >= min_confidence)
    return items.orderBy(F.desc("priority_score"), *[F.col(k) for k in ("client", "sku") if k in items.columns])


def priority_order(items: DataFrame) -> DataFrame:
    """D07 as a column: ``position`` by falling priority, then client and SKU."""
    keys = [F.asc_nulls_last(k) for k in ("client", "sku") if k in items.columns]
    return numbered_in_order(items, [F.desc_nulls_last("priority_score"), *keys], "position")


def instability(cycles: DataFrame, cv_limit: float = INSTABILITY_CV,
                min_gaps: int = INSTABILITY_MIN_GAPS) -> DataFrame:
    """Keys whose purchase gaps oscillate too much (CV above the limit)."""
    return cycles.where((F.col("n_gaps") >= min_gaps) & (F.col("gap_cv") > cv_limit)) \
        .withColumn("type", F.lit("instabilidade"))


def cohort_retention(tx: DataFrame) -> DataFrame:
    """First-purchase month cohort x month offset -> active clients, cohort
    size and retention; ``retention_map`` gives one map per cohort."""
    t = tx.where(F.col("client").isNotNull())
    month = F.trunc(F.col("date").cast("date"), "month")
    active = t.select("client", month.alias("month")).distinct()
    first = active.groupBy("client").agg(F.min("month").alias("cohort"))
    a = active.join(first, "client")
    offset = (F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort")
    counts = a.groupBy("cohort", offset.alias("month_offset")).agg(F.count(F.lit(1)).alias("active"))
    size = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    return counts.join(size, "cohort").withColumn("retention", F.col("active") / F.col("cohort_size"))


def retention_maps(retention: DataFrame) -> DataFrame:
    """D08 as the declared model: ``cohort -> map<month offset, retention>``
    (a cohort has at most one entry per calendar month, so each map is small)."""
    return retention.groupBy("cohort").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("month_offset").cast("string"), F.col("retention")))).alias("retention_map"))
