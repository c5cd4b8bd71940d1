"""Customer and product metrics.

Every function takes canonical transactions (``sources.adapters``) and, where
time matters, an explicit ``reference_date``; all return lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.dates import add_days, floor_days, month_start, ts_literal
from orderpulse.functions.labels import tier
from orderpulse.functions.numbers import cents, money_sum
from orderpulse.operators.gaps import median_gap, weighted_gaps
from orderpulse.operators.ranks import avg_rank_pcts, exact_quantiles
from orderpulse.schemas import DEFAULT_DELAY_DAYS
from orderpulse.session import materialize, stored_once


CUSTOMER_FACTS = ["client", "date", "order_id", "subtotal", "segment", "city", "uf", "ingest_seq"]
PRODUCT_FACTS = ["sku", "date", "order_id", "qty", "subtotal", "product", "ingest_seq"]


def _keyed(tx: DataFrame, key: str) -> DataFrame:
    """pandas ``groupby`` drops null keys; Spark keeps them."""
    return tx.where(F.col(key).isNotNull())


def turnover(tx: DataFrame, keys: list[str], distinct_dates: bool = False,
             name: str = "gm_cliente") -> DataFrame:
    """Median floor-day gap between consecutive rows per key, 0.0 below two rows."""
    # distinct_dates: several lines of one order are one purchase
    g = weighted_gaps(tx, keys, distinct=distinct_dates)
    return g.groupBy(*keys).agg(F.coalesce(median_gap(), F.lit(0.0)).alias(name))


def customer_base(tx: DataFrame, reference_date, distinct_dates: bool = False) -> DataFrame:
    """Per client: recency, frequency, monetary, avg ticket, median turnover,
    last order and the modal segment/city/uf (A01, A02, A03).

    The facts are stored once; one aggregate per client and the weighted gaps read them."""
    ref = ts_literal(reference_date)
    tx = _keyed(stored_once(tx, CUSTOMER_FACTS), "client")
    aggs = [F.max("date").alias("last_order"),
            money_sum(F.col("subtotal")).alias("monetary"), F.mode("segment", True).alias("segment"),
            F.mode("city", True).alias("city"), F.mode("uf", True).alias("uf")]
    # orders are counted apart: beside a distinct count, the modes would keep their maps per client and order
    orders = tx.groupBy("client").agg(F.count_distinct("order_id").alias("frequency"))
    base = (tx.groupBy("client").agg(*aggs).join(orders, "client")
            .join(turnover(tx, ["client"], distinct_dates), "client", "left"))
    return base.select(
        "client",
        floor_days(ref, F.col("last_order")).alias("recency"),
        "frequency", "monetary",
        F.when(F.col("frequency") > 0, F.col("monetary") / F.col("frequency"))
        .otherwise(F.lit(0.0)).alias("avg_ticket"),
        F.coalesce("gm_cliente", F.lit(0.0)).alias("gm_cliente"),
        "segment", "city", "uf", "last_order",
    )


def segment_weights(tx: DataFrame) -> DataFrame:
    """Per client ``segment_weight``.

    Segment weight = 0.5 + 0.5 x revenue share among non-null segments. A client
    seen with several segments takes the one whose first appearance is latest;
    a null segment takes part in that choice and then means weight 1.0."""
    tx = _keyed(tx, "client")
    seg_rev = (tx.where(F.col("segment").isNotNull()).groupBy("segment")
               .agg(money_sum(F.col("subtotal")).alias("_rev")))
    total = seg_rev.agg(F.sum("_rev").alias("_total"))          # one row
    weights = seg_rev.crossJoin(total).select(
        "segment", (F.lit(0.5) + F.col("_rev") / F.nullif("_total", F.lit(0.0)) * 0.5).alias("_w"))
    pair = tx.groupBy("client", "segment").agg(F.min("ingest_seq").alias("_first"))
    chosen = pair.groupBy("client").agg(F.max_by("segment", "_first").alias("segment"))
    return chosen.join(weights, "segment", "left").select(
        "client", F.coalesce("_w", F.lit(1.0)).alias("segment_weight"))


def customer_rfm(tx: DataFrame, reference_date, distinct_dates: bool = False) -> DataFrame:
    """Customer base + segment weight, average-rank percentiles, RFM score and
    tier (A05, W03, P25)."""
    tx = stored_once(tx, CUSTOMER_FACTS)
    base = customer_base(tx, reference_date, distinct_dates)
    # read four times (three ranks + the result): computed once, lineage cut
    df = materialize(base.join(segment_weights(tx), "client", "left"))
    df = avg_rank_pcts(df, {"recency": "_rp", "frequency": "_fp", "monetary": "_mp"})
    score = (F.lit(0.4) * (F.lit(1.0) - F.col("_rp")) + F.lit(0.3) * F.col("_fp")
             + F.lit(0.3) * F.col("_mp")) * F.col("segment_weight")
    return (df.withColumn("rfm_score", score).withColumn("tier", tier(F.col("rfm_score")))
            .drop("_rp", "_fp", "_mp"))


def product_monthly(tx: DataFrame, key: str = "sku") -> DataFrame:
    """Revenue per key and calendar month, present months only."""
    tx = _keyed(tx, key)
    return tx.groupBy(key, month_start(F.col("date")).alias("month")).agg(
        money_sum(F.col("subtotal")).alias("revenue"))


def series_growth(monthly: DataFrame, key: str, value: str = "revenue") -> DataFrame:
    """Last month against earlier months per key.

    ``n_months``; ``last``; ``mean_prev`` and population ``sd_prev`` of the
    earlier months; ``growth_zscore`` (needs 3 months, sd 0 -> 1); ``base_13``
    (13th month from the end) and ``growth_yoy`` (needs 13 months). The window
    is per key over months, so its size is bounded by the calendar span."""
    w = Window.partitionBy(key).orderBy(F.col("month").desc())
    m = monthly.withColumn("_rn", F.row_number().over(w))
    rn = F.col("_rn")
    agg = m.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.max(F.when(rn == 1, F.col(value))).alias("last"),
        F.avg(F.when(rn > 1, F.col(value))).alias("mean_prev"),
        F.stddev_pop(F.when(rn > 1, F.col(value))).alias("sd_prev"),
        F.max(F.when(rn == 13, F.col(value))).alias("base_13"),
    )
    sd = F.when(F.col("sd_prev") == 0, F.lit(1.0)).otherwise(F.col("sd_prev"))
    return agg.select(
        "*",
        F.when(F.col("n_months") >= 3, (F.col("last") - F.col("mean_prev")) / sd)
        .otherwise(F.lit(0.0)).alias("growth_zscore"),
        F.when(F.col("n_months") >= 13, (F.col("last") - F.col("base_13"))
               / F.greatest(F.lit(1.0), F.col("base_13")) * 100).otherwise(F.lit(0.0))
        .alias("growth_yoy"),
    )


def hero_threshold(tx: DataFrame, key: str = "sku", q: float = 0.8) -> DataFrame:
    """One row: ``hero_threshold`` = linear ``q`` quantile of revenue per key."""
    # the quantile runs eager jobs on it: compute the per-key table once
    rev = materialize(_keyed(tx, key).groupBy(key).agg(money_sum(F.col("subtotal")).alias("revenue")))
    return exact_quantiles(rev, "revenue", [q], ["hero_threshold"]) \
        .select(F.coalesce("hero_threshold", F.lit(0.0)).alias("hero_threshold"))


def product_analytics(tx: DataFrame, distinct_dates: bool = False) -> DataFrame:
    """Per SKU: orders, qty, revenue, avg ticket, median turnover, first product
    name by date, hero flag, growth z-score and YoY (A06-A10, J08)."""
    tx = _keyed(stored_once(tx, PRODUCT_FACTS), "sku")
    aggs = [F.count_distinct("order_id").alias("orders"),
            F.coalesce(F.sum("qty"), F.lit(0.0)).cast("long").alias("qty"),
            money_sum(F.col("subtotal")).alias("revenue"),
            F.min_by("product", F.struct("date", "ingest_seq", "product")).alias("_first_product")]
    base = tx.groupBy("sku").agg(*aggs).join(
        turnover(tx, ["sku"], distinct_dates, name="turnover_median"), "sku", "left")
    # read by the eager quantile jobs and by the result: computed once
    base = materialize(base)
    growth = series_growth(product_monthly(tx), "sku").select("sku", "growth_zscore", "growth_yoy")
    # hero threshold from the per-SKU revenue computed above (one row)
    hero = exact_quantiles(base.select("revenue"), "revenue", [0.8], ["hero_threshold"]) \
        .select(F.coalesce("hero_threshold", F.lit(0.0)).alias("hero_threshold"))
    df = base.join(growth, "sku", "left").crossJoin(hero)
    return df.select(
        "sku",
        F.coalesce(F.nullif(F.col("_first_product"), F.lit("")), F.col("sku")).alias("product"),
        "orders", "qty", "revenue",
        F.when(F.col("orders") > 0, F.col("revenue") / F.col("orders")).alias("avg_ticket"),
        F.coalesce("turnover_median", F.lit(0.0)).alias("turnover_median"),
        (F.col("revenue") >= F.col("hero_threshold")).alias("hero_mix"),
        F.coalesce("growth_zscore", F.lit(0.0)).alias("growth_zscore"),
        F.coalesce("growth_yoy", F.lit(0.0)).alias("growth_yoy"),
    )


def projected_stockout(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS,
                       distinct_dates: bool = False) -> DataFrame:
    """Per client: days from the reference date to last order + turnover + delay."""
    ref = ts_literal(reference_date)
    tx = _keyed(tx, "client")
    df = weighted_gaps(tx, ["client"], distinct=distinct_dates).groupBy("client").agg(
        F.max("last_ts").alias("last_order"), F.coalesce(median_gap(), F.lit(0.0)).alias("gm_cliente"))
    projected = add_days(F.col("last_order"), F.col("gm_cliente") + F.lit(float(delay)))
    return df.select("client", "last_order", "gm_cliente",
                     floor_days(projected, ref).alias("projected_days"))


def general_kpis(tx: DataFrame, reference_date, delay: int = DEFAULT_DELAY_DAYS,
                 distinct_dates: bool = False) -> DataFrame:
    """One row of general KPIs."""
    ref = ts_literal(reference_date)
    tx = stored_once(tx, ["client", "sku", "order_id", "date", "subtotal"])
    # one row per client and order serves all counts of both, so no row is repeated per distinct count
    pairs = stored_once(tx.groupBy("client", "order_id").agg(
        F.sum(cents(F.col("subtotal"))).alias("_cents"), F.min("date").alias("_first"), F.max("date").alias("_last")))
    glob = pairs.agg(
        F.coalesce(F.sum("_cents") / F.lit(100.0), F.lit(0.0)).alias("total_revenue"),
        F.count_distinct("client").alias("total_customers"),
        F.count_distinct("order_id").alias("total_orders"),
        F.min("_first").alias("period_start"),
        F.max("_last").alias("period_end"),
    ).crossJoin(tx.agg(F.count_distinct("sku").alias("total_products")))
    per_client = (_keyed(pairs, "client").groupBy("client")
                  .agg(F.max("_last").alias("_last"), F.count("order_id").alias("_freq")))
    client_avgs = per_client.agg(
        F.coalesce(F.avg(floor_days(ref, F.col("_last"))), F.lit(0.0)).alias("avg_recency"),
        F.coalesce(F.avg("_freq"), F.lit(0.0)).alias("avg_frequency"))
    rupture = projected_stockout(tx, reference_date, delay, distinct_dates).agg(
        F.coalesce(F.avg("projected_days"), F.lit(0.0)).alias("ruptura_projetada_media"))
    df = glob.crossJoin(client_avgs).crossJoin(rupture)
    return df.select(
        "total_revenue", "total_customers", "total_products", "total_orders",
        F.when(F.col("total_orders") > 0, F.col("total_revenue") / F.col("total_orders"))
        .otherwise(F.lit(0.0)).alias("avg_ticket"),
        "avg_recency", "avg_frequency", "period_start", "period_end",
        F.coalesce(floor_days(F.col("period_end"), F.col("period_start")), F.lit(0)).alias("period_days"),
        "ruptura_projetada_media",
    )


def monthly_history(tx: DataFrame) -> DataFrame:
    """Per calendar month: revenue, distinct orders and clients, volume, ticket."""
    h = tx.groupBy(month_start(F.col("date")).alias("periodo")).agg(
        money_sum(F.col("subtotal")).alias("receita_total"),
        F.count_distinct("order_id").alias("pedidos"),
        F.count_distinct("client").alias("clientes"),
        F.coalesce(F.sum("qty"), F.lit(0.0)).alias("volume"),
    )
    return h.withColumn("ticket_medio", F.when(F.col("pedidos") > 0,
                                               F.col("receita_total") / F.col("pedidos"))
                        .otherwise(F.lit(0.0)))


def behaviour_sheet(kpis: DataFrame, rfm: DataFrame) -> DataFrame:
    """KPI rows plus one ``Clientes <tier>`` row per tier (A14): ``position, indicador, valor``; tiers by
    falling count, then name (T10)."""
    k = kpis.select(F.expr(
        "stack(5, 'Total de clientes', CAST(total_customers AS DOUBLE),"
        " 'Total de SKUs', CAST(total_products AS DOUBLE),"
        " 'Total de pedidos', CAST(total_orders AS DOUBLE),"
        " 'Ticket médio', bround(avg_ticket, 2),"
        " 'Ruptura projetada média (dias)', bround(ruptura_projetada_media, 2))"
        " AS (indicador, valor)"))
    names = ("Total de clientes", "Total de SKUs", "Total de pedidos", "Ticket médio", "Ruptura projetada média (dias)")
    place = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))]), F.col("indicador"))
    # one row per tier: a window over them is small
    tiers = rfm.groupBy("tier").agg(F.count(F.lit(1)).alias("_n"))
    tiers = tiers.select(
        (F.row_number().over(Window.orderBy(F.desc("_n"), "tier")) + len(names)).alias("position"),
        F.concat(F.lit("Clientes "), F.col("tier")).alias("indicador"),
        F.col("_n").cast("double").alias("valor"))
    return k.select(place.alias("position"), "indicador", "valor").unionByName(tiers)
