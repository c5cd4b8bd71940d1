"""Dataset summaries, panel tables and top-k reports (A16, A17, A19-A22, A31,
A32, T04-T09).

Top-k results use ``orderBy(...).limit(k)`` (TakeOrderedAndProject: each task
keeps k rows, the driver merges k x tasks). Global rankings over all SKUs use
the distributed rank table of ``ranks`` instead of a single-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.dates import floor_days
from orderpulse.functions.numbers import money_sum
from orderpulse.operators.metrics import customer_base, general_kpis, hero_threshold
from orderpulse.operators.ranks import exact_quantiles, numbered_in_order, value_ranks
from orderpulse.session import materialize, stored_once


def product_totals(tx: DataFrame, keys=("sku", "product")) -> DataFrame:
    return tx.groupBy(*keys).agg(money_sum(F.col("subtotal")).alias("revenue"),
                                 F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))


def top_products(tx: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` (sku, product) by revenue (ties: sku, product)."""
    return (product_totals(tx).orderBy(F.col("revenue").desc(), "sku", "product").limit(k)
            .select("sku", "product", "revenue", F.col("qty").cast("long").alias("qty")))


def regions(tx: DataFrame) -> DataFrame:
    """One row, ``regioes`` = sorted distinct non-empty UFs (distinct first, then collected)."""
    d = tx.where(F.col("uf").isNotNull() & (F.col("uf") != "")).select("uf").distinct()
    return d.agg(F.array_sort(F.collect_list("uf")).alias("regioes"))


def dataset_summary(tx: DataFrame, reference_date, top_k: int = 5) -> DataFrame:
    """One row with clients, SKUs, period, regions, hero revenue share and top products."""
    # read by six aggregates
    tx = stored_once(tx, ["client", "sku", "product", "order_id", "date", "subtotal", "qty", "uf"])
    k = general_kpis(tx, reference_date)
    sku_rev = tx.where(F.col("sku").isNotNull()).groupBy("sku").agg(
        money_sum(F.col("subtotal")).alias("revenue"))
    thr = hero_threshold(tx)
    hero = sku_rev.crossJoin(thr).agg(
        F.sum(F.when(F.col("revenue") >= F.col("hero_threshold"), F.col("revenue"))).alias("_hv"),
        F.sum("revenue").alias("_all"), F.first("hero_threshold").alias("_thr"))
    hero_value = F.when(F.col("_thr") != 0, F.coalesce("_hv", F.lit(0.0))) \
        .otherwise(F.coalesce("_all", F.lit(0.0)))
    tops = top_products(tx, top_k).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("revenue")).alias("_o"), "sku", "product", "revenue", "qty"))).alias("_t"))
    df = k.crossJoin(hero).crossJoin(regions(tx)).crossJoin(tops)
    return df.select(
        F.col("total_customers").alias("n_clientes"), F.col("total_products").alias("n_skus"),
        F.col("period_start").alias("inicio"), F.col("period_end").alias("fim"),
        F.when(F.col("period_days") != 0, F.floor(F.col("period_days") / 30)).otherwise(0)
        .cast("long").alias("meses"),
        "regioes", "total_revenue", hero_value.alias("hero_share_value"),
        F.when(F.col("total_revenue") != 0, hero_value / F.col("total_revenue")).otherwise(0.0)
        .alias("hero_share_ratio"),
        F.transform("_t", lambda s: s.dropFields("_o")).alias("top_products"))


def first_values(tx: DataFrame, col: str, k: int = 10, seq: str = "ingest_seq") -> DataFrame:
    """The first ``k`` distinct non-null values in arrival order, then sorted."""
    firsts = tx.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(seq).alias("_s"))
    return firsts.orderBy("_s").limit(k).select(col).orderBy(col)


def top_counts(tx: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent non-null values (ties by value)."""
    return (tx.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), col).limit(k))


def light_summary(tx: DataFrame, cnpj_col: str | None = None) -> DataFrame:
    """Distinct clients / CNPJs / products, first and last date, inclusive
    month span (at least 1). UF, city and category lists: ``first_values`` and
    ``top_counts``."""
    aggs = [F.count_distinct("client").alias("n_clientes"),
            (F.count_distinct(cnpj_col) if cnpj_col else F.lit(0).cast("long")).alias("n_cnpjs"),
            F.count_distinct("product").alias("n_produtos"),
            F.min("date").alias("_mn"), F.max("date").alias("_mx")]
    a = tx.agg(*aggs)
    months = (F.year("_mx") - F.year("_mn")) * 12 + F.month("_mx") - F.month("_mn") + 1
    return a.select("n_clientes", "n_cnpjs", "n_produtos",
                    F.date_format("_mn", "yyyy-MM-dd").alias("inicio"),
                    F.date_format("_mx", "yyyy-MM-dd").alias("fim"),
                    F.coalesce(F.greatest(F.lit(1), months), F.lit(0)).cast("long").alias("meses"))


def dataset_overview(tx: DataFrame, cnpj_col: str | None = None, k: int = 10) -> DataFrame:
    """A17 whole, as one row from one scan: ``light_summary``'s scalars and ``ufs`` (first ``k`` in arrival
    order, sorted), ``cidades_top`` and ``categorias_top`` (``k`` most frequent, ties by value).

    Every row is unpivoted to (column, value) and counted, combined map-side, so a value that a
    third of all rows share is one row. The best of a column come in two steps, first of each of
    its 64 parts: no task sorts all values of a column."""
    cols = {"cliente": "client", "cnpj": cnpj_col, "produto": "product", "uf": "uf", "cidade": "city", "categoria": "category"}
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), (F.col(c) if c else F.lit(None)).cast("string").alias("value"))
                      for name, c in cols.items()])
    values = materialize(tx.select("date", "ingest_seq", F.inline(pairs)).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("ingest_seq").alias("first"), F.min("date").alias("mn"), F.max("date").alias("mx")))
    part = F.pmod(F.xxhash64("value"), F.lit(64))

    def best(column: str, order: list[Column]) -> Column:
        return F.row_number().over(Window.partitionBy("column", *([part] if column == "part" else [])).orderBy(*order))
    lists = values.where(F.col("value").isNotNull() & F.col("column").isin("uf", "cidade", "categoria"))
    order = [F.when(F.col("column") == "uf", F.col("first")).otherwise(-F.col("n")), F.col("value")]
    for level in ("part", "column"):
        lists = lists.withColumn("place", best(level, order)).where(F.col("place") <= k)
    lists = lists.agg(*[F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("place", "value")))).alias(c)
                        for c in ("uf", "cidade", "categoria")])                # at most k values each
    counted = [F.count(F.when(F.col("column") == c, F.col("value"))).alias(f"n_{c}") for c in ("cliente", "cnpj", "produto")]
    a = values.agg(*counted, F.min("mn").alias("_mn"), F.max("mx").alias("_mx")).crossJoin(lists)
    months = (F.year("_mx") - F.year("_mn")) * 12 + F.month("_mx") - F.month("_mn") + 1
    return a.select(
        F.col("n_cliente").alias("n_clientes"), F.col("n_cnpj").alias("n_cnpjs"), F.col("n_produto").alias("n_produtos"),
        F.date_format("_mn", "yyyy-MM-dd").alias("inicio"), F.date_format("_mx", "yyyy-MM-dd").alias("fim"),
        F.coalesce(F.greatest(F.lit(1), months), F.lit(0)).cast("long").alias("meses"),
        F.array_sort(F.col("uf.value")).alias("ufs"), F.col("cidade.value").alias("cidades_top"),
        F.col("categoria.value").alias("categorias_top"))


def panel_kpis(tx: DataFrame) -> DataFrame:
    """Revenue, customers, products, orders, avg ticket."""
    a = tx.agg(money_sum(F.col("subtotal")).alias("total_revenue"),
               F.count_distinct("client").alias("total_customers"),
               F.count_distinct("sku").alias("total_products"),
               F.count_distinct("order_id").alias("total_orders"))
    return a.withColumn("avg_ticket", F.when(F.col("total_orders") > 0,
                                             F.col("total_revenue") / F.col("total_orders"))
                        .otherwise(F.lit(0.0)))


def rfm_summary(customers: DataFrame,
                metrics=("recency", "frequency", "monetary", "avg_ticket")) -> DataFrame:
    """Mean, median, min, max of each metric over customers (one row per metric).

    Medians come from the distributed rank table, not a per-group value map."""
    customers = materialize(customers)          # four metrics read it
    rows = None
    for m in metrics:
        a = customers.agg(F.avg(m).alias("mean"), F.min(F.col(m).cast("double")).alias("min"),
                          F.max(F.col(m).cast("double")).alias("max"))
        med = exact_quantiles(customers, m, [0.5], ["median"])
        r = a.crossJoin(med).select(F.lit(m).alias("metric"), "mean", "median", "min", "max")
        rows = r if rows is None else rows.unionByName(r)
    return rows


def product_radar(tx: DataFrame) -> DataFrame:
    """Per (sku, product) revenue, qty, distinct orders and clients, and
    penetration = clients / all clients x 100."""
    total = tx.agg(F.count_distinct("client").alias("_all"))
    p = tx.groupBy("sku", "product").agg(
        money_sum(F.col("subtotal")).alias("revenue"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"),
        F.count_distinct("order_id").alias("orders"), F.count_distinct("client").alias("clients"))
    return p.crossJoin(total).select(
        "sku", "product", "revenue", "qty", "orders", "clients",
        F.when(F.col("_all") > 0, F.col("clients") / F.col("_all") * 100).otherwise(F.lit(0.0))
        .alias("penetration"))


def client_sku_potential(tx: DataFrame) -> DataFrame:
    """Subtotal and qty per (client, sku); sort ``client asc, subtotal desc`` at the sink."""
    return tx.groupBy("client", "sku").agg(money_sum(F.col("subtotal")).alias("subtotal"),
                                           F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))


def potential_order(potential: DataFrame) -> DataFrame:
    """``position`` by client, then falling subtotal (ties by SKU)."""
    return numbered_in_order(potential, [F.asc_nulls_last("client"), F.desc_nulls_last("subtotal"), F.asc_nulls_last("sku")],
                             "position")


def kpi_payload(customers: DataFrame) -> DataFrame:
    """Client count, rounded mean recency, mean frequency (1 place), mean
    ticket (2 places), all floored at zero; Python rounding is half-even."""
    a = customers.agg(F.count(F.lit(1)).alias("total_clients"), F.avg("recency").alias("_r"),
                      F.avg("frequency").alias("_f"), F.avg("avg_ticket").alias("_t"))
    return a.select(
        "total_clients",
        F.greatest(F.lit(0), F.coalesce(F.bround("_r", 0), F.lit(0.0)).cast("long")).alias("avg_recency_days"),
        F.greatest(F.lit(0.0), F.coalesce(F.bround("_f", 1), F.lit(0.0))).alias("avg_frequency"),
        F.greatest(F.lit(0.0), F.coalesce(F.bround("_t", 2), F.lit(0.0))).alias("avg_value"))


def product_ranking(tx: DataFrame, by: str = "receita") -> DataFrame:
    """Every SKU ranked by revenue (``receita``), quantity (``quantidade``)
    or distinct orders (``pedidos``); rank 1 is the largest, ties share a rank.

    The rank comes from the distributed value-rank table, so no single task
    sorts all SKUs."""
    metric = {"receita": money_sum(F.col("subtotal")), "quantidade": F.sum("qty"),
              "pedidos": F.count_distinct("order_id")}[by]
    p = materialize(tx.where(F.col("sku").isNotNull()).groupBy("sku").agg(metric.alias("value")))
    r = value_ranks(p, "value")
    r = r.select(F.col("v").alias("value"), (F.col("n") - F.col("below") - F.col("c") + 1).alias("rank"))
    return p.join(r, "value", "left").select("sku", "value", "rank")


