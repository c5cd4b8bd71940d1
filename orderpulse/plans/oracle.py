"""Oracle SQL (DuckDB) for every registered query that SQL can express."""

from __future__ import annotations

from orderpulse.plans.sqlparts import (
    EVENTS_REF, TPCH_REF, TX, add_days, avg_rank, fd, gaps_cte, mode_cte, msum,
)

ORACLE: dict[str, str] = {}


def _customer_base_sql(adapter: str) -> str:
    return f"""
WITH tx AS ({TX[adapter]}),
t AS (SELECT * FROM tx WHERE client IS NOT NULL),
g AS ({gaps_cte('client', 't')}),
gm AS (SELECT client, CAST(median(gap) AS DOUBLE) AS gm FROM g GROUP BY client),
seg AS ({mode_cte('client', 'segment', 't')}),
city AS ({mode_cte('client', 'city', 't')}),
uf AS ({mode_cte('client', 'uf', 't')}),
b AS (SELECT client, max(date) AS last_order, count(DISTINCT order_id) AS frequency,
             {msum('subtotal')} AS monetary FROM t GROUP BY client)
SELECT b.client, {fd(TPCH_REF, 'b.last_order')} AS recency, b.frequency,
       round(b.monetary, 2) AS monetary,
       CASE WHEN b.frequency > 0 THEN b.monetary / b.frequency ELSE 0.0 END AS avg_ticket,
       round(coalesce(gm.gm, 0.0), 4) AS gm_cliente, seg.segment, city.city, uf.uf, b.last_order
FROM b LEFT JOIN gm USING (client) LEFT JOIN seg USING (client)
LEFT JOIN city USING (client) LEFT JOIN uf USING (client)
"""


ORACLE["customer_base"] = _customer_base_sql("tpch_orders")
ORACLE["customer_base_lines"] = _customer_base_sql("tpch")


def _rfm_ctes(adapter: str) -> str:
    return f"""
tx AS ({TX[adapter]}),
t AS (SELECT * FROM tx WHERE client IS NOT NULL),
b AS (SELECT client, {fd(TPCH_REF, 'max(date)')} AS recency, count(DISTINCT order_id) AS frequency,
             {msum('subtotal')} AS monetary FROM t GROUP BY client),
sr AS (SELECT segment, {msum('subtotal')} AS rev FROM t WHERE segment IS NOT NULL GROUP BY segment),
sw AS (SELECT segment, 0.5 + rev / nullif((SELECT sum(rev) FROM sr), 0.0) * 0.5 AS w FROM sr),
pf AS (SELECT client, segment, min(ingest_seq) AS f FROM t GROUP BY client, segment),
cs AS (SELECT client, arg_max(segment, f) AS segment FROM pf GROUP BY client),
cw AS (SELECT cs.client, coalesce(sw.w, 1.0) AS segment_weight FROM cs LEFT JOIN sw USING (segment)),
r AS (SELECT b.*, cw.segment_weight, {avg_rank('recency')} AS rp, {avg_rank('frequency')} AS fp,
             {avg_rank('monetary')} AS mp FROM b LEFT JOIN cw USING (client)),
s AS (SELECT *, (0.4 * (1 - rp) + 0.3 * fp + 0.3 * mp) * segment_weight AS rfm_score FROM r),
rfm AS (
  SELECT client, recency, frequency, round(monetary, 2) AS monetary,
         round(segment_weight, 8) AS segment_weight, round(rfm_score, 8) AS rfm_score,
         CASE WHEN rfm_score >= 0.85 THEN 'hero' WHEN rfm_score >= 0.65 THEN 'growth'
              WHEN rfm_score >= 0.45 THEN 'manter' ELSE 'risco' END AS tier
  FROM s)
"""


def _rfm_sql(adapter: str, cols: str) -> str:
    return f"WITH {_rfm_ctes(adapter)} SELECT {cols} FROM rfm"


ORACLE["customer_rfm"] = _rfm_sql(
    "tpch", "client, recency, frequency, monetary, segment_weight, rfm_score, tier")
ORACLE["customer_rfm_orders"] = _rfm_sql("tpch_orders", "client, segment_weight, rfm_score, tier")


# --- products, KPIs, history -------------------------------------------------

def _growth_ctes(key: str, source: str) -> str:
    return f"""
mon AS (SELECT {key}, CAST(date_trunc('month', date) AS DATE) AS month,
               {msum('subtotal')} AS revenue FROM {source} GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY month DESC) AS rn FROM mon),
gr AS (SELECT {key}, count(*) AS n_months, max(CASE WHEN rn = 1 THEN revenue END) AS last,
              avg(CASE WHEN rn > 1 THEN revenue END) AS mp,
              stddev_pop(CASE WHEN rn > 1 THEN revenue END) AS sp,
              max(CASE WHEN rn = 13 THEN revenue END) AS b13 FROM mr GROUP BY {key}),
grz AS (SELECT {key}, n_months,
               CASE WHEN n_months >= 3 THEN (last - mp) / (CASE WHEN sp = 0 THEN 1.0 ELSE sp END)
                    ELSE 0.0 END AS growth_zscore,
               CASE WHEN n_months >= 13 THEN (last - b13) / greatest(1.0, b13) * 100 ELSE 0.0 END
                    AS growth_yoy FROM gr)
"""


def _product_sql(sku_expr: str) -> str:
    tx = TX["tpch"].replace("p.p_brand AS sku", f"{sku_expr} AS sku")
    return f"""
WITH tx AS ({tx}), t AS (SELECT * FROM tx WHERE sku IS NOT NULL),
g AS ({gaps_cte('sku', 't')}),
gm AS (SELECT sku, CAST(median(gap) AS DOUBLE) AS gm FROM g GROUP BY sku),
b AS (SELECT sku, count(DISTINCT order_id) AS orders, CAST(trunc(coalesce(sum(qty), 0)) AS BIGINT) AS qty,
             {msum('subtotal')} AS revenue, first(product ORDER BY date, ingest_seq, product) AS fp
      FROM t GROUP BY sku),
hero AS (SELECT coalesce(quantile_cont(revenue, 0.8), 0.0) AS thr FROM b),
{_growth_ctes('sku', 't')}
SELECT b.sku, coalesce(nullif(b.fp, ''), b.sku) AS product, b.orders, b.qty, round(b.revenue, 2) AS revenue,
       CASE WHEN b.orders > 0 THEN b.revenue / b.orders END AS avg_ticket,
       round(coalesce(gm.gm, 0.0), 4) AS turnover_median, b.revenue >= hero.thr AS hero_mix,
       round(coalesce(grz.growth_zscore, 0.0), 6) AS growth_zscore,
       round(coalesce(grz.growth_yoy, 0.0), 6) AS growth_yoy
FROM b LEFT JOIN gm USING (sku) LEFT JOIN grz USING (sku) CROSS JOIN hero
"""


ORACLE["product_analytics"] = _product_sql("p.p_brand")
ORACLE["product_analytics_part"] = _product_sql("CAST(l.l_partkey AS VARCHAR)")

ORACLE["product_monthly"] = f"""
WITH tx AS ({TX['tpch']})
SELECT sku, CAST(date_trunc('month', date) AS DATE) AS month, round({msum('subtotal')}, 2) AS revenue
FROM tx WHERE sku IS NOT NULL GROUP BY ALL
"""

ORACLE["client_growth"] = f"""
WITH tx AS ({TX['tpch']}), t AS (SELECT * FROM tx WHERE client IS NOT NULL),
{_growth_ctes('client', 't')}
SELECT client, n_months, round(growth_zscore, 6) AS growth_zscore, round(growth_yoy, 6) AS growth_yoy FROM grz
"""

ORACLE["hero_threshold"] = f"""
WITH tx AS ({TX['tpch'].replace("p.p_brand AS sku", "CAST(l.l_partkey AS VARCHAR) AS sku")}),
rev AS (SELECT sku, {msum('subtotal')} AS revenue FROM tx WHERE sku IS NOT NULL GROUP BY sku)
SELECT round(coalesce(quantile_cont(revenue, 0.8), 0.0), 4) AS hero_threshold FROM rev
"""


def _kpi_ctes(adapter: str) -> str:
    return f"""
tx AS ({TX[adapter]}), t AS (SELECT * FROM tx WHERE client IS NOT NULL),
gl AS (SELECT {msum('subtotal')} AS total_revenue, count(DISTINCT client) AS total_customers,
                count(DISTINCT sku) AS total_products, count(DISTINCT order_id) AS total_orders,
                min(date) AS ps, max(date) AS pe FROM tx),
pc AS (SELECT client, max(date) AS last, count(DISTINCT order_id) AS freq FROM t GROUP BY client),
ca AS (SELECT avg({fd(TPCH_REF, 'last')}) AS avg_recency, avg(freq) AS avg_frequency FROM pc),
g AS ({gaps_cte('client', 't')}),
gm AS (SELECT client, coalesce(CAST(median(gap) AS DOUBLE), 0.0) AS gm FROM g GROUP BY client),
rp AS (SELECT avg({fd(add_days('pc.last', 'gm.gm + 20'), TPCH_REF)}) AS r FROM pc JOIN gm USING (client)),
kpi AS (SELECT total_revenue, total_customers, total_products, total_orders,
               CASE WHEN total_orders > 0 THEN total_revenue / total_orders ELSE 0.0 END AS avg_ticket,
               coalesce(avg_recency, 0.0) AS avg_recency, coalesce(avg_frequency, 0.0) AS avg_frequency,
               ps AS period_start, pe AS period_end, coalesce({fd('pe', 'ps')}, 0) AS period_days,
               coalesce(r, 0.0) AS ruptura_projetada_media FROM gl, ca, rp)
"""


def _kpi_sql(adapter: str) -> str:
    return f"""WITH {_kpi_ctes(adapter)}
SELECT round(total_revenue, 2) AS total_revenue, total_customers, total_products, total_orders,
       avg_ticket, round(avg_recency, 6) AS avg_recency,
       round(avg_frequency, 6) AS avg_frequency, period_start, period_end, period_days,
       round(ruptura_projetada_media, 6) AS ruptura_projetada_media FROM kpi
"""


ORACLE["general_kpis"] = _kpi_sql("tpch_orders")
ORACLE["general_kpis_lines"] = _kpi_sql("tpch")

ORACLE["projected_stockout"] = f"""
WITH tx AS ({TX['tpch_orders']}), t AS (SELECT * FROM tx WHERE client IS NOT NULL),
pc AS (SELECT client, max(date) AS last_order FROM t GROUP BY client),
g AS ({gaps_cte('client', 't')}),
gm AS (SELECT client, coalesce(CAST(median(gap) AS DOUBLE), 0.0) AS gm FROM g GROUP BY client)
SELECT client, last_order, round(coalesce(gm.gm, 0.0), 4) AS gm_cliente,
       {fd(add_days('last_order', 'coalesce(gm.gm, 0.0) + 20'), TPCH_REF)} AS projected_days
FROM pc LEFT JOIN gm USING (client)
"""

ORACLE["monthly_history"] = f"""
WITH tx AS ({TX['tpch']})
SELECT CAST(date_trunc('month', date) AS DATE) AS periodo, round({msum('subtotal')}, 2) AS receita_total,
       count(DISTINCT order_id) AS pedidos, count(DISTINCT client) AS clientes,
       round(coalesce(sum(qty), 0.0), 2) AS volume,
       CASE WHEN count(DISTINCT order_id) > 0 THEN {msum('subtotal')} / count(DISTINCT order_id) ELSE 0.0 END
           AS ticket_medio
FROM tx GROUP BY 1
"""

ORACLE["behaviour_sheet"] = f"""
WITH kpi AS (WITH {_kpi_ctes('tpch')} SELECT * FROM kpi),
rfm AS (WITH {_rfm_ctes('tpch')} SELECT * FROM rfm)
SELECT 1 AS position, 'Total de clientes' AS indicador, CAST(total_customers AS DOUBLE) AS valor FROM kpi
UNION ALL SELECT 2, 'Total de SKUs', CAST(total_products AS DOUBLE) FROM kpi
UNION ALL SELECT 3, 'Total de pedidos', CAST(total_orders AS DOUBLE) FROM kpi
UNION ALL SELECT 4, 'Ticket médio', round_even(avg_ticket, 2) FROM kpi
UNION ALL SELECT 5, 'Ruptura projetada média (dias)', round_even(ruptura_projetada_media, 2) FROM kpi
UNION ALL SELECT CAST(5 + row_number() OVER (ORDER BY count(*) DESC, tier) AS INTEGER), 'Clientes ' || tier,
       CAST(count(*) AS DOUBLE) FROM rfm GROUP BY tier
"""

# --- statistics ------------------------------------------------------------------

_PAIR_GAPS_TPCH = f"WITH tx AS ({TX['tpch']}), g AS ({gaps_cte('client, sku', 'tx')})"
_PAIR_GAPS_EVENTS = f"WITH tx AS ({TX['events']}), g AS ({gaps_cte('client, sku', 'tx')})"

ORACLE["pair_gaps"] = _PAIR_GAPS_TPCH + " SELECT client, sku, order_id, ingest_seq, gap FROM g"

ORACLE["repurchase_probability"] = _PAIR_GAPS_TPCH + """
SELECT client, sku, coalesce(round_even(avg(CASE WHEN gap IS NULL THEN NULL WHEN gap <= 90 THEN 1.0
       ELSE 0.0 END), 4), 0.0) AS prob_recompra FROM g GROUP BY client, sku
"""

_A = 1 - 0.95
ORACLE["turnover_interval"] = _PAIR_GAPS_EVENTS + f"""
SELECT client, sku,
       round(coalesce(quantile_cont(CAST(gap AS DOUBLE), {_A / 2!r}), 0.0), 6) AS ic_low,
       round(coalesce(quantile_cont(CAST(gap AS DOUBLE), {1 - _A / 2!r}), 0.0), 6) AS ic_high
FROM g GROUP BY client, sku
"""

ORACLE["turnover_cv"] = _PAIR_GAPS_TPCH + """
SELECT client, sku, round(coalesce(CASE WHEN avg(gap) <> 0 THEN stddev_pop(gap) / avg(gap) END, 0.0), 8)
       AS cv_giro FROM g GROUP BY client, sku
"""

_LAST6 = f"""WITH tx AS ({TX['events']}),
l6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client, sku ORDER BY date DESC,
       ingest_seq DESC) AS rank_desc FROM tx) WHERE rank_desc <= 6)"""

ORACLE["survival_score"] = _LAST6 + """
SELECT client, sku, CASE WHEN count(qty > 10) = 0 THEN 0.0 ELSE
       round_even((sum(CASE WHEN qty > 10 THEN 1 ELSE 0 END) + 1.0) / (count(qty > 10) + 2.0), 4) END
       AS survival FROM l6 GROUP BY client, sku
"""

ORACLE["last_n_rows"] = _LAST6 + " SELECT client, sku, order_id, rank_desc FROM l6"

ORACLE["volume_outliers"] = f"""
WITH tx AS ({TX['events']}),
m AS (SELECT client, sku, avg(qty) AS mu, stddev_pop(qty) AS sd FROM tx GROUP BY client, sku)
SELECT tx.client, tx.sku, tx.order_id, tx.qty, round((tx.qty - m.mu) / m.sd, 6) AS zscore
FROM tx JOIN m ON tx.client = m.client AND tx.sku = m.sku
WHERE m.sd > 0 AND abs((tx.qty - m.mu) / m.sd) > 3
"""

ORACLE["qty_diff_cv"] = f"""
WITH tx AS ({TX['events']}),
d AS (SELECT client, sku, qty - lag(qty) OVER (PARTITION BY client, sku ORDER BY date, ingest_seq) AS diff
      FROM tx)
SELECT client, sku, round(coalesce(CASE WHEN avg(diff) <> 0 THEN stddev_pop(diff) / avg(diff) END, 0.0), 6)
       AS cv_diff FROM d GROUP BY client, sku
"""
