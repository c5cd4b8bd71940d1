"""Oracle SQL for summaries, panel tables and top-k queries."""

from __future__ import annotations

from orderpulse.plans.oracle import ORACLE, _customer_base_sql
from orderpulse.plans.sqlparts import TPCH_REF, TX, add_days, fd, gaps_cte, msum

_TX = f"tx AS ({TX['tpch']})"
_TXP = f"tx AS ({TX['tpch'].replace('p.p_brand AS sku', 'CAST(l.l_partkey AS VARCHAR) AS sku')})"

ORACLE["dataset_summary"] = f"""WITH {_TX}, t AS (SELECT * FROM tx WHERE client IS NOT NULL),
sr AS (SELECT sku, {msum('subtotal')} AS revenue FROM tx WHERE sku IS NOT NULL GROUP BY sku),
thr AS (SELECT coalesce(quantile_cont(revenue, 0.8), 0.0) AS thr FROM sr),
hero AS (SELECT sum(CASE WHEN revenue >= thr THEN revenue END) AS hv, sum(revenue) AS allr, first(thr) AS thr
         FROM sr, thr),
k AS (SELECT count(DISTINCT client) AS n_clientes, count(DISTINCT sku) AS n_skus, min(date) AS inicio,
             max(date) AS fim, {msum('subtotal')} AS total_revenue FROM tx),
reg AS (SELECT string_agg(uf, ',' ORDER BY uf) AS regioes FROM (SELECT DISTINCT uf FROM tx
        WHERE uf IS NOT NULL AND uf <> '')),
tp AS (SELECT string_agg(sku, ',' ORDER BY revenue DESC, sku, product) AS top_skus FROM (
       SELECT sku, product, {msum('subtotal')} AS revenue FROM tx GROUP BY sku, product
       ORDER BY revenue DESC, sku, product LIMIT 5))
SELECT n_clientes, n_skus, inicio, fim,
       CAST(CASE WHEN {fd('fim', 'inicio')} <> 0 THEN floor({fd('fim', 'inicio')} / 30) ELSE 0 END AS BIGINT) AS meses,
       regioes, round(total_revenue, 2) AS total_revenue,
       round(CASE WHEN thr <> 0 THEN coalesce(hv, 0.0) ELSE coalesce(allr, 0.0) END, 2) AS hero_share_value,
       round(CASE WHEN total_revenue <> 0 THEN (CASE WHEN thr <> 0 THEN coalesce(hv, 0.0)
             ELSE coalesce(allr, 0.0) END) / total_revenue ELSE 0.0 END, 8) AS hero_share_ratio, top_skus
FROM k, hero, reg, tp"""

ORACLE["top_products"] = f"""WITH {_TXP}
SELECT sku, product, {msum('subtotal')} AS revenue, CAST(trunc(coalesce(sum(qty), 0.0)) AS BIGINT) AS qty
FROM tx GROUP BY sku, product ORDER BY revenue DESC, sku, product LIMIT 5"""

ORACLE["regions"] = f"""WITH {_TX}
SELECT string_agg(uf, ',' ORDER BY uf) AS regioes FROM (SELECT DISTINCT uf FROM tx WHERE uf IS NOT NULL AND uf <> '')"""

ORACLE["first_cities"] = f"""WITH {_TX}
SELECT city FROM (SELECT city, min(ingest_seq) AS s FROM tx WHERE city IS NOT NULL GROUP BY city ORDER BY s LIMIT 10)"""

ORACLE["top_cities"] = f"""WITH {_TX}
SELECT city, count(*) AS n FROM tx WHERE city IS NOT NULL GROUP BY city ORDER BY n DESC, city LIMIT 10"""

ORACLE["light_summary"] = f"""WITH {_TX}
SELECT count(DISTINCT client) AS n_clientes, CAST(0 AS BIGINT) AS n_cnpjs, count(DISTINCT product) AS n_produtos,
       strftime(min(date), '%Y-%m-%d') AS inicio, strftime(max(date), '%Y-%m-%d') AS fim,
       CAST(coalesce(greatest(1, (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1), 0)
            AS BIGINT) AS meses FROM tx"""

ORACLE["panel_kpis"] = f"""WITH {_TX}
SELECT {msum('subtotal')} AS total_revenue, count(DISTINCT client) AS total_customers,
       count(DISTINCT sku) AS total_products, count(DISTINCT order_id) AS total_orders,
       CASE WHEN count(DISTINCT order_id) > 0 THEN {msum('subtotal')} / count(DISTINCT order_id) ELSE 0.0 END
           AS avg_ticket FROM tx"""

_CB = _customer_base_sql("tpch_orders")

ORACLE["rfm_summary"] = f"""WITH cb AS ({_CB})
SELECT 'recency' AS metric, round(avg(recency), 6) AS mean, CAST(quantile_cont(recency, 0.5) AS DOUBLE) AS median,
       CAST(min(recency) AS DOUBLE) AS min, CAST(max(recency) AS DOUBLE) AS max FROM cb
UNION ALL SELECT 'frequency', round(avg(frequency), 6), CAST(quantile_cont(frequency, 0.5) AS DOUBLE),
       CAST(min(frequency) AS DOUBLE), CAST(max(frequency) AS DOUBLE) FROM cb
UNION ALL SELECT 'monetary', round(avg(monetary), 6), quantile_cont(monetary, 0.5), min(monetary), max(monetary) FROM cb
UNION ALL SELECT 'avg_ticket', round(avg(avg_ticket), 6), quantile_cont(avg_ticket, 0.5), min(avg_ticket),
       max(avg_ticket) FROM cb"""

ORACLE["product_radar"] = f"""WITH {_TX}, tot AS (SELECT count(DISTINCT client) AS a FROM tx)
SELECT sku, product, {msum('subtotal')} AS revenue, coalesce(sum(qty), 0.0) AS qty,
       count(DISTINCT order_id) AS orders, count(DISTINCT client) AS clients,
       round(CASE WHEN first(a) > 0 THEN count(DISTINCT client) / first(a) * 100 ELSE 0.0 END, 8) AS penetration
FROM tx, tot GROUP BY sku, product"""

ORACLE["client_sku_potential"] = f"""WITH {_TX}
SELECT client, sku, {msum('subtotal')} AS subtotal, coalesce(sum(qty), 0.0) AS qty FROM tx GROUP BY client, sku"""

ORACLE["kpi_payload"] = f"""WITH cb AS ({_CB})
SELECT count(*) AS total_clients, CAST(greatest(0, coalesce(round_even(avg(recency), 0), 0)) AS BIGINT) AS avg_recency_days,
       greatest(0.0, coalesce(round_even(avg(frequency), 1), 0.0)) AS avg_frequency,
       greatest(0.0, coalesce(round_even(avg(avg_ticket), 2), 0.0)) AS avg_value FROM cb"""

ORACLE["product_ranking"] = f"""WITH {_TXP},
p AS (SELECT sku, {msum('subtotal')} AS value FROM tx WHERE sku IS NOT NULL GROUP BY sku)
SELECT sku, value, rank() OVER (ORDER BY value DESC) AS rank FROM p"""

ORACLE["product_ranking_qty"] = f"""WITH {_TX},
p AS (SELECT sku, sum(qty) AS value FROM tx WHERE sku IS NOT NULL GROUP BY sku)
SELECT sku, value, rank() OVER (ORDER BY value DESC) AS rank FROM p"""

ORACLE["relationship_sheet"] = f"""WITH cb AS ({_CB})
SELECT client, segment, city, uf, gm_cliente, recency, frequency, last_order,
       coalesce(gm_cliente, 0.0) + 20 AS janela_prevista_dias,
       {add_days('last_order', 'coalesce(gm_cliente, 0.0) + 20')} AS proxima_janela FROM cb"""
