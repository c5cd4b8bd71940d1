"""Oracle SQL for report tables, orderings, sources and sinks read back, and parsing tables."""

from __future__ import annotations

from orderpulse.plans.oracle import ORACLE, _customer_base_sql, _rfm_ctes, _rfm_sql
from orderpulse.plans.oracle_alerts import _T_TPCH, _drop_ctes, _outlier_ctes, _rel, pdv_ctes
from orderpulse.plans.oracle_cycles import _cycle_sql
from orderpulse.plans.oracle_extract import _FLAT_ROWS, _SHEET, _dedupe
from orderpulse.plans.oracle_normalize import _BASE
from orderpulse.plans.sqlparts import EVENTS_REF, TPCH_REF, TX, add_days, fd, gaps_cte, msum  # noqa: F401

_TX = f"tx AS ({TX['tpch']})"

# --- G01 ------------------------------------------------------------------------------
ORACLE["report_clients"] = _rfm_sql("tpch", "client, recency, frequency, monetary, rfm_score, tier")
ORACLE["report_history"] = f"SELECT periodo, receita_total, pedidos, clientes, volume FROM ({ORACLE['monthly_history']})"
ORACLE["report_mix"] = f"""
SELECT sku, product, orders, qty, revenue, turnover_median, hero_mix FROM ({ORACLE['product_analytics']})"""
_JANELA = "gm_cliente + 20.0"
ORACLE["report_relationship"] = f"""
SELECT client, frequency, last_order, {_JANELA} AS janela_prevista_dias, {add_days('last_order', _JANELA)} AS proxima_janela
FROM ({_customer_base_sql('tpch')})"""
ORACLE["report_behavior"] = ORACLE["behaviour_sheet"]

# --- G02, G03 -------------------------------------------------------------------------
ORACLE["pro_base"] = f"""WITH {_TX}
SELECT row_number() OVER (ORDER BY date, client, sku, dataset_id, order_id, seller, product, price, qty, subtotal, category,
       segment, city, uf, ingest_seq) AS position, date, client, sku, order_id, qty FROM tx"""
ORACLE["base_positions"] = f"""
SELECT row_number() OVER (ORDER BY date, client, sku, order_id, seller, product, price, qty, subtotal, category,
       segment, city, uf) AS position, date, client, sku, order_id, seller FROM ({_BASE})"""
ORACLE["pro_clients"] = f"""WITH {_rfm_ctes('tpch_orders')}
SELECT row_number() OVER (ORDER BY rfm_score DESC, client) AS position, client, rfm_score, tier FROM rfm"""
ORACLE["pro_products"] = f"""WITH {_TX},
p AS (SELECT client, sku, {msum('subtotal')} AS subtotal, coalesce(sum(qty), 0.0) AS qty FROM tx GROUP BY client, sku)
SELECT row_number() OVER (ORDER BY client, subtotal DESC, sku) AS position, client, sku, subtotal, qty FROM p"""

_ALERTS = f"""WITH {_T_TPCH}, {pdv_ctes()}, {_drop_ctes()}, {_outlier_ctes()},
g AS ({gaps_cte('client, sku', 'p')}),
a AS (SELECT client, sku, max(date) AS last_order, CAST(median(gap) AS DOUBLE) AS giro,
             coalesce(round_even(avg(CASE WHEN gap IS NULL THEN NULL WHEN gap <= 90 THEN 1.0 ELSE 0.0 END), 4), 0.0) AS prob,
             quantile_cont(CAST(gap AS DOUBLE), {(1 - 0.95) / 2!r}) AS lo,
             quantile_cont(CAST(gap AS DOUBLE), {1 - (1 - 0.95) / 2!r}) AS hi
      FROM g GROUP BY client, sku HAVING count(*) >= 2),
r AS (SELECT *, {fd(TPCH_REF, 'last_order')} AS dias, least(1.0, {fd(TPCH_REF, 'last_order')} / greatest(1.0, giro + 20)) AS c FROM a),
texts AS (
  SELECT client, sku, 'ruptura' AS type,
         printf('Cliente %s sem comprar %s há %d dias. Giro mediano %.1fd (IC %.0f-%.0f) e prob. recompra %.0f%%.', client, sku,
                dias, round_even(round(giro, 9), 1), round_even(round(lo, 9), 0), round_even(round(hi, 9), 0), round_even(round(prob * 100, 9), 0)) AS insight,
         printf('%s está há %dd sem comprar %s (giro %.0fd).', client, dias, sku, round_even(round(giro, 9), 0)) AS diagnosis,
         printf('Ligar para %s e reservar estoque para reposição em até 3 dias.', client) AS act, ' Considerar: ' AS joiner,
         {_rel('c')} AS reliability, '3 dias' AS deadline FROM r
  UNION ALL
  SELECT client, NULL, 'queda_brusca',
         printf('Receita de %s caiu %.1f%% vs média. Z-score %.2f, YoY %.1f%%', client, round_even(round(queda_pct, 9), 1),
                round_even(round(zscore, 9), 2), round_even(round(yoy, 9), 1)),
         printf('Receita mensal de %s recuou %.1f%% (z %.1f).', client, round_even(round(queda_pct, 9), 1), round_even(round(zscore, 9), 1)),
         'Oferecer ofertas de recuperação e revisar cobertura com o time comercial.', ' Verificar também: ',
         {_rel('score')}, '1 semana' FROM drop_hits
  UNION ALL
  SELECT client, sku, 'outlier_volume',
         printf('Volume %s da média para %s (último %.0f vs média %.0f). CV giro %.2f, score sobrevivência %.2f.', direcao, sku,
                round_even(round(valor, 9), 0), round_even(round(media, 9), 0), round_even(round(cv_giro, 9), 2), round_even(round(survival, 9), 2)),
         printf('Volume de %s ficou %s %.0f%% vs média (%.0f vs %.0f).', sku, direcao, round_even(round(delta * 100, 9), 0),
                round_even(round(valor, 9), 0), round_even(round(media, 9), 0)),
         'Agendar validação de estoque e alinhar com operações/atendimento.', ' Contexto: ',
         {_rel('least(1.0, delta)')}, '48 horas' FROM outl),
done AS (SELECT texts.*, coalesce(trig.triggers, '') AS triggers,
                act || CASE WHEN coalesce(trig.triggers, '') <> '' THEN joiner || trig.triggers ELSE '' END AS action
         FROM texts LEFT JOIN trig USING (client))"""

ORACLE["pro_insights"] = f"""{_ALERTS}
SELECT client, sku, type, insight, action, reliability, deadline AS suggested_deadline FROM done"""
ORACLE["pro_alerts"] = f"""{_ALERTS}
SELECT client, sku, type, diagnosis, action AS recommended_action, triggers, reliability FROM done"""
ORACLE["panel_targets"] = f"""{_ALERTS}
SELECT client, coalesce(sku, '') AS sku, upper(type) AS type, diagnosis, action AS recommended_action,
       CASE reliability WHEN '🔵' THEN 'ALTA' WHEN '🟡' THEN 'MÉDIA' ELSE 'BAIXA' END AS confiabilidade, deadline AS prazo FROM done"""
ORACLE["pdv_order"] = f"""WITH {_T_TPCH}, {pdv_ctes()}
SELECT row_number() OVER (ORDER BY score DESC, client) AS position, client, score,
       printf('Mix %d SKUs, volume %.0f itens, freq. %.2f/mês', mix, round_even(volume, 0), round_even(freq, 2)) AS justificativa
FROM pdv"""
ORACLE["panel_client_radar"] = f"""WITH cb AS ({_customer_base_sql('tpch')}), rf AS ({_rfm_sql('tpch', 'client, tier')})
SELECT client, recency, frequency, monetary, round(avg_ticket, 6) AS avg_ticket, gm_cliente, tier FROM cb JOIN rf USING (client)"""
ORACLE["panel_base"] = f"""WITH {_TX}
SELECT ingest_seq, order_id, client, product, qty, subtotal FROM tx ORDER BY ingest_seq, product, qty, subtotal LIMIT 10000"""
ORACLE["operational_list"] = f"""WITH pr AS ({ORACLE['priority_items']})
SELECT row_number() OVER (ORDER BY priority_score DESC, client, sku) AS position, client, sku, priority_score, confidence
FROM pr WHERE status = 'ataque' AND confidence >= 0.5"""
ORACLE["dataset_overview"] = f"""WITH {_TX}, t AS (SELECT *, split_part(product, ' ', 1) AS cat FROM tx),
u AS (SELECT uf FROM t WHERE uf IS NOT NULL GROUP BY uf ORDER BY min(ingest_seq), uf LIMIT 10),
c AS (SELECT city, count(*) AS n FROM t WHERE city IS NOT NULL GROUP BY city ORDER BY n DESC, city LIMIT 10),
k AS (SELECT cat, count(*) AS n FROM t WHERE cat IS NOT NULL GROUP BY cat ORDER BY n DESC, cat LIMIT 10)
SELECT count(DISTINCT client) AS n_clientes, count(DISTINCT client) AS n_cnpjs, count(DISTINCT product) AS n_produtos,
       strftime(min(date), '%Y-%m-%d') AS inicio, strftime(max(date), '%Y-%m-%d') AS fim,
       CAST((year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1 AS BIGINT) AS meses,
       (SELECT string_agg(uf, ',' ORDER BY uf) FROM u) AS ufs,
       (SELECT string_agg(city, ',' ORDER BY n DESC, city) FROM c) AS cidades_top,
       (SELECT string_agg(cat, ',' ORDER BY n DESC, cat) FROM k) AS categorias_top FROM t"""

# --- sources and sinks ----------------------------------------------------------------
ORACLE["sheet_text_extract"] = f"""WITH {_SHEET}
SELECT product, day AS date, order_id, c_name AS client, seller, price, qty, sub AS subtotal FROM extracted"""
ORACLE["grid_parquet_extract"] = _dedupe(_FLAT_ROWS)
ORACLE["sheet_csv_base"] = f"SELECT date, order_id, client, sku, price, qty, subtotal, uf FROM ({_BASE})"
ORACLE["calibration_mapping"] = """
SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '*' ELSE p_brand END AS value FROM part"""
ORACLE["dataset_partitions"] = f"""WITH {_TX}, n AS (SELECT client, count(*) AS c FROM tx GROUP BY client)
SELECT 'a' AS dataset_id, client, CAST(c * 2 AS BIGINT) AS rows FROM n UNION ALL SELECT 'b', client, CAST(c AS BIGINT) FROM n"""
ORACLE["export_csv"] = f"WITH {_TX} SELECT order_id, client, product, CAST(CAST(subtotal AS DECIMAL(28,2)) AS DOUBLE) AS subtotal FROM tx"
ORACLE["report_sink"] = f"""WITH tx AS ({TX['tpch_orders']}),
rf AS ({_rfm_sql('tpch_orders', 'client, tier')})
SELECT 'Identificação do Cliente' AS "table", count(DISTINCT client) AS rows FROM tx
UNION ALL SELECT 'Histórico Comercial', count(DISTINCT date_trunc('month', date)) FROM tx
UNION ALL SELECT 'Inteligência de Mix', count(DISTINCT segment) FROM tx
UNION ALL SELECT 'Relacional e Atendimento', count(DISTINCT client) FROM tx
UNION ALL SELECT 'Inteligência Comportamental', 5 + (SELECT count(DISTINCT tier) FROM rf)"""

# --- parsing --------------------------------------------------------------------------
ORACLE["date_shapes"] = """
SELECT o_orderkey, p AS parsed, coalesce(p, TIMESTAMP '2000-01-01') AS parsed_or FROM (
  SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3, 6, 10) THEN date_trunc('day', t)
         WHEN k = 4 THEN CAST(timezone('America/Sao_Paulo', timezone('UTC', date_trunc('second', t))) AS TIMESTAMP)
         WHEN k = 5 THEN CAST(timezone('America/Sao_Paulo', timezone('UTC', date_trunc('second', t) + INTERVAL 3 HOUR)) AS TIMESTAMP)
         WHEN k IN (7, 8) THEN date_trunc('minute', t) WHEN k = 9 THEN CAST(date_trunc('month', t) AS TIMESTAMP) END AS p
  FROM (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 12 AS k FROM orders) AS o) AS q"""
ORACLE["sku_fallback"] = f"SELECT sku, sku AS product, count(*) AS rows FROM ({_BASE}) GROUP BY sku"
ORACLE["metrics_boundary"] = f"""WITH {_TX}
SELECT client, count(DISTINCT order_id) AS orders, round(sum(subtotal), 2) AS revenue,
       1.25 * count(*) AS prices, sum(qty) AS qty FROM tx GROUP BY client"""
ORACLE["coerced_statistics"] = """
SELECT event_type AS sku, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd
FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY event_type"""
