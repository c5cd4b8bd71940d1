"""Oracle SQL for segmentation and alert queries."""

from __future__ import annotations

from orderpulse.plans.oracle import ORACLE
from orderpulse.plans.sqlparts import EVENTS_REF, TPCH_REF, TX, add_days, fd, gaps_cte, msum


def pdv_ctes(source: str = "t") -> str:
    return f"""
pv AS (SELECT client, count(DISTINCT order_id) AS orders, count(DISTINCT sku) AS mix,
              coalesce(sum(qty), 0.0) AS volume, max(date) AS mx, min(date) AS mn
       FROM {source} GROUP BY client),
pg AS ({gaps_cte('client', source)}),
pgm AS (SELECT client, CAST(median(gap) AS DOUBLE) AS gm FROM pg GROUP BY client),
vec AS (SELECT pv.client, mix, volume, orders / greatest(1.0, {fd('mx', 'mn')} / 30.0) AS freq,
               coalesce(pgm.gm, 0.0) AS giro_mediano FROM pv LEFT JOIN pgm USING (client)),
base AS (SELECT avg(mix) AS mean_mix, avg(volume) AS mean_volume, avg(freq) AS mean_freq,
                avg(giro_mediano) AS mean_giro, quantile_cont(mix, 0.5) AS median_mix,
                quantile_cont(volume, 0.5) AS median_volume FROM vec),
pdv AS (SELECT client, mix, volume, freq, giro_mediano,
               round_even(mix / greatest(1.0, mean_mix) * 0.35 + volume / greatest(1.0, mean_volume) * 0.35
                          + freq / greatest(1.0, mean_freq) * 0.30, 4) AS score,
               mix < median_mix AS trig_mix, volume < median_volume * 0.5 AS trig_volume,
               giro_mediano > mean_giro * 1.5 AS trig_turnover FROM vec, base),
trig AS (SELECT client, concat_ws(', ', CASE WHEN trig_mix THEN 'mix abaixo do cluster' END,
                  CASE WHEN trig_volume THEN 'ausência anômala de SKU esperado' END,
                  CASE WHEN trig_turnover THEN 'giro lento em relação ao cluster' END) AS triggers FROM pdv)
"""


def _rel(x: str) -> str:
    return f"CASE WHEN {x} >= 0.75 THEN '🔴' WHEN {x} >= 0.4 THEN '🟡' ELSE '🔵' END"


_T_TPCH = f"tx AS ({TX['tpch']}), t AS (SELECT * FROM tx WHERE client IS NOT NULL)"
_T_EVENTS = f"tx AS ({TX['events']}), t AS (SELECT * FROM tx WHERE client IS NOT NULL)"

ORACLE["pdv_vectors"] = f"WITH {_T_TPCH}, {pdv_ctes()} SELECT client, mix, volume, round(freq, 6) AS freq, giro_mediano FROM vec"
ORACLE["pdv_baseline"] = f"""WITH {_T_TPCH}, {pdv_ctes()}
SELECT round(mean_mix, 6) AS mean_mix, round(mean_volume, 6) AS mean_volume, round(mean_freq, 6) AS mean_freq,
       round(mean_giro, 6) AS mean_giro, CAST(median_mix AS DOUBLE) AS median_mix,
       CAST(median_volume AS DOUBLE) AS median_volume FROM base"""
ORACLE["pdv_scores"] = f"""WITH {_T_TPCH}, {pdv_ctes()}
SELECT client, mix, volume, round(freq, 6) AS freq, giro_mediano, score, trig_mix, trig_volume, trig_turnover FROM pdv"""

ORACLE["segment_rollup"] = f"""WITH tx AS ({TX['tpch']})
SELECT coalesce(segment, 'Não classificado') AS segment, count(DISTINCT client) AS total_clients,
       {msum('subtotal')} AS total_revenue, count(*) AS total_orders,
       CASE WHEN count(*) > 0 THEN {msum('subtotal')} / count(*) ELSE 0.0 END AS avg_ticket
FROM tx GROUP BY 1"""


def _rupture_sql(t: str, ref: str) -> str:
    return f"""WITH {t}, {pdv_ctes()},
p AS (SELECT * FROM t WHERE sku IS NOT NULL),
g AS ({gaps_cte('client, sku', 'p')}),
a AS (SELECT client, sku, count(*) AS n, max(date) AS last_order, CAST(median(gap) AS DOUBLE) AS giro_mediano,
             coalesce(round_even(avg(CASE WHEN gap IS NULL THEN NULL WHEN gap <= 90 THEN 1.0 ELSE 0.0 END), 4), 0.0)
                 AS prob_recompra,
             quantile_cont(CAST(gap AS DOUBLE), {(1 - 0.95) / 2!r}) AS ic_low,
             quantile_cont(CAST(gap AS DOUBLE), {1 - (1 - 0.95) / 2!r}) AS ic_high
      FROM g GROUP BY client, sku HAVING count(*) >= 2),
r AS (SELECT *, {fd(ref, 'last_order')} AS dias_sem_compra,
             least(1.0, {fd(ref, 'last_order')} / greatest(1.0, giro_mediano + 20)) AS confianca FROM a)
SELECT client, sku, 'ruptura' AS type, dias_sem_compra, giro_mediano, round(confianca, 6) AS confianca,
       {_rel('confianca')} AS reliability, prob_recompra, round(ic_low, 6) AS ic_low, round(ic_high, 6) AS ic_high,
       '3 dias' AS suggested_deadline, coalesce(trig.triggers, '') AS triggers
FROM r LEFT JOIN trig USING (client)"""


ORACLE["alerts_rupture"] = _rupture_sql(_T_TPCH, TPCH_REF)


def _drop_ctes() -> str:
    return f"""
mon AS (SELECT client, CAST(date_trunc('month', date) AS DATE) AS month, {msum('subtotal')} AS revenue
        FROM t GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY month DESC) AS rn FROM mon),
gr AS (SELECT client, count(*) AS n, max(CASE WHEN rn = 1 THEN revenue END) AS last,
              avg(CASE WHEN rn > 1 THEN revenue END) AS mp, stddev_pop(CASE WHEN rn > 1 THEN revenue END) AS sp,
              max(CASE WHEN rn = 13 THEN revenue END) AS b13 FROM mr GROUP BY client),
z AS (SELECT *, (last - mp) / (CASE WHEN sp = 0 THEN 1.0 ELSE sp END) AS zscore,
             CASE WHEN n >= 13 THEN (last - b13) / greatest(1.0, b13) * 100 ELSE 0.0 END AS yoy FROM gr),
drop_hits AS (SELECT *, least(1.0, abs(zscore) / 3) AS score, (mp - last) / greatest(1.0, mp) * 100 AS queda_pct
      FROM z WHERE n >= 3 AND last < mp AND zscore <= -1.5)
"""


ORACLE["alerts_drop"] = f"""WITH {_T_TPCH}, {pdv_ctes()}, {_drop_ctes()}
SELECT client, 'queda_brusca' AS type, round(zscore, 6) AS zscore, round(yoy, 6) AS yoy,
       round(queda_pct, 6) AS queda_pct, round(score, 6) AS score, {_rel('score')} AS reliability,
       '1 semana' AS suggested_deadline, coalesce(trig.triggers, '') AS triggers
FROM drop_hits LEFT JOIN trig USING (client)"""


def _outlier_ctes() -> str:
    return f"""
p AS (SELECT * FROM t WHERE sku IS NOT NULL),
m AS (SELECT client, sku, count(qty) AS n, avg(qty) AS mu, stddev_pop(qty) AS sd FROM p GROUP BY client, sku),
fl AS (SELECT p.*, m.mu FROM p JOIN m USING (client, sku)
       WHERE m.n >= 5 AND m.sd > 0 AND abs((p.qty - m.mu) / m.sd) > 3),
lt AS (SELECT client, sku, arg_max(qty, (date, ingest_seq)) AS valor, first(mu) AS media FROM fl GROUP BY client, sku),
df AS (SELECT client, sku, qty - lag(qty) OVER (PARTITION BY client, sku ORDER BY date, ingest_seq) AS d FROM p),
cvs AS (SELECT client, sku, coalesce(CASE WHEN avg(d) <> 0 THEN stddev_pop(d) / avg(d) END, 0.0) AS cv_giro
        FROM df GROUP BY client, sku),
l6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client, sku ORDER BY date DESC, ingest_seq DESC)
       AS rk FROM p) WHERE rk <= 6),
sv AS (SELECT client, sku, round_even((sum(CASE WHEN qty > 0 THEN 1 ELSE 0 END) + 1.0) / (count(*) + 2.0), 4)
       AS survival FROM l6 GROUP BY client, sku),
outl AS (SELECT lt.*, abs(valor - media) / greatest(1.0, media) AS delta,
              CASE WHEN valor > media THEN 'acima' ELSE 'abaixo' END AS direcao,
              coalesce(cvs.cv_giro, 0.0) AS cv_giro, coalesce(sv.survival, 0.0) AS survival
       FROM lt LEFT JOIN cvs USING (client, sku) LEFT JOIN sv USING (client, sku))
"""


ORACLE["alerts_outlier"] = f"""WITH {_T_EVENTS}, {pdv_ctes()}, {_outlier_ctes()}
SELECT client, sku, 'outlier_volume' AS type, valor, round(media, 6) AS media, direcao, round(delta, 6) AS delta,
       {_rel('least(1.0, delta)')} AS reliability, round(cv_giro, 6) AS cv_giro, survival,
       '48 horas' AS suggested_deadline, coalesce(trig.triggers, '') AS triggers
FROM outl LEFT JOIN trig USING (client)"""


def _all_alerts_sql(ref: str) -> str:
    return f"""WITH {_T_TPCH}, {pdv_ctes()}, {_drop_ctes()}, {_outlier_ctes()},
g AS ({gaps_cte('client, sku', 'p')}),
ra AS (SELECT client, sku, least(1.0, {fd(ref, 'max(date)')} / greatest(1.0, median(gap) + 20)) AS c
       FROM g GROUP BY client, sku HAVING count(*) >= 2),
allr AS (SELECT client, sku, 'ruptura' AS type, {_rel('c')} AS reliability, '3 dias' AS suggested_deadline FROM ra
         UNION ALL SELECT client, NULL, 'queda_brusca', {_rel('score')}, '1 semana' FROM drop_hits
         UNION ALL SELECT client, sku, 'outlier_volume', {_rel('least(1.0, delta)')}, '48 horas' FROM outl)"""


ORACLE["alerts_all"] = _all_alerts_sql(TPCH_REF) + """
SELECT 'tpch' AS dataset_id, client, sku, type, reliability, suggested_deadline FROM allr"""

ORACLE["alerts_summary"] = _all_alerts_sql(TPCH_REF) + """
SELECT type, reliability, count(*) AS n, CAST(GROUPING(type, reliability) AS BIGINT) AS level
FROM allr GROUP BY GROUPING SETS ((type), (reliability), ())"""

ORACLE["alerts_filtered"] = _all_alerts_sql(TPCH_REF) + """
SELECT client, sku, type, reliability FROM allr
WHERE type = 'ruptura' AND reliability = '🔴' AND type IN ('ruptura', 'queda_brusca', 'outlier_volume')"""

_TM = f"tx AS ({TX['tpch']}), t AS (SELECT * FROM tx WHERE date IS NOT NULL AND client IS NOT NULL)"


def _min_rupture_ctes() -> str:
    return f"""
tp AS (SELECT * FROM t WHERE product IS NOT NULL),
g AS ({gaps_cte('client, product', 'tp')}),
a AS (SELECT client, product, max(date) AS ultimo,
             CAST(coalesce(floor(median(gap)), 45) AS BIGINT) AS giro FROM g GROUP BY client, product),
s AS (SELECT *, {add_days('ultimo', 'giro + 20')} AS limite,
             {add_days('ultimo', 'floor((giro + 20) * 0.75)')} AS alerta FROM a),
mr AS (SELECT client AS cliente, product AS produto, 'Ruptura' AS tipo, giro AS giro_mediano_dias,
              strftime(ultimo, '%Y-%m-%d') AS ultimo_pedido, strftime(limite, '%Y-%m-%d') AS limite,
              CASE WHEN {TPCH_REF} > limite THEN 'CRITICO'
                   WHEN {TPCH_REF} >= alerta AND {TPCH_REF} < limite THEN 'ALERTA' ELSE 'OK' END AS status
       FROM s)
"""


ORACLE["min_rupture"] = f"WITH {_TM}, {_min_rupture_ctes()} SELECT * FROM mr WHERE status <> 'OK'"

_INACT = f"""ia AS (SELECT client AS cliente, 'Inatividade' AS tipo, {fd(TPCH_REF, 'max(date)')} AS dias_sem_compra,
       strftime(max(date), '%Y-%m-%d') AS ultimo_pedido, 'ALERTA' AS status FROM t GROUP BY client
       HAVING epoch_us({TPCH_REF}) - epoch_us(max(date)) > 90 * 86400000000)"""
ORACLE["inactive_clients"] = f"WITH {_TM}, {_INACT} SELECT * FROM ia"

_GROWTH = f"""gc AS (SELECT client,
  coalesce(sum(CASE WHEN date >= {TPCH_REF} - INTERVAL 90 DAY THEN CAST(round(subtotal * 100) AS BIGINT) END), 0) AS cur,
  coalesce(sum(CASE WHEN date < {TPCH_REF} - INTERVAL 90 DAY AND date >= {TPCH_REF} - INTERVAL 180 DAY
                    THEN CAST(round(subtotal * 100) AS BIGINT) END), 0) AS ant FROM t GROUP BY client),
gw AS (SELECT client AS cliente, 'Crescimento' AS tipo, 'ultimos_90_dias' AS periodo,
       'vs_periodo_anterior' AS comparacao, round_even(100.0 * (cur - ant) / ant, 2) AS variacao_perc,
       'POSITIVO' AS status FROM gc WHERE ant > 0 AND cur > ant * 1.2)"""
ORACLE["growth_clients"] = f"WITH {_TM}, {_GROWTH} SELECT * FROM gw"

_SINGLE = f"""sp AS (SELECT client AS cliente, product AS produto, 'Oportunidade' AS tipo,
       'SKU com 1 compra e sem retorno >120d' AS motivo, 'SUGESTAO' AS status FROM t WHERE product IS NOT NULL
       GROUP BY client, product
       HAVING count(*) = 1 AND epoch_us({TPCH_REF}) - epoch_us(max(date)) > 120 * 86400000000)"""
ORACLE["single_purchase"] = f"WITH {_TM}, {_SINGLE} SELECT * FROM sp"

ORACLE["minimum_alerts"] = f"""WITH {_TM}, {_min_rupture_ctes()}, {_INACT}, {_GROWTH}, {_SINGLE}
SELECT cliente, produto, tipo, status FROM mr WHERE status <> 'OK'
UNION ALL SELECT cliente, NULL, tipo, status FROM ia
UNION ALL SELECT cliente, NULL, tipo, status FROM gw
UNION ALL SELECT cliente, produto, tipo, status FROM sp"""
