"""Oracle SQL for the store queries and the cycle model."""

from __future__ import annotations

from orderpulse.plans.oracle import ORACLE
from orderpulse.plans.sqlparts import TPCH_REF, TX, add_days, fd, gaps_cte, msum

_TXP = f"tx AS ({TX['tpch'].replace('p.p_brand AS sku', 'CAST(l.l_partkey AS VARCHAR) AS sku')})"

ORACLE["dedupe_first"] = f"""WITH {_TXP}
SELECT dataset_id, order_id, sku, date, ingest_seq, qty, subtotal, product FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, order_id, sku, date
                               ORDER BY ingest_seq, qty, subtotal, product) AS rn FROM tx) WHERE rn = 1"""

ORACLE["keep_last"] = f"""WITH tx AS ({TX['tpch']})
SELECT client, product, ingest_seq, qty, subtotal, date FROM (
  SELECT *, row_number() OVER (PARTITION BY client, product ORDER BY ingest_seq DESC, qty DESC, subtotal DESC) AS rn
  FROM tx) WHERE rn = 1"""

ORACLE["fact_insert"] = f"""WITH {_TXP}
SELECT DISTINCT dataset_id, order_id, sku, date FROM tx
WHERE (dataset_id, order_id, sku, date) NOT IN (SELECT (dataset_id, order_id, sku, date) FROM tx
                                                WHERE date < TIMESTAMP '1998-01-01')"""

ORACLE["customer_upsert"] = """
SELECT regexp_replace(strip_accents(lower(c_name)), '[^a-z0-9]', '', 'g') AS name, c_name AS original_name,
       lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, '' AS ie, upper(lower(r_name)) AS uf,
       upper(n_name) AS city, c_mktsegment AS segment
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _cycle_sql(adapter: str, keys: str) -> str:
    return f"""
tx AS ({TX[adapter]}), t AS (SELECT * FROM tx WHERE {' AND '.join(k.strip() + ' IS NOT NULL' for k in keys.split(','))}),
dd AS (SELECT {keys}, date_trunc('day', date) AS date, min(ingest_seq) AS ingest_seq FROM t GROUP BY {keys}, date_trunc('day', date)),
g AS ({gaps_cte(keys, 'dd')}),
ga AS (SELECT {keys}, count(*) AS purchase_days, CAST(median(gap) AS DOUBLE) AS cycle_days, avg(gap) AS mean_gap,
              coalesce(CASE WHEN avg(gap) <> 0 THEN stddev_pop(gap) / avg(gap) END, 0.0) AS gap_cv,
              count(gap) AS n_gaps FROM g GROUP BY {keys}),
b AS (SELECT {keys}, max(date) AS last_order, count(DISTINCT order_id) AS orders, {msum('subtotal')} AS revenue,
             coalesce(sum(qty), 0.0) AS q FROM t GROUP BY {keys}),
cy AS (SELECT b.*, ga.purchase_days, ga.n_gaps, ga.cycle_days, ga.mean_gap, ga.gap_cv,
              {fd(TPCH_REF, 'b.last_order')} AS days_since FROM b LEFT JOIN ga USING ({keys}))"""


def _cycle_select(keys: str) -> str:
    return f"""SELECT {keys}, last_order, days_since, orders, round(revenue, 2) AS revenue, round(q / orders, 6) AS avg_qty,
       purchase_days, n_gaps, cycle_days, round(mean_gap, 6) AS mean_gap, round(gap_cv, 6) AS gap_cv,
       CASE WHEN cycle_days > 0 THEN {add_days('last_order', 'cycle_days')} END AS expected_next,
       round(CASE WHEN cycle_days > 0 THEN days_since / cycle_days * 100 END, 6) AS cycle_consumption_pct,
       CASE WHEN cycle_days > 0 THEN days_since - cycle_days END AS delay_days FROM cy"""


ORACLE["cycle_customer"] = f"WITH {_cycle_sql('tpch_orders', 'client')} {_cycle_select('client')}"
ORACLE["cycle_customer_sku"] = f"WITH {_cycle_sql('tpch', 'client, sku')} {_cycle_select('client, sku')}"

_STATUS = """
st AS (SELECT *, (purchase_days < 3 OR cycle_days IS NULL OR cycle_days = 0) AS ins,
              days_since / cycle_days AS ratio FROM cy),
st2 AS (SELECT *, CASE WHEN ins THEN NULL ELSE ratio END AS cycle_ratio,
               CASE WHEN ins THEN 'insufficient_history' WHEN ratio < 0.5 THEN 'frio'
                    WHEN ratio < 0.8 THEN 'aquecimento' WHEN ratio <= 1.2 THEN 'ataque' ELSE 'risco' END AS status
        FROM st)"""

ORACLE["window_status"] = f"""WITH {_cycle_sql('tpch_orders', 'client')}, {_STATUS}
SELECT client, days_since, cycle_days, purchase_days, round(cycle_ratio, 8) AS cycle_ratio, status FROM st2"""

ORACLE["priority_items"] = f"""WITH {_cycle_sql('tpch', 'client, sku')}, {_STATUS},
r AS (SELECT *, ((rank() OVER (ORDER BY revenue) + (count(*) OVER (PARTITION BY revenue) - 1) / 2.0)
                 / count(*) OVER ()) AS value_rank,
             ((rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0)
                 / count(*) OVER ()) AS frequency_rank,
             CASE WHEN status = 'insufficient_history' THEN 0.0 ELSE 1.0 / (1.0 + coalesce(gap_cv, 0.0)) END
                 AS confidence FROM st2)
SELECT client, sku, status,
       CASE status WHEN 'risco' THEN 'alto' WHEN 'ataque' THEN 'medio' WHEN 'aquecimento' THEN 'baixo'
                   WHEN 'frio' THEN 'baixo' ELSE 'indefinido' END AS risk_level,
       round(value_rank, 8) AS value_rank, round(frequency_rank, 8) AS frequency_rank,
       round(confidence, 6) AS confidence,
       round(0.40 * CASE status WHEN 'ataque' THEN 1.0 WHEN 'risco' THEN 0.8 WHEN 'aquecimento' THEN 0.5
                               WHEN 'frio' THEN 0.2 ELSE 0.0 END
             + 0.25 * value_rank + 0.20 * frequency_rank + 0.15 * confidence, 6) AS priority_score FROM r"""

ORACLE["instability"] = f"""WITH {_cycle_sql('tpch_orders', 'client')}
SELECT client, n_gaps, round(gap_cv, 6) AS gap_cv, 'instabilidade' AS type FROM cy WHERE n_gaps >= 4 AND gap_cv > 1.0"""

ORACLE["cohort_retention"] = f"""WITH tx AS ({TX['tpch_orders']}),
a AS (SELECT DISTINCT client, CAST(date_trunc('month', date) AS DATE) AS month FROM tx WHERE client IS NOT NULL),
f AS (SELECT client, min(month) AS cohort FROM a GROUP BY client),
c AS (SELECT f.cohort, (year(a.month) - year(f.cohort)) * 12 + month(a.month) - month(f.cohort) AS month_offset
      FROM a JOIN f USING (client)),
s AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY cohort)
SELECT c.cohort, CAST(month_offset AS INTEGER) AS month_offset, count(*) AS active, first(cohort_size) AS cohort_size,
       round(count(*) / first(cohort_size), 8) AS retention FROM c JOIN s USING (cohort) GROUP BY c.cohort, month_offset"""
