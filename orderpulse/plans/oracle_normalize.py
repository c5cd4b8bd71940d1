"""Oracle SQL for normalisation, calibration joins, enrichment and validation."""

from __future__ import annotations

from orderpulse.plans.oracle import ORACLE

_LINES = """
SELECT o.o_orderdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
       l.l_returnflag, l.l_discount, c.c_custkey, c.c_name, n.n_name, r.r_name, p.p_name, p.p_retailprice, p.p_brand
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""

_BASE = f"""
SELECT date_trunc('day', o_orderdate) AS date, CAST(l_orderkey AS VARCHAR) AS order_id, c_name AS client,
       'Vendedor ' || CAST(l_suppkey AS VARCHAR) AS seller, CAST(l_partkey AS VARCHAR) AS sku, p_name AS product,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS qty,
       CASE WHEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) = 0
            THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) * CAST(CAST(l_quantity AS BIGINT) AS DOUBLE)
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) END AS subtotal,
       '' AS category, '' AS segment, n_name AS city, r_name AS uf
FROM ({_LINES})"""

ORACLE["base_geral"] = _BASE
ORACLE["base_geral_split"] = _BASE.replace(
    "p_name AS product", "CAST(l_partkey AS VARCHAR) || ' - ' || p_name AS product")

ORACLE["base_geral_calibrated"] = f"""
WITH b AS ({_BASE}),
sa AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_brand AS v FROM part),
sn AS (SELECT p_brand AS k, max(p_type) AS v FROM part GROUP BY p_brand),
ca AS (SELECT c_name AS k, 'CLI-' || CAST(c_custkey AS VARCHAR) AS v FROM customer),
j1 AS (SELECT b.* REPLACE (coalesce(sa.v, b.sku) AS sku) FROM b LEFT JOIN sa ON trim(b.sku) = sa.k),
j2 AS (SELECT j1.* REPLACE (coalesce(sn.v, j1.product) AS product) FROM j1 LEFT JOIN sn ON trim(j1.sku) = sn.k)
SELECT date, order_id, coalesce(ca.v, j2.client) AS client, seller, sku, product, price, qty, subtotal, category,
       segment, city, uf FROM j2 LEFT JOIN ca ON trim(j2.client) = ca.k"""

ORACLE["canonical_keys"] = f"""
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS order_id, c_name AS client_original,
       'CLI-' || CAST(c_custkey AS VARCHAR) AS client_canonical,
       regexp_replace(strip_accents(lower('CLI-' || CAST(c_custkey AS VARCHAR))), '[^a-z0-9]', '', 'g') AS client_key,
       CAST(l_partkey AS VARCHAR) AS sku_original, p_brand AS sku_canonical,
       substr(regexp_replace(strip_accents(upper(p_brand)), '[^A-Za-z0-9]', '', 'g'), 1, 10) AS sku_key
FROM ({_LINES})"""

ORACLE["customer_master"] = """
SELECT regexp_replace(strip_accents(lower(c_name)), '[^a-z0-9]', '', 'g') AS name, c_name AS original_name,
       lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, '' AS ie, upper(lower(r_name)) AS uf, n_name AS city,
       c_mktsegment AS segment
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""

_RAW = f"""
SELECT l_orderkey * 8 + l_linenumber AS ingest_seq, p_name AS product, o_orderdate AS date,
       CAST(l_orderkey AS VARCHAR) AS order_id, c_name AS client, c_custkey, n_name, r_name,
       CASE WHEN l_discount = 0 THEN 0.0 ELSE p_retailprice END AS price,
       CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_extendedprice AS subtotal
FROM ({_LINES})"""

_CHECKED = f"""
SELECT *, CASE WHEN price IS NULL OR price <= 0 THEN 'Preço deve ser um número válido'
               WHEN qty IS NULL OR CAST(trunc(qty) AS BIGINT) <= 0 THEN 'Quantidade deve ser um número inteiro válido'
          END AS error FROM ({_RAW})"""

ORACLE["validate_valid"] = f"""
SELECT ingest_seq, product, order_id, client, price, CAST(trunc(qty) AS BIGINT) AS qty,
       CASE WHEN abs(subtotal - price * CAST(trunc(qty) AS BIGINT)) > 0.01 THEN price * CAST(trunc(qty) AS BIGINT)
            ELSE subtotal END AS subtotal
FROM ({_CHECKED}) WHERE error IS NULL"""

ORACLE["validate_rejects"] = f"SELECT ingest_seq, error FROM ({_CHECKED}) WHERE error IS NOT NULL"
ORACLE["validation_summary"] = f"SELECT error, count(*) AS n FROM ({_CHECKED}) WHERE error IS NOT NULL GROUP BY error"

ORACLE["customer_enrich"] = f"""
WITH v AS (SELECT * FROM ({_CHECKED}) WHERE error IS NULL),
px AS (SELECT *, CAST(round(price, 2) AS DECIMAL(28,2)) AS pdec FROM v)
SELECT 'tpch' AS dataset_id, ingest_seq, order_id,
       CAST(timezone('UTC', timezone('America/Sao_Paulo', date)) AS TIMESTAMP) AS date,
       regexp_replace(strip_accents(lower(client)), '[^a-z0-9]', '', 'g') AS client,
       CASE WHEN product IS NULL OR product = '' THEN 'UNKNOWN'
            ELSE substr(regexp_replace(strip_accents(upper(product)), '[^A-Za-z0-9]', '', 'g'), 1, 10) END AS sku,
       product, pdec AS price, CAST(trunc(qty) AS BIGINT) AS qty,
       CAST(pdec * CAST(trunc(qty) AS BIGINT) AS DECIMAL(28,2)) AS subtotal,
       c.c_mktsegment AS segment, n_name AS city, upper(lower(r_name)) AS uf
FROM px JOIN customer c ON px.c_custkey = c.c_custkey"""
