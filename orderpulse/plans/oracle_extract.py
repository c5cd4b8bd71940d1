"""Oracle SQL for parsing functions and grid extraction.

Extraction oracles derive the expected transactions directly from the tables
the stand-in grids were laid out from (one data row per line item), then apply
the extractor's documented rules (gates, first-row dedupe)."""

from __future__ import annotations

from orderpulse.plans.oracle import ORACLE

ORACLE["client_key"] = """
SELECT doc_id, coalesce(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g'), '') AS client_key
FROM documents"""

ORACLE["generated_sku"] = """
SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 'UNKNOWN'
       ELSE substr(regexp_replace(strip_accents(upper(p_name)), '[^A-Za-z0-9]', '', 'g'), 1, 10) END AS sku
FROM part"""

ORACLE["locale_number"] = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, CAST(l_quantity AS BIGINT) AS qty,
       CAST(round(l_extendedprice, 2) AS DECIMAL(28,2)) AS price_dec FROM lineitem"""

ORACLE["date_parse"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate ELSE date_trunc('day', o_orderdate) END
       AS parsed FROM orders"""

ORACLE["order_code"] = """
SELECT o_orderkey, CASE
  WHEN o_orderpriority LIKE '1%' THEN CAST(o_orderkey * 1000000000 AS VARCHAR)
  WHEN o_orderpriority LIKE '2%' THEN lpad(CAST(o_orderkey AS VARCHAR), 13, '7')
  ELSE CAST(o_orderkey AS VARCHAR) END AS code FROM orders"""

ORACLE["to_utc"] = """
SELECT o_orderkey, CAST(timezone('UTC', timezone('America/Sao_Paulo', o_orderdate)) AS TIMESTAMP) AS utc FROM orders"""

_LINES = """
SELECT n.n_name, r.r_name, o.o_orderdate AS date, CAST(l.l_orderkey AS VARCHAR) AS order_id, c.c_name AS client,
       'Vendedor ' || CAST(l.l_suppkey AS VARCHAR) AS seller, p.p_retailprice AS price,
       CAST(l.l_quantity AS BIGINT) AS qty, l.l_extendedprice AS subtotal, p.p_name AS product,
       l.l_partkey, l.l_orderkey * 8 + l.l_linenumber + 2 AS pos
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _dedupe(src: str) -> str:
    return f"""
SELECT file_id, arg_min(row_idx, row_idx) AS row_idx, product, date, order_id, client,
       arg_min(seller, row_idx) AS seller, price, qty, arg_min(subtotal, row_idx) AS subtotal
FROM ({src}) WHERE date IS NOT NULL AND client <> '' AND price >= 0 AND qty <> 0
GROUP BY file_id, date, order_id, product, client, qty, price"""


_BLOCK_ROWS = f"""SELECT n_name AS file_id, l_partkey * 4294967296 + pos AS row_idx, product, date, order_id, client,
       seller, price, qty, subtotal FROM ({_LINES})"""
_FLAT_ROWS = f"""SELECT r_name AS file_id, pos AS row_idx, product, date, order_id, client,
       seller, price, qty, subtotal FROM ({_LINES})"""

ORACLE["block_extract"] = _dedupe(_BLOCK_ROWS)
ORACLE["structured_extract"] = _dedupe(_FLAT_ROWS)
ORACLE["extract_transactions"] = _dedupe(_BLOCK_ROWS) + " UNION ALL " + _dedupe(_FLAT_ROWS)
ORACLE["layout_router"] = """
SELECT n_name AS file_id, true AS is_block_report FROM nation WHERE n_nationkey IN
  (SELECT c_nationkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
   JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
UNION ALL SELECT r_name, false FROM region"""

# The ingest: rows of the stand-in order sheets in file order, within-file dedupe, validation, first per fact key.
_PT = "replace(replace(replace(format('{{:,.2f}}', {0}), ',', '#'), '.', ','), '#', '.')"
_SHEET = f"""
lines AS (
  SELECT n.n_name, date_trunc('day', o.o_orderdate) AS day, CAST(l.l_orderkey AS VARCHAR) AS order_id, c.c_name, c.c_custkey,
         CASE l.l_suppkey % 3 WHEN 0 THEN 'Vendedor; ' || l.l_suppkey WHEN 1 THEN 'Vendedor "A"' || chr(10) || l.l_suppkey
              ELSE 'Vendedor ' || l.l_suppkey END AS seller,
         CASE l.l_suppkey % 3 WHEN 0 THEN '"Vendedor; ' || l.l_suppkey || '"'
              WHEN 1 THEN '"Vendedor ""A""' || chr(10) || l.l_suppkey || '"' ELSE 'Vendedor ' || l.l_suppkey END AS seller_text,
         CASE WHEN l.l_discount = 0 THEN 0.0 ELSE p.p_retailprice END AS price,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS BIGINT) AS qty,
         l.l_extendedprice AS sub, p.p_name AS product, l.l_partkey, l.l_orderkey * 8 + l.l_linenumber AS pos,
         n.n_name AS city, upper(r.r_name) AS uf, c.c_mktsegment AS segment
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
placed AS (
  SELECT *, seller_text || ';' || {_PT.format('price')} || ';' || qty || ';' || {_PT.format('sub')} AS txt FROM lines
  WHERE c_name <> '' AND qty <> 0 AND price >= 0),
extracted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, order_id, product, c_name, qty, price
                                              ORDER BY l_partkey, pos, txt) AS rn FROM placed) WHERE rn = 1),
checked AS (
  SELECT *, CASE WHEN price <= 0 THEN 'Preço deve ser um número válido'
                 WHEN qty <= 0 THEN 'Quantidade deve ser um número inteiro válido' END AS error FROM extracted),
valid AS (
  SELECT *, CAST(timezone('UTC', timezone('America/Sao_Paulo', day)) AS TIMESTAMP) AS date,
         substr(regexp_replace(strip_accents(upper(product)), '[^A-Za-z0-9]', '', 'g'), 1, 10) AS sku
  FROM checked WHERE error IS NULL),
facts AS (
  SELECT 'tpch' AS dataset_id, order_id, date, regexp_replace(strip_accents(lower(c_name)), '[^a-z0-9]', '', 'g') AS client,
         seller, sku, product, CAST(price AS DECIMAL(28,2)) AS price, qty,
         CAST(CAST(price AS DECIMAL(18,2)) * qty AS DECIMAL(28,2)) AS subtotal,
         CASE WHEN c_custkey % 50 <> 0 THEN segment END AS segment, CASE WHEN c_custkey % 50 <> 0 THEN city END AS city,
         CASE WHEN c_custkey % 50 <> 0 THEN uf END AS uf,
         row_number() OVER (PARTITION BY order_id, sku, date, product ORDER BY l_partkey, pos, txt) AS rn FROM valid)"""

ORACLE["ingest_stream"] = f"""WITH {_SHEET}
SELECT dataset_id, order_id, date, client, seller, sku, product, price, qty, subtotal, segment, city, uf FROM facts WHERE rn = 1"""

ORACLE["ingest_rejects"] = f"""WITH {_SHEET}
SELECT 'orders' AS kind, error, product, order_id, seller, CAST(qty AS VARCHAR) AS qty, CAST(NULL AS VARCHAR) AS cnpj
FROM checked WHERE error IS NOT NULL
UNION ALL SELECT 'customers', 'Nome do cliente é obrigatório', NULL, NULL, NULL, NULL, lpad(CAST(c_custkey AS VARCHAR), 14, '0')
FROM customer WHERE c_custkey % 50 = 0"""

ORACLE["ingest_manifest"] = f"""WITH {_SHEET},
sheets AS (SELECT CAST(sum(ceil(n / 200000.0)) AS BIGINT) AS files FROM (SELECT count(*) AS n FROM lines GROUP BY n_name) AS t)
SELECT 'orders' AS kind, 'READY' AS status, (SELECT files FROM sheets) AS files,
       (SELECT count(*) FROM facts WHERE rn = 1) AS rows, (SELECT count(*) FROM checked WHERE error IS NOT NULL) AS rejects
UNION ALL SELECT 'orders', 'DUPLICATE', 1, 0, 0
UNION ALL SELECT 'customers', 'READY', CAST(ceil(count(*) / 200000.0) AS BIGINT), count(*) FILTER (c_custkey % 50 <> 0),
       count(*) FILTER (c_custkey % 50 = 0) FROM customer"""
