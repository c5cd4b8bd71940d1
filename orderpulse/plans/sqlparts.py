"""Building blocks of the DuckDB oracle SQL (independent re-statements of each
query, used only to check the Spark plans)."""

from __future__ import annotations

TPCH_REF = "TIMESTAMP '2001-09-01 00:00:00'"
EVENTS_REF = "TIMESTAMP '2024-02-01 00:00:00'"


def fd(end: str, start: str) -> str:
    """Floor days between two timestamps."""
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS BIGINT)"


def msum(x: str) -> str:
    """Exact sum of 2-place money values (whole cents), as double."""
    return f"coalesce(CAST(sum(CAST(round({x} * 100) AS BIGINT)) AS DOUBLE) / 100.0, 0.0)"


def add_days(ts: str, days: str) -> str:
    return f"({ts} + to_microseconds(CAST(round(({days}) * 86400000000.0) AS BIGINT)))"


TX_TPCH = """
SELECT 'tpch' AS dataset_id, CAST(l.l_orderkey AS VARCHAR) AS order_id, o.o_orderdate AS date,
       c.c_name AS client, CAST(NULL AS VARCHAR) AS seller, p.p_brand AS sku, p.p_name AS product,
       l.l_extendedprice / nullif(l.l_quantity, 0) AS price, l.l_quantity AS qty,
       l.l_extendedprice AS subtotal, CAST(NULL AS VARCHAR) AS category,
       c.c_mktsegment AS segment, n.n_name AS city, r.r_name AS uf,
       (l.l_orderkey << 16) | l.l_linenumber AS ingest_seq
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""

TX_ORDERS = """
SELECT 'tpch_orders' AS dataset_id, CAST(o.o_orderkey AS VARCHAR) AS order_id, o.o_orderdate AS date,
       c.c_name AS client, CAST(NULL AS VARCHAR) AS seller, CAST(NULL AS VARCHAR) AS sku,
       CAST(NULL AS VARCHAR) AS product, o.o_totalprice AS price, 1.0 AS qty,
       o.o_totalprice AS subtotal, CAST(NULL AS VARCHAR) AS category,
       c.c_mktsegment AS segment, n.n_name AS city, r.r_name AS uf, o.o_orderkey AS ingest_seq
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""

TX_EVENTS = """
SELECT 'events' AS dataset_id, CAST(event_id AS VARCHAR) AS order_id, ts AS date,
       CAST(user_id AS VARCHAR) AS client, CAST(NULL AS VARCHAR) AS seller, event_type AS sku,
       event_type AS product, 1.0 AS price, value AS qty, value AS subtotal,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS segment,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS uf, event_id AS ingest_seq
FROM events
"""

TX = {"tpch": TX_TPCH, "tpch_orders": TX_ORDERS, "events": TX_EVENTS}


def gaps_cte(keys: str, source: str = "tx", distinct_dates: bool = False) -> str:
    """Rows of ``source`` with ``gap`` = floor days since the previous row of the key."""
    src = source
    if distinct_dates:
        src = f"(SELECT {keys}, date, min(ingest_seq) AS ingest_seq FROM {source} GROUP BY {keys}, date)"
    return (f"SELECT *, {fd('date', f'lag(date) OVER (PARTITION BY {keys} ORDER BY date, ingest_seq)')}"
            f" AS gap FROM {src}")


def mode_cte(key: str, col: str, source: str = "tx") -> str:
    """Most frequent non-null ``col`` per ``key``, smallest value on ties."""
    return (f"SELECT {key}, first({col} ORDER BY _c DESC, {col}) AS {col} FROM "
            f"(SELECT {key}, {col}, count(*) AS _c FROM {source} WHERE {col} IS NOT NULL "
            f"GROUP BY {key}, {col}) GROUP BY {key}")


def avg_rank(col: str) -> str:
    """pandas rank(pct=True, method='average') over all rows."""
    return (f"((rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"
            f" / count({col}) OVER ())")
