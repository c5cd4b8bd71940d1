"""Driver tables -> canonical transactions.

Every adapter returns the canonical columns of ``schemas.TRANSACTION_SCHEMA`` with
money and quantities as double and ``date`` as ``timestamp_ntz``. ``ingest_seq``
is a total order standing in for arrival order; for line items it is
``(l_orderkey << 16) | l_linenumber`` (line numbers are below 2^16 and order keys
below 2^47).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.schemas import TRANSACTION_COLUMNS
from orderpulse.sources.tables import bounded_broadcast, read_table

# Fixed reference dates used with the driver tables (after their last date).
TPCH_REFERENCE_DATE = "2001-09-01 00:00:00"
EVENTS_REFERENCE_DATE = "2024-02-01 00:00:00"

# nation (25 rows) and region (5) are fixed-size dimensions; the check guards it.
_DIM_MAX_ROWS = 10_000


def _canonical(df: DataFrame, **cols) -> DataFrame:
    types = {"date": "timestamp_ntz", "price": "double", "qty": "double",
             "subtotal": "double", "ingest_seq": "long"}
    out = []
    for name in TRANSACTION_COLUMNS:
        c = cols.get(name, F.lit(None))
        out.append(c.cast(types.get(name, "string")).alias(name))
    return df.select(*out)


def _customer_geo(spark: SparkSession, data_dir: str) -> DataFrame:
    nation = read_table(spark, data_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, data_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(bounded_broadcast(region, _DIM_MAX_ROWS),
                      nation.n_regionkey == region.r_regionkey, "left")
    cust = read_table(spark, data_dir, "customer",
                      ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return cust.join(bounded_broadcast(geo, _DIM_MAX_ROWS),
                     cust.c_nationkey == geo.n_nationkey, "left")


def tpch(spark: SparkSession, data_dir: str, sku: str = "brand",
         dataset_id: str = "tpch") -> DataFrame:
    """One row per line item: client = customer name, sku = part brand
    (``sku="part"``: part key), product = part name, order = order key."""
    li = read_table(spark, data_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    orders = read_table(spark, data_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    part = read_table(spark, data_dir, "part", ["p_partkey", "p_name", "p_brand"])
    cust = _customer_geo(spark, data_dir)
    # customers meet orders before line items do, so line items are shuffled for orders and parts only
    placed = orders.join(cust, F.col("o_custkey") == cust.c_custkey)
    df = (li.join(placed, li.l_orderkey == orders.o_orderkey)
          .join(part, li.l_partkey == part.p_partkey))
    sku_col = F.col("p_brand") if sku == "brand" else F.col("l_partkey")
    return _canonical(
        df,
        dataset_id=F.lit(dataset_id), order_id=F.col("l_orderkey"), date=F.col("o_orderdate"),
        client=F.col("c_name"), sku=sku_col, product=F.col("p_name"),
        price=F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)),
        qty=F.col("l_quantity"), subtotal=F.col("l_extendedprice"),
        segment=F.col("c_mktsegment"), city=F.col("n_name"), uf=F.col("r_name"),
        ingest_seq=F.shiftleft(F.col("l_orderkey"), 16).bitwiseOR(F.col("l_linenumber")),
    )


def tpch_orders(spark: SparkSession, data_dir: str, dataset_id: str = "tpch_orders") -> DataFrame:
    """One row per order (quantity 1, subtotal = order total price)."""
    orders = read_table(spark, data_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    cust = _customer_geo(spark, data_dir)
    df = orders.join(cust, F.col("o_custkey") == cust.c_custkey)
    return _canonical(
        df,
        dataset_id=F.lit(dataset_id), order_id=F.col("o_orderkey"), date=F.col("o_orderdate"),
        client=F.col("c_name"), price=F.col("o_totalprice"), qty=F.lit(1.0),
        subtotal=F.col("o_totalprice"), segment=F.col("c_mktsegment"), city=F.col("n_name"),
        uf=F.col("r_name"), ingest_seq=F.col("o_orderkey"),
    )


def events(spark: SparkSession, data_dir: str, dataset_id: str = "events") -> DataFrame:
    """One row per event: client = user id, sku = product = event type, qty = subtotal = value."""
    ev = read_table(spark, data_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return _canonical(
        ev,
        dataset_id=F.lit(dataset_id), order_id=F.col("event_id"), date=F.col("ts"),
        client=F.col("user_id"), sku=F.col("event_type"), product=F.col("event_type"),
        price=F.lit(1.0), qty=F.col("value"), subtotal=F.col("value"),
        ingest_seq=F.col("event_id"),
    )


ADAPTERS = {"tpch": tpch, "tpch_orders": tpch_orders, "events": events}
