import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from orderpulse.session import build_session
    s = build_session(app="orderpulse-tests", master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def tx_frame(spark, rows, extra_cols=()):
    """Canonical transactions from tuples (client, sku, product, date, order_id, qty, subtotal, *extra)."""
    from pyspark.sql import functions as F
    from orderpulse.schemas import TRANSACTION_COLUMNS
    cols = ["client", "sku", "product", "date", "order_id", "qty", "subtotal", *extra_cols]
    df = spark.createDataFrame(rows, cols)
    df = df.withColumn("ingest_seq", F.monotonically_increasing_id())
    df = df.withColumn("date", F.col("date").cast("timestamp_ntz"))
    for c in TRANSACTION_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*TRANSACTION_COLUMNS, *[c for c in df.columns if c not in TRANSACTION_COLUMNS])
