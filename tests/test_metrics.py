"""The reference's metrics fixture (FIXTURES 1.1) and invariants."""

import pytest
from pyspark.sql import functions as F

from orderpulse.operators import metrics as M
from tests.conftest import tx_frame

REF = "2024-04-01 00:00:00"


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        ("Cliente 1", "SKU-A", "Produto A", "2024-01-01", "1", 10.0, 100.0, "Premium"),
        ("Cliente 1", "SKU-A", "Produto A", "2024-01-16", "2", 8.0, 90.0, "Premium"),
        ("Cliente 2", "SKU-B", "Produto B", "2024-01-31", "3", 5.0, 60.0, "Mid"),
        ("Cliente 2", "SKU-B", "Produto B", "2024-03-01", "4", 5.0, 70.0, "Mid"),
    ]
    df = tx_frame(spark, [r[:7] for r in rows])
    seg = spark.createDataFrame([(r[4], r[7]) for r in rows], "order_id string, seg string")
    return df.join(seg, "order_id").withColumn("segment", F.col("seg")).drop("seg")


def test_turnover_of_client_1(spark, tx):
    r = {x["client"]: x for x in M.customer_base(tx, REF).collect()}
    assert r["Cliente 1"]["gm_cliente"] == 15.0
    assert r["Cliente 1"]["frequency"] == 2 and r["Cliente 1"]["monetary"] == 190.0


def test_premium_client_scores_higher(spark, tx):
    r = {x["client"]: x for x in M.customer_rfm(tx, REF).collect()}
    assert r["Cliente 1"]["rfm_score"] > r["Cliente 2"]["rfm_score"]
    assert round(r["Cliente 1"]["segment_weight"], 6) == round(0.5 + 190 / 320 * 0.5, 6)


def test_hero_flag(spark, tx):
    r = {x["sku"]: x for x in M.product_analytics(tx).collect()}
    assert r["SKU-A"]["hero_mix"] is True and r["SKU-B"]["hero_mix"] is False
    assert M.hero_threshold(tx).first()["hero_threshold"] == 178.0


def test_kpis_are_floats(spark, tx):
    k = M.general_kpis(tx, REF).first()
    assert isinstance(k["ruptura_projetada_media"], float)
    assert k["total_orders"] == 4 and k["total_customers"] == 2


def test_tier_counts_sum_to_clients(spark):
    from orderpulse.sources.adapters import TPCH_REFERENCE_DATE, tpch_orders
    tx = tpch_orders(spark, "/root/testdata/sf0.001")
    rfm = M.customer_rfm(tx, TPCH_REFERENCE_DATE)
    tiers = rfm.groupBy("tier").count().agg(F.sum("count")).first()[0]
    assert tiers == rfm.count() == tx.select("client").distinct().count()


def test_kpis_count_orders_shared_by_clients_once(spark):
    rows = [("a", "s", "p", "2024-01-01 10:00:00", "o1", 1.0, 1.1), ("a", "s", "p", "2024-01-03 10:00:00", "o1", 1.0, 2.2),
            ("b", "t", "p", "2024-01-02 10:00:00", "o1", 1.0, None), ("b", None, "p", None, None, 1.0, 4.0),
            (None, "u", "p", "2024-01-09 10:00:00", "o2", 1.0, 8.0)]
    k = M.general_kpis(tx_frame(spark, rows), "2024-01-11 10:00:00").first()
    assert (k.total_revenue, k.total_customers, k.total_products, k.total_orders) == (15.3, 2, 3, 2)
    assert (k.avg_recency, k.avg_frequency, k.period_days) == (8.5, 1.0, 8)
    assert k.period_start.day == 1 and k.period_end.day == 9
    base = {r.client: r for r in M.customer_base(tx_frame(spark, rows), "2024-01-11 10:00:00").collect()}
    assert {c: r.frequency for c, r in base.items()} == {"a": 1, "b": 1}
