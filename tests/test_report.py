"""Report plan G01 on the reference's 3-row fixture (FIXTURES 1.2) and the sink."""

import os
import tempfile

from pyspark.sql import functions as F

from orderpulse.plans.reports import build_report
from orderpulse.schemas import REPORT_SHEETS
from orderpulse.sources.store import write_report
from tests.conftest import tx_frame


def test_five_named_tables(spark):
    rows = [("Cliente A", "SKU-A", "Produto A", "2024-01-01", "1", 2.0, 20.0, "Premium", "São Paulo", "SP"),
            ("Cliente B", "SKU-B", "Produto B", "2024-01-16", "2", 1.0, 15.0, "Mid", "Rio de Janeiro", "RJ"),
            ("Cliente A", "SKU-A", "Produto A", "2024-02-10", "3", 3.0, 28.5, "Premium", "São Paulo", "SP")]
    tx = tx_frame(spark, [r[:7] for r in rows])
    extra = spark.createDataFrame([(r[4], r[7], r[8], r[9]) for r in rows], "order_id string, s string, c string, u string")
    tx = tx.join(extra, "order_id").withColumn("segment", F.col("s")).withColumn("city", F.col("c")) \
        .withColumn("uf", F.col("u")).drop("s", "c", "u")
    tables = build_report(tx, "2024-03-01 00:00:00")
    assert list(tables) == list(REPORT_SHEETS.values())
    for name, df in tables.items():
        assert df.count() > 0, name
    out = tempfile.mkdtemp(prefix="orderpulse-report-")
    paths = write_report(tables, out)
    assert set(paths) == set(tables)
    for name, path in paths.items():
        assert os.path.isdir(path)
        assert spark.read.parquet(path).count() == tables[name].count()


def test_empty_input_raises(spark):
    import pytest
    tx = tx_frame(spark, [("a", "s", "p", "2024-01-01", "1", 1.0, 1.0)]).where("false")
    with pytest.raises(ValueError):
        build_report(tx, "2024-03-01 00:00:00")


def test_pro_and_panel_reports(spark):
    from orderpulse.plans.reports import panel_report, pro_report
    from orderpulse.sources.adapters import TPCH_REFERENCE_DATE, tpch
    tx = tpch(spark, "/root/testdata/sf0.001")
    pro = pro_report(tx, TPCH_REFERENCE_DATE)
    assert list(pro) == ["base", "clientes", "produtos", "insights", "alertas"]
    assert pro["insights"].count() == pro["alertas"].count() > 0
    panel = panel_report(tx, TPCH_REFERENCE_DATE, base_rows=100)
    assert panel["base_completa"].count() == 100
    assert {r["metric"] for r in panel["rfm_resumo"].collect()} == {"recency", "frequency", "monetary", "avg_ticket"}
    labels = {r["confiabilidade"] for r in panel["alvos_priorizados"].collect()}
    assert labels <= {"ALTA", "MÉDIA", "BAIXA"}
    assert all(r["type"] == r["type"].upper() for r in panel["alvos_priorizados"].select("type").collect())


def test_legacy_alert_fallback_and_export_casts(spark):
    from decimal import Decimal
    from orderpulse.plans.reports import insights_projection
    from orderpulse.sources.store import export_table
    legacy = spark.createDataFrame([("c", "ruptura", "diag", "act", "🔴")],
                                   "client string, type string, diagnosis string, recommended_action string, reliability string")
    r = insights_projection(legacy).first()
    assert r["insight"] == "diag" and r["action"] == "act" and r["sku"] is None
    t = spark.createDataFrame([(Decimal("1.50"),)], "subtotal decimal(28,2)")
    assert export_table({"transactions": t}, "transactions").schema["subtotal"].dataType.typeName() == "double"
    import pytest
    with pytest.raises(ValueError):
        export_table({"transactions": t}, "nope")


def test_alert_tables_store_only_what_they_read(spark, monkeypatch):
    from orderpulse.operators import alerts as AL
    from orderpulse.plans import reports as RP
    from orderpulse.sources.adapters import TPCH_REFERENCE_DATE, tpch
    stored, facts = [], RP.report_facts

    def seen(tx, columns=RP.REPORT_FACTS):
        stored.append(list(columns))
        return facts(tx, columns)
    monkeypatch.setattr(RP, "report_facts", seen)
    tx = tpch(spark, "/root/testdata/sf0.001")
    one = RP.pro_plans(tx, TPCH_REFERENCE_DATE, table="insights")
    target = RP.panel_plans(tx, TPCH_REFERENCE_DATE, table="alvos_priorizados")
    assert list(one) == ["insights"] and list(target) == ["alvos_priorizados"]
    assert stored == [AL.ALERT_FACTS, AL.ALERT_FACTS] and len(AL.ALERT_FACTS) < len(RP.REPORT_FACTS) / 2
    every = RP.pro_plans(tx, TPCH_REFERENCE_DATE)
    assert stored[-1] == RP.REPORT_FACTS
    a, b = one["insights"](), every["insights"]()
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
    import pytest
    with pytest.raises(ValueError):
        RP.pro_plans(tx.where("false"), TPCH_REFERENCE_DATE, table="insights")
