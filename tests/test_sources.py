"""Sources: calibration mappings (S05), CSV sheets (S02/S04), column mapping."""

import os
import tempfile

import pytest

from orderpulse.operators.normalize import metrics_frame, reparse_date_columns
from orderpulse.schemas import TX_ALIASES
from orderpulse.sources import columns as C
from orderpulse.sources.grid import load_mapping, read_sheet_csv


def _write(text, name="m.csv"):
    d = tempfile.mkdtemp(prefix="orderpulse-src-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_load_mapping_last_duplicate_wins(spark):
    p = _write("Apelido SKU,Código SKU,obs\n a1 ,X,\na2,Y,\n,Z,\na1,W,\n  ,Q,\na3,,\n")
    m = {r["key"]: r["value"] for r in load_mapping(spark, p, "alias", "sku").collect()}
    assert m == {}  # 'alias' is not a substring of 'apelidosku'
    p = _write("alias,sku\n a1 ,X\na2,Y\n,Z\na1,W\n  ,Q\na3,\n")
    m = {r["key"]: r["value"] for r in load_mapping(spark, p, "alias", "sku").collect()}
    assert m == {"a1": "W", "a2": "Y"}


def test_load_mapping_single_column_is_empty(spark):
    p = _write("only\nx\n")
    assert load_mapping(spark, p, "alias", "sku").count() == 0


def test_missing_mapping_file_raises(spark):
    with pytest.raises(Exception):
        load_mapping(spark, "/nonexistent/orderpulse/map.csv", "alias", "sku").collect()


def test_read_sheet_csv_with_sheet_partitions(spark):
    d = tempfile.mkdtemp(prefix="orderpulse-sheets-")
    for sheet, rows in (("a", "Pedido;Cliente\n1;X\n"), ("b", "Pedido;Cliente\n2;Y\n3;Z\n")):
        os.makedirs(os.path.join(d, f"sheet={sheet}"))
        with open(os.path.join(d, f"sheet={sheet}", "part.csv"), "w") as f:
            f.write(rows)
    assert read_sheet_csv(spark, d, ";").count() == 3
    only_b = read_sheet_csv(spark, d, ";", sheet="b")
    assert sorted(r["Pedido"] for r in only_b.collect()) == ["2", "3"]


def test_column_mapping_metadata():
    cols = ["Data_Emissao ", "PEDIDO", "Razao_Social", "Preço Unitário", "qtde", "Valor Total"]
    m = C.exact_alias_map(cols, TX_ALIASES)
    assert m["date"] == "Data_Emissao " and m["order_id"] == "PEDIDO" and m["client"] == "Razao_Social"
    assert m["qty"] == "qtde" and "price" not in m
    f = C.fuzzy_map(cols)
    assert f["price"] == "Preço Unitário" and f["subtotal"] == "Valor Total" and f["date"] == "Data_Emissao "
    assert C.first_present(cols, ["x", "qtde", "PEDIDO"]) == "qtde"


def test_reparse_and_metrics_frame(spark):
    import datetime as dt
    from decimal import Decimal
    df = spark.createDataFrame([("05/03/2024", "x", Decimal("1.50"), 2)],
                               "data_emissao string, other string, subtotal decimal(28,2), qty long")
    r = metrics_frame(reparse_date_columns(df)).first()
    assert r["data_emissao"] == dt.datetime(2024, 3, 5) and r["other"] == "x"
    assert r["subtotal"] == 1.5 and isinstance(r["qty"], float)
    lower = C.lower_trim_columns(spark.createDataFrame([(1,)], "` Cliente ` int"))
    assert lower.columns == ["cliente"]


def test_read_grid_csv_keeps_line_order(spark):
    from orderpulse.operators.extract import extract_blocks
    from orderpulse.sources.grid import read_grid_csv
    text = ("Produto: Café Torrado 500g\n"
            "Data Emissão;Pedido;Cliente;Vendedor;Preço;Quantidade;Subtotal\n"
            "05/03/2024;1001;Mercado São João;Ana;12,50;4;50,00\n"
            ";;;;;4;50,00\n")
    p = _write(text, "relatorio.csv")
    grid = read_grid_csv(spark, p, sep=";")
    rows = grid.orderBy("row_idx").collect()
    assert [r["cells"][0] for r in rows] == ["Produto: Café Torrado 500g", "Data Emissão",
                                             "05/03/2024", None]
    out = extract_blocks(grid).collect()
    assert len(out) == 1 and out[0]["price"] == 12.5 and out[0]["product"] == "Café Torrado 500g"
