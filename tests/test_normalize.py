"""Base Geral rules (P13, P14, P16, P18) and canonical transactions."""

import datetime as dt
from decimal import Decimal

from orderpulse.operators import normalize as NZ


def test_code_split_keeps_raw_product_when_product_column_exists(spark):
    df = spark.createDataFrame([("05/03/2024", "1", "Loja", "A1 - Café", "10", "2", "")],
                               ["Data", "Pedido", "Cliente", "Produto", "Preço", "Qtd", "Total"])
    r = NZ.normalize_structure(df).first()
    assert r["sku"] == "A1" and r["product"] == "A1 - Café"
    assert r["subtotal"] == 20.0                        # P16: missing subtotal = price x qty
    assert r["date"] == dt.datetime(2024, 3, 5) and r["category"] == ""


def test_product_falls_back_to_sku(spark):
    df = spark.createDataFrame([("X9", "Loja", "3.5", "2", "7")], ["Código", "Cliente", "Preço", "Qtd", "Total"])
    r = NZ.normalize_structure(df).first()
    assert r["sku"] == "X9" and r["product"] == "X9" and r["price"] == 3.5


def test_dot_decimal_only_by_default(spark):
    df = spark.createDataFrame([("1.234,56", "1")], ["Preço", "Qtd"])
    assert NZ.normalize_structure(df).first()["price"] is None
    assert NZ.normalize_structure(df, locale_numbers=True).first()["price"] == 1234.56


def test_canonical_transactions_and_enrichment(spark):
    raw = spark.createDataFrame(
        [("Café Torrado 500g", dt.datetime(2024, 3, 5, 9, 0), "1001", "Mercado São João", "Ana", "12,505", 4)],
        "product string, date timestamp_ntz, order_id string, client string, seller string, price string, qty long")
    cust = spark.createDataFrame([("mercadosaojoao", "SP", "São Paulo", "Premium")],
                                 "name string, uf string, city string, segment string")
    r = NZ.normalize_transactions(raw, "ds", cust).first()
    assert r["client"] == "mercadosaojoao" and r["sku"] == "CAFETORRAD"
    assert r["price"] == Decimal("12.51") and r["subtotal"] == Decimal("50.04")
    assert r["date"] == dt.datetime(2024, 3, 5, 12, 0)     # São Paulo -> UTC
    assert (r["uf"], r["segment"]) == ("SP", "Premium")
