"""Dirty input is quarantined or nulled; it neither ends the job nor changes other rows."""

import pytest
from pyspark.sql import functions as F

from orderpulse.functions.dates import to_utc
from orderpulse.functions.numbers import order_code
from orderpulse.operators.extract import classify_files
from orderpulse.operators.normalize import normalize_transactions
from orderpulse.operators.stats import cv, volume_outliers
from orderpulse.operators.validate import validate_transactions
from orderpulse.sources.grid import read_grid_csv
from orderpulse.sources.store import write_report


def test_validation_rejects_what_is_no_number(spark):
    rows = [("p", "1", "c", "abc", "3", "9"), ("p", "2", "c", "2.0", "2.5", "5"), ("p", "3", "c", "2.0", "3", "x"),
            ("p", "4", "c", "NaN", "3", "6"), ("p", "5", "c", "2.0", " 4 ", None)]
    df = spark.createDataFrame(rows, "product string, order_id string, client string, price string, qty string, "
                                     "subtotal string").withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz"))
    valid, rejects = validate_transactions(df)
    assert {r.order_id: (r.qty, r.subtotal) for r in valid.collect()} == {"3": (3, 6.0), "5": (4, 8.0)}
    assert {r.order_id: r.error for r in rejects.collect()} == {
        "1": "Preço deve ser um número válido", "2": "Quantidade deve ser um número inteiro válido",
        "4": "Preço deve ser um número válido"}
    text = df.withColumn("date", F.lit("2024-01-01"))
    valid, rejects = validate_transactions(text)
    assert valid.count() == 0
    assert {r.error for r in rejects.collect()} == {"Data deve ser um objeto datetime"}


def test_nan_does_not_spread(spark):
    rows = [("k", float(x)) for x in [10, 11, 12, 11, 9, 10, 11, 10, 12, 11, 10, 500]]
    clean = spark.createDataFrame(rows, "k string, qty double")
    dirty = spark.createDataFrame([*rows, ("k", float("nan")), ("k", None)], "k string, qty double")
    pick = lambda df: [(r.qty, round(r.zscore, 9)) for r in volume_outliers(df, ["k"]).collect()]
    assert pick(dirty) == pick(clean) and len(pick(clean)) == 1
    assert dirty.agg(cv(F.col("qty"))).first()[0] == pytest.approx(clean.agg(cv(F.col("qty"))).first()[0])


def test_empty_cells_and_large_exponents(spark):
    grid = spark.createDataFrame([("f", 0, []), ("f", 1, ["Produto: x"]), ("g", 0, [])],
                                 "file_id string, row_idx long, cells array<string>")
    assert {r.file_id: r.is_block_report for r in classify_files(grid).collect()} == {"f": True, "g": False}
    df = spark.createDataFrame([("1.0E+40",), ("7.89E+12",)], "v string")
    assert [r[0] for r in df.select(order_code(F.col("v"))).collect()] == ["1.0E+40", "7890000000000"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_to_utc_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",)], "t string")
        got = [str(r[0]) for r in df.select(to_utc(F.col("t").cast("timestamp_ntz"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-03-10 05:30:00", "2024-11-03 04:30:00"]


def test_repeated_customers_do_not_multiply_facts(spark):
    raw = spark.createDataFrame([("1", "Ana", "p", "10,00", 2)],
                                "order_id string, client string, product string, price string, qty long")
    raw = raw.withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz"))
    customers = spark.createDataFrame([("ana", "A", "x", "SP"), ("ana", "B", "y", "RJ")],
                                      "name string, segment string, city string, uf string")
    assert normalize_transactions(raw, "d", customers).count() == 1


def test_separator_is_literal_and_files_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.csv").write_text("x|y\n")
    rows = read_grid_csv(spark, str(tmp_path / "*"), sep="|").collect()
    assert [r.cells for r in rows] == [["x", "y"], ["x", "y"]] and len({r.file_id for r in rows}) == 2


def test_report_tables_never_share_a_folder(spark, tmp_path):
    df = spark.range(1)
    long = "a" * 31
    assert len(set(write_report({long + "x": df, long + "y": df}, str(tmp_path / "r")).values())) == 2
    with pytest.raises(ValueError):
        write_report({"a b": df, "a_b": df}, str(tmp_path / "s"))
