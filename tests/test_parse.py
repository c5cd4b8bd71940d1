"""Golden values for parsing and text keys (FIXTURES section 2 edge values)."""

import datetime as dt

from pyspark.sql import functions as F

from orderpulse.functions import dates as D
from orderpulse.functions import numbers as N
from orderpulse.functions import text as T


def _one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("s")).alias("o")).first()["o"]


def test_locale_numbers(spark):
    cases = {"1.234,56": 1234.56, "123,45": 123.45, "1,234.56": 0.0, "12d": 0.0, None: 0.0,
             "7.89E+12": 7.89e12, " 12 ": 12.0, "-3,5": -3.5, "1234.5": 1234.5}
    for text, expected in cases.items():
        assert _one(spark, N.locale_number, text) == expected, text


def test_locale_int_truncates(spark):
    assert _one(spark, N.locale_int, "12,9") == 12
    assert _one(spark, N.locale_int, "-1,5") == -1
    assert _one(spark, N.locale_int, "abc") == 0


def test_locale_decimal_rejects_unparsable(spark):
    from decimal import Decimal
    assert _one(spark, N.locale_decimal, "1.234,565") == Decimal("1234.57")   # HALF_UP
    assert _one(spark, N.locale_decimal, "") == Decimal("0.00")
    assert _one(spark, N.locale_decimal, "1,234.56") is None


def test_order_code(spark):
    assert _one(spark, N.order_code, "7.89E+12") == "7890000000000"
    assert _one(spark, N.order_code, " 7891234567890 ") == "7891234567890"
    assert _one(spark, N.order_code, "A-12") == "A-12"
    assert _one(spark, N.order_code, None) == ""


def test_dates_dayfirst_and_iso(spark):
    assert _one(spark, D.parse_date, "05/03/2024") == dt.datetime(2024, 3, 5)
    assert _one(spark, D.parse_date, "2024-03-05") == dt.datetime(2024, 3, 5)
    assert _one(spark, D.parse_date, "5/3/2024 10:30") == dt.datetime(2024, 3, 5, 10, 30)
    assert _one(spark, D.parse_date, "not a date") is None
    assert _one(spark, lambda c: D.parse_date(c, dayfirst=False), "03/05/2024") == dt.datetime(2024, 3, 5)


def test_floor_days_is_not_datediff(spark):
    df = spark.createDataFrame([("2024-01-01 23:00:00", "2024-01-02 01:00:00")], "a string, b string")
    r = df.select(D.floor_days(F.col("b").cast("timestamp_ntz"), F.col("a").cast("timestamp_ntz")).alias("d"),
                  D.floor_days(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")).alias("n")).first()
    assert r["d"] == 0 and r["n"] == -1


def test_client_key_and_sku(spark):
    assert _one(spark, T.client_key, "Mercado São João") == "mercadosaojoao"
    assert _one(spark, T.client_key, "  Açaí & Cia_Ltda ") == "acaicialtda"
    assert _one(spark, T.client_key, "Café-Bar Ñandú 2") == "cafebarnandu2"
    assert _one(spark, T.generated_sku, "Café Torrado 500g") == "CAFETORRAD"
    assert _one(spark, T.generated_sku, "Açúcar 1kg") == "ACUCAR1KG"
    assert _one(spark, T.generated_sku, "") == "UNKNOWN"
    assert _one(spark, T.generated_sku, None) == "UNKNOWN"


def test_split_code_description(spark):
    df = spark.createDataFrame([("ABC-1 - Café - forte",), ("",), ("SEMTRACO",)], "s string")
    out = df.select(*T.split_code_description(F.col("s"))).collect()
    assert tuple(out[0]) == ("ABC", "1 - Café - forte")
    assert tuple(out[1]) == ("", "")
    assert tuple(out[2]) == ("SEMTRACO", "")


def test_to_utc_sao_paulo(spark):
    r = _one(spark, lambda c: D.to_utc(c.cast("timestamp_ntz")), "2024-03-05 10:00:00")
    assert r == dt.datetime(2024, 3, 5, 13, 0)


def test_date_shapes(spark):
    """Text as the reproduced parser reads it day-first (year-first text as year-month-day)."""
    d = dt.datetime
    cases = {
        "2024/03/05": d(2024, 3, 5), "2024.03.05": d(2024, 3, 5), "2024-3-5": d(2024, 3, 5), "2024/13/05": d(2024, 5, 13),
        "20240305": d(2024, 3, 5), "20240305T101112": d(2024, 3, 5, 10, 11, 12), "5 Mar 2024": d(2024, 3, 5),
        "05-Mar-2024": d(2024, 3, 5), "5/mar/2024": d(2024, 3, 5), "5. Mar 2024": d(2024, 3, 5), "05 Mar 24": d(2024, 3, 5),
        "Tue 5 Mar 2024": d(2024, 3, 5), "Mar 5, 2024": d(2024, 3, 5), "March 5 2024": d(2024, 3, 5), "2024-Mar-05": d(2024, 3, 5),
        "12/31/2024": d(2024, 12, 31), "31/12/2024": d(2024, 12, 31), "5/3/24": d(2024, 3, 5), "05.03.2024": d(2024, 3, 5),
        "05/03/2024 14:30": d(2024, 3, 5, 14, 30), "05/03/2024 2:30 PM": d(2024, 3, 5, 14, 30), "05/03/2024 14h30": d(2024, 3, 5, 14, 30),
        "5-3-2024 10:11:12.5": d(2024, 3, 5, 10, 11, 12, 500000), "05/03/2024T10:11": d(2024, 3, 5, 10, 11), "2024-03-05T10": d(2024, 3, 5, 10),
        "05/03/2024 12:05 am": d(2024, 3, 5, 0, 5), "2024-03": d(2024, 3, 1), "03/2024": d(2024, 3, 1), "Mar 2024": d(2024, 3, 1), "2024": d(2024, 1, 1),
        # instants: wall-clock in Sao Paulo (UTC-3)
        "2024-03-05T10:11:12Z": d(2024, 3, 5, 7, 11, 12), "2024-03-05T10:11:12-03:00": d(2024, 3, 5, 10, 11, 12),
        "2024-03-05 10:11:12+0300": d(2024, 3, 5, 4, 11, 12), "05/03/2024 10:11:12 UTC": d(2024, 3, 5, 7, 11, 12),
        "13/13/2024": None, "30/02/2024": None, "2024-02-30": None, "05/03": None, "202403": None, "44000": None, "1.5": None, "": None,
        "nan": None, "05/03/2024 25:00": None, "5 março 2024": None, "2024-W10-2": None, None: None, "05032024": None}
    rows = list(cases.items())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, s string")
    got = {r["i"]: r["o"] for r in df.select("i", D.parse_date(F.col("s")).alias("o")).collect()}
    assert {rows[i][0]: v for i, v in got.items()} == cases
    month_first = df.select("i", D.parse_date(F.col("s"), dayfirst=False).alias("o")).collect()
    assert {rows[r["i"]][0]: r["o"] for r in month_first}["05.03.2024"] == d(2024, 5, 3)
    kept = df.select(D.parse_date(F.col("s"), fallback=D.ts_literal("1999-01-01")).alias("o")).where("o is null").count()
    assert kept == 0


def test_keys_of_longer_decompositions(spark):
    """Ligatures, digraphs, unit signs and fractions keep all their letters (NFKD, then ASCII)."""
    names = {"Oﬃcina Ltda": "officinaltda", "ĳsselmeer": "ijsselmeer", "Café ½ kilo": "cafe12kilo", "Praça XV №3": "pracaxv3",
             "Ação & Cia_Ltda": "acaocialtda", "éclair": "eclair", "straße": "strae", "": "", None: "", "２４ｈ Mart": "24hmart"}
    for name, key in names.items():
        assert _one(spark, T.client_key, name) == key, name
    skus = {"Arroz 5㎏": "ARROZ5KG", "ﬁo dental": "FIODENTAL", "№ 7": "NO7", "Straße": "STRASSE", "Açúcar ½": "ACUCAR12", None: "UNKNOWN"}
    for name, sku in skus.items():
        got = _one(spark, T.generated_sku, name)
        assert (got or "").upper() == sku, name


def test_common_dates_are_split_once(spark):
    """The plan of a parsed date holds one split for each of the two common shapes, and one for the others."""
    from pyspark.sql import functions as F

    from orderpulse.functions.dates import parse_date
    rows = ["05/03/2024", "2024-03-05 14:05:06.25", "12.31.24", "2024-12-31T07:08", "31/02/2024", "", " ", "abc", None,
            "5 March 2024 2:05 pm", "20240305", "march 2024", "05-03-69 1:02"]
    want = ["2024-03-05 00:00:00", "2024-03-05 14:05:06.250000", "2024-12-31 00:00:00", "2024-12-31 07:08:00", None, None, None,
            None, None, "2024-03-05 14:05:00", "2024-03-05 00:00:00", "2024-03-01 00:00:00", "1969-03-05 01:02:00"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", parse_date(F.col("t")).alias("d"))
    assert [None if r.d is None else str(r.d) for r in df.orderBy("i").collect()] == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3
