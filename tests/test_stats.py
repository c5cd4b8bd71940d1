"""Exact-value statistics, as the reference's unit tests state them."""

import datetime as dt

from pyspark.sql import functions as F

from orderpulse.operators import stats as S
from orderpulse.operators.gaps import gaps


def _dates_frame(spark, dates):
    rows = [("c", d, i) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "client string, date timestamp_ntz, ingest_seq long")


def test_repurchase_probability(spark):
    d = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15), dt.datetime(2024, 2, 10), dt.datetime(2024, 3, 5)]
    g = gaps(_dates_frame(spark, d), ["client"])
    r = S.repurchase_probability(g, ["client"], 40).first()
    assert r["prob_recompra"] == 1.0


def test_repurchase_single_date_is_zero(spark):
    g = gaps(_dates_frame(spark, [dt.datetime(2024, 1, 1)]), ["client"])
    assert S.repurchase_probability(g, ["client"], 90).first()["prob_recompra"] == 0.0


def test_turnover_interval(spark):
    df = spark.createDataFrame([("c", float(v)) for v in (10, 12, 14, 16, 18)], "client string, gap double")
    r = S.turnover_interval(df, ["client"], 0.8).first()
    assert round(r["ic_low"], 6) == 10.8 and round(r["ic_high"], 6) == 17.2


def test_volume_outlier_flags_only_index_3(spark):
    vals = [10, 11, 12, 100, 11, 9]
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(vals)], "client string, i long, qty double")
    out = S.volume_outliers(df, ["client"], "qty", 2.0).select("i").collect()
    assert [r["i"] for r in out] == [3]


def test_volume_outlier_constant_series_flags_nothing(spark):
    df = spark.createDataFrame([("c", 5.0)] * 4, "client string, qty double")
    assert S.volume_outliers(df, ["client"], "qty", 0.1).count() == 0


def test_coefficient_of_variation(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 0.0), ("b", 10.0), ("b", 12.0), ("b", 14.0)],
                               "k string, v double")
    r = {x["k"]: x["cv"] for x in df.groupBy("k").agg(S.cv(F.col("v")).alias("cv")).collect()}
    assert r["a"] == 0.0 and round(r["b"], 3) == 0.136


def test_survival(spark):
    df = spark.createDataFrame([("c", e) for e in (1, 0, 1, 1, 0, 1)], "k string, e int")
    r = df.groupBy("k").agg(S.survival(F.col("e") == 1).alias("s")).first()["s"]
    assert r == 0.625
    assert spark.range(1).select(F.bround(F.lit(r), 2)).first()[0] == 0.62
