"""Distributed ranks and quantiles against pandas/numpy, forcing many buckets."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from orderpulse.operators.ranks import avg_rank_pct, exact_quantiles


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")


def test_avg_rank_matches_pandas_with_ties_and_buckets(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 400), np.full(300, 7)]).astype(float)   # a hot value
    df = _frame(spark, vals.tolist())
    got = avg_rank_pct(df, "v", "p", rows_per_bucket=5).toPandas().sort_values("id")
    exp = pd.Series(vals).rank(pct=True, method="average").to_numpy()
    assert np.allclose(got["p"].to_numpy(), exp)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(100, 30, 997)
    df = _frame(spark, vals.tolist())
    probs = [0.0, 0.025, 0.5, 0.8, 0.975, 1.0]
    row = exact_quantiles(df, "v", probs, [f"q{i}" for i in range(len(probs))], rows_per_bucket=10).first()
    for i, p in enumerate(probs):
        assert abs(row[f"q{i}"] - np.quantile(vals, p)) < 1e-9


def test_quantile_of_two_values(spark):
    df = _frame(spark, [130.0, 190.0])
    assert exact_quantiles(df, "v", [0.8], ["t"]).first()["t"] == 178.0


def test_multi_column_ranks_match_pandas(spark):
    rng = np.random.default_rng(11)
    a = np.concatenate([rng.integers(0, 30, 300), np.full(200, 4)]).astype(float)
    b = rng.normal(0, 1, 500).round(2)
    pdf = pd.DataFrame({"id": np.arange(500), "a": a, "b": b})
    df = spark.createDataFrame(pdf)
    from orderpulse.operators.ranks import avg_rank_pcts
    got = avg_rank_pcts(df, {"a": "pa", "b": "pb"}, rows_per_bucket=7).toPandas().sort_values("id")
    assert np.allclose(got["pa"].to_numpy(), pdf["a"].rank(pct=True).to_numpy())
    assert np.allclose(got["pb"].to_numpy(), pdf["b"].rank(pct=True).to_numpy())


def test_positions_over_many_partitions(spark):
    from orderpulse.operators.ranks import numbered_in_order
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "pmod(id * 7919, 1000) AS v", "if(id % 11 = 0, NULL, id % 3) AS w")
    out = numbered_in_order(df, [F.desc_nulls_last("w"), F.asc("v"), F.asc("id")])
    got = [r["id"] for r in out.orderBy("rank").collect()]
    rows = sorted(df.collect(), key=lambda r: (r["w"] is None, -(r["w"] or 0), r["v"], r["id"]))
    assert got == [r["id"] for r in rows]
    assert out.selectExpr("min(rank)", "max(rank)", "count(distinct rank)").first() == (1, 5000, 5000)
    assert numbered_in_order(df.where("false"), [F.asc("id")]).count() == 0
