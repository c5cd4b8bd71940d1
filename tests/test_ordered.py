"""Skew-safe ordered operators against a brute-force pandas computation, with a
hot key spread over many day buckets."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orderpulse.operators.gaps import gap_cv, gaps, mean_gap, median_gap, rows_with_gap, weighted_gaps
from orderpulse.operators.ordered import first_n, forward_fill, with_previous


def _events(spark, seed=1):
    rng = np.random.default_rng(seed)
    n = 3000
    keys = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c", "d"], n))
    secs = rng.integers(0, 90 * 86400, n)
    pdf = pd.DataFrame({"k": keys, "date": pd.Timestamp("2024-01-01") + pd.to_timedelta(secs, unit="s"),
                        "ingest_seq": np.arange(n), "v": rng.integers(0, 100, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz"))


import pytest


@pytest.mark.parametrize("split_rows", [100, 10**9])
def test_with_previous_matches_shift(spark, split_rows):
    pdf, df = _events(spark)
    got = with_previous(df, ["k"], ["date", "ingest_seq"], ["v"], split_rows=split_rows) \
        .toPandas().set_index("ingest_seq")["prev_v"]
    exp = pdf.sort_values(["k", "date", "ingest_seq"]).groupby("k")["v"].shift(1)
    exp.index = pdf.sort_values(["k", "date", "ingest_seq"])["ingest_seq"]
    pd.testing.assert_series_equal(got.sort_index(), exp.sort_index(), check_names=False)


def test_gaps_floor_days(spark):
    pdf, df = _events(spark, 2)
    got = gaps(df, ["k"]).toPandas().set_index("ingest_seq")["gap"].sort_index()
    s = pdf.sort_values(["k", "date", "ingest_seq"])
    exp = s.groupby("k")["date"].diff().dt.days
    exp.index = s["ingest_seq"]
    assert (got.fillna(-1).astype(int) == exp.sort_index().fillna(-1).astype(int)).all()


def test_first_n_matches_head(spark):
    pdf, df = _events(spark, 3)
    top = first_n(df, ["k"], [F.col("date").desc(), F.col("ingest_seq").desc()], 6)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()  # limited before the shuffle
    got = top.toPandas()
    exp = pdf.sort_values(["date", "ingest_seq"], ascending=False).groupby("k").head(6)
    assert sorted(got["ingest_seq"]) == sorted(exp["ingest_seq"])


@pytest.mark.parametrize("split_rows", [10, 10**9, None])
def test_forward_fill_across_buckets(spark, split_rows):
    rows = [("f", i, f"P{i}" if i % 37 == 0 else None) for i in range(1, 400)]
    rows += [("g", i, "Q" if i == 5 else None) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "file string, row_idx long, hdr string")
    got = forward_fill(df, ["file"], "row_idx", ["hdr"], F.shiftright("row_idx", 3),
                       split_rows=split_rows).where("file = 'f'").toPandas()
    pdf = pd.DataFrame(rows, columns=["file", "row_idx", "hdr"])
    pdf = pdf[pdf["file"] == "f"].sort_values("row_idx")
    exp = pdf["hdr"].ffill()
    got = got.sort_values("row_idx")["hdr"].reset_index(drop=True)
    assert got.fillna("-").tolist() == exp.fillna("-").tolist()


def _tied_events(spark):
    """Keys with ties in time and in (time, tie), a null key, null times and one day holding most rows."""
    rng = np.random.default_rng(4)
    rows = [("hot", f"2024-03-05 {h:02d}:{m:02d}:00", i) for i, (h, m) in enumerate(rng.integers(0, [[24, 60]] * 800))]
    rows += [(str(k), f"2024-0{m}-{d:02d} {h:02d}:30:00", int(s)) for k, m, d, h, s in
             zip(rng.choice(["a", "b", "hot"], 200), rng.integers(1, 7, 200), rng.integers(1, 28, 200),
                 rng.integers(0, 24, 200), rng.integers(0, 40, 200))]
    rows += [("dup", "2024-01-01 10:00:00", 1)] * 3 + [("dup", "2024-01-04 09:00:00", 2)] * 2 + [("one", "2024-01-01 00:00:00", 1)]
    rows += [("nul", None, 1), ("nul", None, 2), ("nul", "2024-02-01 00:00:00", 3), (None, "2024-01-01 00:00:00", 5),
             (None, "2024-01-03 00:00:00", 6)]
    pdf = pd.DataFrame(rows, columns=["k", "date", "ingest_seq"])
    pdf["date"] = pd.to_datetime(pdf["date"])
    df = spark.createDataFrame(rows, "k string, date string, ingest_seq long").withColumn("date", F.col("date").cast("timestamp_ntz"))
    return pdf, df


def test_gaps_with_ties_and_nulls(spark):
    pdf, df = _tied_events(spark)
    s = pdf.sort_values(["k", "date", "ingest_seq"], na_position="first")
    s["gap"] = s.groupby("k", dropna=False)["date"].diff().dt.days

    def rows(frame):
        return [(str(k), str(d), int(i), None if pd.isna(g) else int(g)) for k, d, i, g in frame.itertuples(index=False)]
    got = gaps(df, ["k"]).select("k", F.col("date").cast("string"), "ingest_seq", "gap").toPandas()
    s["date"] = s["date"].dt.strftime("%Y-%m-%d %H:%M:%S")
    key = lambda t: (t[0], t[1], t[2], -1 if t[3] is None else t[3])
    want = sorted(rows(s[["k", "date", "ingest_seq", "gap"]].replace({np.nan: None})), key=key)
    assert sorted(rows(got), key=key) == want


def test_weighted_gaps_equal_row_gaps(spark):
    """Counts, medians, means and variation from weights equal those over the rows."""
    pdf, df = _tied_events(spark)
    for distinct in (False, True):
        p = pdf.drop_duplicates(["k", "date"]) if distinct else pdf
        s = p.sort_values(["k", "date", "ingest_seq"], na_position="first")
        s["gap"] = s.groupby("k", dropna=False)["date"].diff().dt.days
        want = s.groupby("k", dropna=False)["gap"].agg(["size", "count", "median", "mean", lambda x: x.std(ddof=0)])
        got = weighted_gaps(df, ["k"], distinct=distinct).groupBy("k").agg(
            F.sum("weight").alias("n"), rows_with_gap().alias("c"), median_gap().alias("m"), mean_gap().alias("a"),
            gap_cv().alias("cv"), F.max("last_ts").alias("last")).collect()
        assert len(got) == len(want)
        for r in got:
            size, count, median, mean, sd = want.loc[[r.k if r.k is not None else np.nan]].iloc[0]
            assert (r.n, r.c) == (size, count)
            if count:
                assert r.m == median and abs(r.a - mean) < 1e-12 and abs(r.cv - (sd / mean if mean else 0)) < 1e-12
            else:
                assert r.m is None and r.a is None and r.cv == 0.0
            last = pdf[pdf.k.isna() if r.k is None else pdf.k == r.k].date.max()
            assert r["last"] == last


def test_weighted_gaps_order_nothing_but_days(spark):
    """The one window sorts the day table; no job runs before the query itself."""
    _, df = _tied_events(spark)
    plan = weighted_gaps(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "partial_count" in plan
