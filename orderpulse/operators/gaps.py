"""Gaps between consecutive purchases as weighted values.

Two purchases on one calendar day are less than a day apart, so their floor-day gap
is 0 whatever their order. A key's rows therefore reduce, by one map-side-combined
aggregate, to one row per (key, day): the number of rows and the first and last
timestamp. One lag over a key's days gives the gap into each day; the other rows of
the day are zero gaps. The result ``(key, gap, weight)`` says "``weight`` rows have
this gap"; medians, percentiles and moments take the weights as frequencies.

No job counts rows per key and nothing is ordered but the days of a key (their number
is bounded by the calendar), so a key, or one day of a key, may hold any share of the
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.dates import floor_days


def purchase_days(df: DataFrame, keys: Sequence[str], ts: str = "date", distinct: bool = False) -> DataFrame:
    """One row per (key, calendar day): ``day, n, first_ts, last_ts``. ``distinct`` counts each
    timestamp of a key once."""
    keys = list(keys)
    if distinct:
        df = df.select(*keys, ts).distinct()
    return df.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def _into_day(keys: Sequence[str]) -> Column:
    """Gap from the last row of a key's previous day to the first of this one; null on its first day."""
    w = Window.partitionBy(*keys).orderBy("day")
    return floor_days(F.col("first_ts"), F.lag("last_ts").over(w))


def weighted_gaps(df: DataFrame, keys: Sequence[str], ts: str = "date", distinct: bool = False) -> DataFrame:
    """``keys, gap, weight, last_ts``: ``weight`` rows of a key have ``gap``. A key's first row and
    rows without a timestamp have a null gap; ``last_ts`` is the latest timestamp of the rows' day."""
    keys = list(keys)
    days = purchase_days(df, keys, ts, distinct).withColumn("_into", _into_day(keys))
    same = F.when(F.col("day").isNotNull(), F.lit(0).cast("long"))
    pair = F.array(F.struct(F.col("_into").cast("long").alias("gap"), F.lit(1).cast("long").alias("weight")),
                   F.struct(same.alias("gap"), (F.col("n") - 1).alias("weight")))
    return days.select(*keys, "last_ts", F.inline(pair)).where("weight > 0").select(*keys, "gap", "weight", "last_ts")


def gaps(df: DataFrame, keys: Sequence[str], ts: str = "date", tie: str = "ingest_seq") -> DataFrame:
    """The input rows plus ``gap`` = floor days since the key's previous row by (ts, tie); null
    on a key's first row.

    Only a day's first row can have a gap other than 0; the day table names it by (ts, tie) and the
    gap is joined to that row. The join key is nearly unique, so no key gathers in one task."""
    keys = list(keys)
    days = df.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(
        F.min(F.struct(F.col(ts).alias("t"), F.col(tie).alias("s"))).alias("_first"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    days = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_first.t").alias("_t"),
                       F.col("_first.s").alias("_s"), _into_day(keys).alias("_into"), F.lit(True).alias("_starts"))
    # rows equal in key, time and tie cannot be told apart: one of them starts the day
    one = Window.partitionBy(*keys, ts, tie).orderBy(F.lit(0))
    rows = df.withColumn("_copy", F.row_number().over(one))
    on = F.col("_copy") == 1
    for left, right in [*[(k, f"_k{i}") for i, k in enumerate(keys)], (ts, "_t"), (tie, "_s")]:
        on = on & rows[left].eqNullSafe(days[right])
    gap = F.when(F.col("_starts"), F.col("_into")).when(F.col(ts).isNotNull(), F.lit(0).cast("long"))
    return rows.join(days, on, "left").select(*[rows[c] for c in df.columns], gap.alias("gap"))


def rows_with_gap() -> Column:
    """Aggregate: number of rows that have a gap."""
    return F.coalesce(F.sum(F.when(F.col("gap").isNotNull(), F.col("weight"))), F.lit(0))


def median_gap() -> Column:
    """Aggregate: median over the rows (null without gaps)."""
    return F.percentile(F.col("gap"), 0.5, F.col("weight"))


def mean_gap() -> Column:
    """Aggregate: mean over the rows (null without gaps)."""
    return F.sum(F.col("gap") * F.col("weight")) / F.nullif(rows_with_gap(), F.lit(0))


def gap_cv() -> Column:
    """Aggregate: sigma_pop / mean over the rows; no gap or mean 0 -> 0 (A25). The sums are whole numbers (squares
    exact below 2**53) and their difference is taken in decimals, so nothing cancels."""
    n = rows_with_gap().cast("decimal(18,0)")
    s1 = F.sum(F.col("gap") * F.col("weight")).cast("decimal(19,0)")
    s2 = F.sum((F.col("gap") * F.col("gap")).cast("double") * F.col("weight")).cast("decimal(24,0)")
    spread = F.sqrt((n * s2 - s1 * s1).cast("double"))
    return F.coalesce(F.when(s1 != 0, spread / s1.cast("double")), F.lit(0.0))
