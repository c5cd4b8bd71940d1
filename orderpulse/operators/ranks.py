"""Global ranks and exact quantiles without a single-task window.

``Window.orderBy(v)`` with no partition runs in one task. Instead the values are
first reduced to their distinct values with counts (map-side combined, so a
value shared by a third of all rows is one row), then bucketed by sampled
quantile boundaries, ranked inside each bucket, and offset by a prefix sum over
the bucket totals. The bucket table has at most ``MAX_BUCKETS`` rows, which is
what makes broadcasting it safe.

Each call runs two small jobs (distinct count, quantile sample) on the distinct
values; the returned plan is lazy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.session import stored_once
from orderpulse.sources.tables import bounded_broadcast

MAX_BUCKETS = 512
MAX_SORT_PARTITIONS = 1_000_000
ROWS_PER_BUCKET = 2_000_000


def _bucket_expr(v: Column, bounds: list[float], lo: int, hi: int) -> Column:
    """Number of ``bounds`` <= v, as a balanced ``when`` tree of depth log2(len)."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v < F.lit(bounds[mid]), _bucket_expr(v, bounds, lo, mid)) \
        .otherwise(_bucket_expr(v, bounds, mid + 1, hi))


def value_ranks(df: DataFrame, col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Distinct non-null values of ``col`` with ``c`` (count), ``below`` (rows with
    a smaller value) and ``n`` (all non-null rows)."""
    vals = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v"))
            .agg(F.count(F.lit(1)).alias("c"))).persist(StorageLevel.MEMORY_AND_DISK)
    row = vals.agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).first()
    k, n = int(row["k"] or 0), int(row["n"] or 0)
    nb = max(1, min(MAX_BUCKETS, math.ceil(k / rows_per_bucket)))
    if nb > 1:
        probs = [i / nb for i in range(1, nb)]
        bounds = sorted(set(vals.select(F.col("v").cast("double").alias("v"))
                            .approxQuantile("v", probs, 1.0 / (4 * nb))))
        bucket = _bucket_expr(F.col("v"), bounds, 0, len(bounds))
    else:
        bucket = F.lit(0)
    vb = vals.withColumn("_bkt", bucket)
    totals = vb.groupBy("_bkt").agg(F.sum("c").alias("_bc"))
    # at most MAX_BUCKETS rows: a single-partition window here is fine
    offs = totals.select("_bkt", F.coalesce(
        F.sum("_bc").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy("_bkt").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    within = vb.withColumn("_in", F.coalesce(F.sum("c").over(w), F.lit(0)))
    return (within.join(F.broadcast(offs), "_bkt")
            .select("v", "c", (F.col("_off") + F.col("_in")).alias("below"),
                    F.lit(n).cast("long").alias("n")))


def numbered_in_order(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` = position (from 1) of every row in ``order``, as a stored table in that order.

    A global sort range-partitions the rows; each is written with its partition and place in it,
    then a prefix sum over the partitions' row counts (one row each) turns places into positions.
    ``order`` should be total: rows equal in it are numbered in any order."""
    placed = stored_once(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per sorted partition: a single-partition window over them is small
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(bounded_broadcast(before, MAX_SORT_PARTITIONS), "_part").select(
        *df.columns, (F.col("_before") + place + 1).alias(name))


def avg_rank_pct(df: DataFrame, col: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out`` = average rank of ``col`` divided by the non-null count
    (pandas ``rank(pct=True, method="average")``, W03). Null values get null."""
    r = value_ranks(df, col, rows_per_bucket).select(
        F.col("v").alias(col),
        ((F.col("below") + (F.col("c") + 1) / 2.0) / F.col("n")).alias(out))
    return df.join(r, on=col, how="left")


def exact_quantiles(df: DataFrame, col: str, probs: list[float], names: list[str],
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One-row DataFrame of exact linear-interpolation quantiles of ``col``
    (numpy/pandas default, DuckDB ``quantile_cont``). Empty input -> nulls."""
    r = value_ranks(df, col, rows_per_bucket)
    n = F.col("n")
    outs = []
    for p, name in zip(probs, names):
        pos = F.lit(p) * (n - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        v_lo = F.max(F.when((F.col("below") <= lo) & (lo < F.col("below") + F.col("c")), F.col("v")))
        v_hi = F.max(F.when((F.col("below") <= hi) & (hi < F.col("below") + F.col("c")), F.col("v")))
        frac = F.max(pos - lo)
        outs.append((v_lo.cast("double") + frac * (v_hi.cast("double") - v_lo.cast("double"))).alias(name))
    return r.agg(*outs)


def avg_rank_pcts(df: DataFrame, cols: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Several average-rank percentiles (W03) in one pass: the columns' distinct
    values are stacked with a metric tag, counted, bucketed per metric and
    ranked together (one eager job instead of one per column). ``cols`` maps
    input column -> output column. Values are compared as double."""
    names = list(cols)
    stacked = None
    for i, c in enumerate(names):
        part = df.where(F.col(c).isNotNull()).select(F.lit(i).alias("_m"), F.col(c).cast("double").alias("v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    vals = stacked.groupBy("_m", "v").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    stats = {r["_m"]: (int(r["k"]), int(r["n"])) for r in
             vals.groupBy("_m").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).collect()}
    bucket, n_col = None, None
    for i in range(len(names)):
        k, n = stats.get(i, (0, 0))
        nb = max(1, min(MAX_BUCKETS, math.ceil(k / rows_per_bucket)))
        if nb > 1:
            bounds = sorted(set(vals.where(F.col("_m") == i).select("v")
                                .approxQuantile("v", [j / nb for j in range(1, nb)], 1.0 / (4 * nb))))
            b = _bucket_expr(F.col("v"), bounds, 0, len(bounds))
        else:
            b = F.lit(0)
        bucket = F.when(F.col("_m") == i, b) if bucket is None else bucket.when(F.col("_m") == i, b)
        n_col = F.when(F.col("_m") == i, F.lit(n)) if n_col is None else n_col.when(F.col("_m") == i, F.lit(n))
    vb = vals.withColumn("_bkt", bucket)
    totals = vb.groupBy("_m", "_bkt").agg(F.sum("c").alias("_bc"))
    # at most (#columns x MAX_BUCKETS) rows: broadcast is bounded
    offs = totals.select("_m", "_bkt", F.coalesce(
        F.sum("_bc").over(Window.partitionBy("_m").orderBy("_bkt")
                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_m", "_bkt").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (vb.withColumn("_in", F.coalesce(F.sum("c").over(w), F.lit(0)))
              .join(F.broadcast(offs), ["_m", "_bkt"])
              .select("_m", F.col("v").alias("_v"),
                      ((F.col("_off") + F.col("_in") + (F.col("c") + 1) / 2.0) / n_col.cast("double"))
                      .alias("_pct")))
    out = df
    for i, c in enumerate(names):
        r = ranked.where(F.col("_m") == i).select(F.col("_v"), F.col("_pct").alias(cols[c]))
        out = out.join(r, out[c].cast("double") == r["_v"], "left").drop("_v")
    return out
