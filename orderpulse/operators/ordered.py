"""Per-key ordered operators that stay balanced when one key is huge.

A ``Window.partitionBy(key)`` puts every row of a key into one task; with one
client holding a third of all rows that task would sort a third of the data.

First a map-side-combined count finds the *hot* keys (more than
``SPLIT_ROWS`` rows). Keys below it are ordered by a plain per-key window: no
task holds more than ``SPLIT_ROWS`` rows of one key. Hot keys are split into
``(key, bucket)`` pieces, the bucket being a monotone function of the leading
order column (calendar day by default), so a hot key is spread over as many
tasks as it has days. What crosses a bucket boundary (the previous row, the last
non-null value) arrives as one "carry" row per bucket, computed from a
per-bucket summary whose size is the number of (hot key, bucket) pairs.

The hot-key list is broadcast only when it holds at most ``MAX_HOT_KEYS``
rows (checked); beyond that every key is split by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.dates import MICROS_PER_DAY

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

SPLIT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


def day_bucket(ts: Column) -> Column:
    """Days since the epoch (floored): monotone in ``ts``."""
    us = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts.cast("timestamp_ntz"))
    return ((us - F.pmod(us, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("long")


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _mark_hot(df: DataFrame, keys: list[str], split_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a boolean ``_hot`` column; ``False`` overall when no key is hot.

    Runs one job: a grouped count (combined map-side) filtered to hot keys."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_rows) \
        .select(*keys, F.lit(True).alias("_hot"))
    n_hot = hot.limit(MAX_HOT_KEYS + 1).count()
    if n_hot == 0:
        return df.withColumn("_hot", F.lit(False)), False
    if n_hot > MAX_HOT_KEYS:
        return df.withColumn("_hot", F.lit(True)), True
    # proven small (checked above): broadcast; null keys never match, as in a window
    return df.join(F.broadcast(hot), on=keys, how="left") \
        .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False))), True


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  carry: Sequence[str], bucket: Column | None = None,
                  prefix: str = "prev_", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the row just before, within ``keys`` in
    ``order`` (W01/W10). The first row of each key gets nulls.

    ``bucket`` must be non-decreasing in ``order`` (default: day of ``order[0]``).
    Hot keys: a map-side-combined aggregate gives each (key, bucket)'s last row;
    a window over that small table hands every bucket its predecessor's last row
    as one "carry" row, unioned in front of the bucket's rows. One ordered
    window per (key, bucket) then reads ``lag``: the fact rows are shuffled and
    sorted once and never joined.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    bucket = day_bucket(F.col(order[0])) if bucket is None else bucket
    marked, any_hot = _mark_hot(df, keys, split_rows)
    if not any_hot:
        w = Window.partitionBy(*keys).orderBy(*_cols(order))
        return df.select("*", *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in carry])
    b = marked.withColumn("_bkt", F.when(F.col("_hot"), bucket).otherwise(F.lit(0).cast("long"))) \
        .withColumn("_src", F.lit(1))
    last = (b.where(F.col("_hot")).groupBy(*keys, "_bkt")
            .agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last")))
    wk = Window.partitionBy(*keys).orderBy("_bkt")
    carry_rows = last.select(*keys, "_bkt", F.lag("_last").over(wk).alias("_pl")).select(
        *keys, "_bkt", *[F.col("_pl")[c].alias(c) for c in carry if c not in keys], F.lit(0).alias("_src"))
    u = b.unionByName(carry_rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bkt").orderBy("_src", *_cols(order))
    return u.select(*[F.col(c) for c in df.columns], "_src",
                    *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in carry]) \
        .where(F.col("_src") == 1).drop("_src")


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, fill: Sequence[str],
                 bucket: Column, split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """Replace nulls in ``fill`` by the last non-null value earlier in ``order``
    within ``keys`` (W02). ``bucket`` must be non-decreasing in ``order``.

    ``split_rows=None`` splits every key by bucket, for buckets whose size is bounded
    by construction (row numbers): no job counts rows per key.

    Same shape as ``with_previous``: for hot keys, per-bucket last non-null
    values (small) are carried over buckets and unioned in as one leading row
    per bucket; one window."""
    keys, fill = list(keys), list(fill)
    if split_rows is None:
        marked, any_hot = df.withColumn("_hot", F.lit(True)), True
    else:
        marked, any_hot = _mark_hot(df, keys, split_rows)
    if not any_hot:
        w = (Window.partitionBy(*keys).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in fill else F.col(c)
                           for c in df.columns])
    b = marked.withColumn("_bkt", F.when(F.col("_hot"), bucket).otherwise(F.lit(0).cast("long"))) \
        .withColumn("_src", F.lit(1))
    summary = b.where(F.col("_hot")).groupBy(*keys, "_bkt").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_lastv_{c}")
          for c in fill])
    wk = (Window.partitionBy(*keys).orderBy("_bkt")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry_rows = summary.select(*keys, "_bkt", *[
        F.last(f"_lastv_{c}", ignorenulls=True).over(wk).alias(c) for c in fill], F.lit(0).alias("_src"))
    u = b.unionByName(carry_rows, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, "_bkt").orderBy("_src", order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return u.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in fill else F.col(c)
                      for c in df.columns], "_src").where(F.col("_src") == 1).drop("_src")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Rows ranked ``<= n`` per key by ``order`` (W05), with ``_rank`` added.

    A rank limited to ``n`` (at most 1,000, the planner's bound) keeps ``n`` rows per key in every
    input split before the shuffle, so a key never gathers more than ``n`` rows per split."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
