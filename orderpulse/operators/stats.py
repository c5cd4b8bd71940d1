"""Statistics per key (A23-A27, W04, W05, W10) as grouped aggregates.

Inputs are rows with a key and a value, or with ``gap`` and, from
``gaps.weighted_gaps``, the ``weight`` of rows that have it. Aggregates combine
map-side, so a hot key costs no more than any other; the only per-row results
(outlier flags) re-attach key statistics by an equi-join that AQE's skew handling
can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.operators.ordered import first_n


def number(value: Column) -> Column:
    """Value as a double; anything that is not a number, NaN included, is null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def _weight(g: DataFrame) -> Column:
    """Rows that a row of ``g`` stands for."""
    return F.col("weight") if "weight" in g.columns else F.lit(1).cast("long")


def share_within(window_days: int, weight: Column) -> Column:
    """Aggregate: share of gaps <= ``window_days``, half-even to 4 places; no gap -> 0.0."""
    w = F.when(F.col("gap").isNotNull(), weight)
    inside = F.sum(F.when(F.col("gap") <= window_days, weight).when(F.col("gap").isNotNull(), 0))
    return F.coalesce(F.bround(inside / F.nullif(F.sum(w), F.lit(0)), 4), F.lit(0.0))


def repurchase_probability(g: DataFrame, keys: Sequence[str], window_days: int = 90,
                           name: str = "prob_recompra") -> DataFrame:
    """Share of gaps <= ``window_days``, half-even to 4 places; no gap -> 0.0."""
    return g.groupBy(*keys).agg(share_within(window_days, _weight(g)).alias(name))


def turnover_interval(g: DataFrame, keys: Sequence[str], confidence: float = 0.95,
                      names=("ic_low", "ic_high")) -> DataFrame:
    """Linear percentiles alpha/2 and 1-alpha/2 of the gaps; none -> (0, 0)."""
    alpha = 1 - confidence
    p = F.percentile(F.col("gap").cast("double"), [alpha / 2, 1 - alpha / 2], _weight(g))
    return g.groupBy(*keys).agg(p.alias("_p")).select(
        *keys, F.coalesce(F.col("_p")[0], F.lit(0.0)).alias(names[0]),
        F.coalesce(F.col("_p")[1], F.lit(0.0)).alias(names[1]))


def cv(value: Column) -> Column:
    """Coefficient of variation as an aggregate: sigma_pop / mean; empty or mean 0 -> 0."""
    value = number(value)
    mean = F.avg(value)
    return F.coalesce(F.when(mean != 0, F.stddev_pop(value) / mean), F.lit(0.0))


def survival(flag: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Beta-posterior survival (successes + a) / (n + a + b), half-even 4 places;
    no events -> 0 (A26). ``flag`` is boolean; nulls are not events (A27)."""
    n = F.count(flag)
    s = F.sum(F.when(flag, 1).otherwise(0))
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.bround((s + F.lit(alpha)) / (n + F.lit(alpha + beta)), 4))


def key_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: ``_n``, ``_mean``, population ``_sd`` of ``value`` (nulls and NaN dropped)."""
    v = number(F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"),
                                 F.stddev_pop(v).alias("_sd"))


def volume_outliers(df: DataFrame, keys: Sequence[str], value: str = "qty",
                    z_limit: float = 3.0) -> DataFrame:
    """Rows with ``|value - mean| / sigma_pop > z_limit`` within their key (W04);
    sigma 0 flags nothing. Adds ``zscore``, ``key_mean``, ``key_n``."""
    m = key_moments(df, keys, value)
    j = df.join(m, on=list(keys), how="inner")
    z = (number(F.col(value)) - F.col("_mean")) / F.when(F.col("_sd") != 0, F.col("_sd"))
    return (j.where((F.col("_sd") > 0) & (F.abs(z) > z_limit))
            .select(*df.columns, z.alias("zscore"), F.col("_mean").alias("key_mean"),
                    F.col("_n").alias("key_n")))


def outlier_keys(df: DataFrame, keys: Sequence[str], value: str = "qty", z_limit: float = 3.0,
                 min_rows: int = 1) -> DataFrame:
    """Keys with at least ``min_rows`` values of which ``volume_outliers`` can flag a row: the least or the largest
    lies beyond ``z_limit`` sigma_pop. The limit is taken 1e-9 lower, as the order of summation moves the last digits."""
    v = number(F.col(value))
    m = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"),
                              F.min(v).alias("_min"), F.max(v).alias("_max"))
    z = F.greatest(F.col("_max") - F.col("_mean"), F.col("_mean") - F.col("_min")) / F.when(F.col("_sd") != 0, F.col("_sd"))
    return m.where((F.col("_n") >= min_rows) & (F.col("_sd") > 0) & (z > z_limit * (1 - 1e-9))).select(*keys)


def last_rows(df: DataFrame, keys: Sequence[str], n: int, ts: str = "date",
              tie: str = "ingest_seq") -> DataFrame:
    """Last ``n`` rows per key by (ts, tie), ``_rank`` 1 = latest."""
    order = [F.col(ts).desc(), F.col(tie).desc()]
    return first_n(df, keys, order, n)
