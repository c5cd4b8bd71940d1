"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source gets the same expected number of copies, target words /
source words (at most ``cap``). Its whole part is certain; the fraction is
rounded so that the source's words stay on target: rows are paired, and mass in
words moves from one to the other at random until one fraction is 0 or 1, with
chances that leave each row's expectation unchanged. The other carries the
residual on. Pairs are folded inside bounded leaf groups; the residuals of the
leaves meet in the next level's groups, and so on: a reduction tree whose depth
is the logarithm of the largest source, so a source holding any share of the
rows is spread over many groups. Units are folded largest first, so that what is left
is mostly small. Only the last residual of a source is rounded alone, so a source misses
its target by less than the size of that row, and never by more than its largest row.

Random numbers are hashes of the seed and the rows' keys: reruns agree.

Defined results: null text has size 0; rows of size 0 and sources without words
take 0 words (one copy of a size-0 row stays); the null source comes last;
repeated rows are told apart by a running number, each rounded by itself; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import WORD, written

LEAF = 48  # expected rows of a leaf group


def sizes(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``(source, source_size, rows, target)`` from ``(source, source_size, rows)``.

    Sources by code point (null last) weigh ``weights`` in turn and share
    ``share`` times all words; no target exceeds ``cap`` times its source's
    words, and what is above is shared anew by weight. The fixed point gives
    every source ``min(cap * size, level * weight)``; the level is found in the
    order in which sources reach their cap. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = (sources.withColumn("place", F.row_number().over(by_name))
         .withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                F.pmod(F.col("place") - 1, F.lit(len(weights)))))
         .withColumn("ratio", cap * F.col("source_size") / F.col("w"))
         .withColumn("budget", share * F.sum("source_size").over(everything))
         .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap * F.col("source_size")).over(by_cap), F.lit(0.0)))
                     / F.sum("w").over(rest))
         # the first source that stays below its cap sets the level; all later ones stay below too
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level")))
                     .over(everything)["level"])
         .withColumn("target", F.least(cap * F.col("source_size"),
                                       F.coalesce(F.col("level") * F.col("w"), cap * F.col("source_size")))))
    return s.select("source", "source_size", "rows", "target")


def _uniform(*cols: Column) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) + 0.5) / float(1 << 53)


_UNIT = "struct<doc_id:bigint,h:bigint,k:bigint,size:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,h:bigint,k:bigint,size:bigint,up:int>>"


def _round(unit: Column, up: Column) -> Column:
    return F.struct(unit["doc_id"].alias("doc_id"), unit["h"].alias("h"), unit["k"].alias("k"),
                    unit["size"].alias("size"), up.cast("int").alias("up"))


def _fold(units: Column, seed: int) -> Column:
    """Sequential pivotal rounding of one group: the decided units and the residual unit."""
    def with_p(unit, p):
        return F.struct(unit["doc_id"].alias("doc_id"), unit["h"].alias("h"), unit["k"].alias("k"),
                        unit["size"].alias("size"), p.alias("p"))

    def step(acc, x):
        a = acc["rest"]
        wa, wb = a["size"].cast("double"), x["size"].cast("double")
        # words that can move from x to a, and from a to x, before one fraction is 0 or 1
        gain = F.least(wa * (1 - a["p"]), wb * x["p"])
        loss = F.least(wa * a["p"], wb * (1 - x["p"]))
        u = _uniform(F.lit(seed), a["doc_id"], a["h"], a["k"], x["doc_id"], x["h"], x["k"])
        # the direction is what was drawn: nothing may be left to move that way
        up = u * (gain + loss) < loss
        move = F.when(up, gain).otherwise(-loss)
        pa, pb = a["p"] + move / wa, x["p"] - move / wb
        # which of the two became integral is decided by the bound that was met, not by rounding
        a_done = F.when(up, wa * (1 - a["p"]) <= wb * x["p"]).otherwise(wa * a["p"] <= wb * (1 - x["p"]))
        settled = F.when(a_done, _round(a, up)).otherwise(_round(x, ~up))
        rest = F.when(a_done, with_p(x, F.greatest(F.lit(0.0), F.least(F.lit(1.0), pb)))).otherwise(
            with_p(a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), pa))))
        return F.struct(F.when(a.isNull(), acc["done"])
                        .otherwise(F.concat(acc["done"], F.array(settled))).alias("done"),
                        F.when(a.isNull(), x).otherwise(rest).alias("rest"))

    start = F.struct(F.lit(None).cast(_DONE).alias("done"), F.lit(None).cast(_UNIT).alias("rest"))
    start = F.struct(F.array().cast(_DONE).alias("done"), start["rest"].alias("rest"))
    return F.aggregate(units, start, step)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        seed: int = 17) -> DataFrame:
    """``(doc_id, h, k, source, size, source_size, target, copies, taken)``: one row per row of ``docs``.

    ``h`` is a hash of the text and ``k`` the running number among equal
    ``(doc_id, source, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       sizes().alias("size"), F.xxhash64("text").alias("h"))
    # equal rows are counted first and numbered after the count: no group of copies meets in one task
    rows = rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("many"))
    # numbered in blocks, so no array grows with the copies of a row
    block, one = F.lit(1 << 16), F.lit(1).cast("long")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / block))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("_b") * block + one, F.least((F.col("_b") + 1) * block, F.col("many")))))
    rows = written(rows.drop("many", "_b"), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = written(source_targets(per_source, weights, share, cap), "targets")
    biggest = targets.agg(F.max("rows")).first()[0] or 0

    t = targets.select("source", "source_size", "rows", "target")
    rows = (rows.join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                        .otherwise(F.lit(0.0)))
            .withColumn("whole", F.floor("rate").cast("int"))
            .withColumn("p", F.col("rate") - F.floor("rate")))
    rows = written(rows, "rates")

    unit = F.struct("doc_id", "h", "k", "size", "p").alias("unit")
    level = (rows.where("size > 0 and p > 0").select("source", "rows", unit))
    decided = None
    for depth in range(max(1, math.ceil(math.log(max(biggest, 2), LEAF)) + 1)):
        # a leaf group gets about LEAF units of one source; its number follows from the source's rows
        groups = F.greatest(F.lit(1.0), F.ceil(F.col("rows") / float(LEAF ** (depth + 1)))).cast("long")
        key = F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), "unit.doc_id", "unit.h", "unit.k"), groups)
        folded = (level.withColumn("leaf", key).groupBy("source", "rows", "leaf")
                  .agg(F.array_sort(F.collect_list(F.struct((-F.col("unit.size")).alias("o"), "unit"))).alias("units"))
                  .select("source", "rows", _fold(F.col("units")["unit"], seed + depth).alias("f")))
        folded = written(folded, f"level{depth}")
        done = folded.select(F.explode("f.done").alias("d")).select("d.*")
        decided = done if decided is None else decided.unionByName(done)
        level = folded.select("source", "rows", F.col("f.rest").alias("unit"))
    last = level.select("unit.*").withColumn(
        "up", (_uniform(F.lit(seed), F.lit(-1), "doc_id", "h", "k") < F.col("p")).cast("int"))
    decided = decided.unionByName(last.select(*decided.columns))
    d = decided.select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), F.col("k").alias("d_k"), "up",
                       F.col("size").alias("d_size"))
    out = rows.join(d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("h") == F.col("d_h"))
                    & (F.col("k") == F.col("d_k")) & (F.col("size") == F.col("d_size")), "left")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.coalesce("up", F.lit(0)))
    return (out.withColumn("copies", copies)
            .select("doc_id", "h", "k", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def take(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0, 1 or 2 times); same columns."""
    picks = (mix(docs, **options).groupBy("doc_id", "source", "h")
             .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")))
    p = picks.select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("h").alias("__h"),
                     "__copies", "__rows")
    j = docs.withColumn("__x", F.xxhash64("text")).join(
        p, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s"))
        & (F.col("__x") == F.col("__h")))
    # equal rows share their copies evenly; which of them takes one more is of no account
    order = Window.partitionBy("doc_id", "source", "__x").orderBy(F.lit(0))
    single = j.where("__rows = 1").withColumn("__n", F.col("__copies").cast("int"))
    several = j.where("__rows > 1").withColumn("__i", F.row_number().over(order) - 1)
    base = F.floor(F.col("__copies") / F.col("__rows"))
    several = several.withColumn("__n", (base + F.when(F.col("__i") < F.col("__copies") % F.col("__rows"), 1)
                                         .otherwise(0)).cast("int")).drop("__i")
    both = single.unionByName(several).where("__n > 0")
    return both.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
