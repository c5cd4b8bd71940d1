"""Approximate nearest neighbours by multi-index hashing.

Vectors get learned binary codes: a rotation is fitted by iterative quantisation
on a bounded sample (``SAMPLE`` rows), the sign of each rotated component is one
bit. A code is split into substrings, each indexed by its value. By the
pigeonhole principle every code within Hamming radius R of the query agrees with
it in some substring up to floor(R / substrings) bits, so probing those values
in every table retrieves every such code; candidates outside the radius are
dropped and the rest is reranked on the original vectors in double precision.

R is the smallest radius that holds ``TARGET`` of the true neighbours inside the
sample; in the whole table neighbours are only nearer, so the recall there is at
least about as high. Every row is indexed; a query that finds fewer than k codes
widens its radius. The search is for the largest inner product: vectors get one
more component that makes their norms equal, which keeps the order.

Index shards of about ``SHARD`` rows meet query blocks of about ``BLOCK``: every
group has a bounded size, and copies spread over all shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; vectors of different lengths
are searched apart; rows that share an id are candidates of each other only as
far as their ids differ; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import written
from orderpulse.llm.vectors import ROWS, best, blocked, matrix, merge, usable_vectors

BITS = 64
SUBSTRINGS = 8
SAMPLE = 8000
SHARD = 16_384
BLOCK = 1024
TARGET = 0.97
_FOUND = "query_id long, vec_id long, score double"


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component that gives all vectors the norm ``longest``."""
    more = np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(axis=1)))
    return np.column_stack((x, more))


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """Projection to ``bits`` components: principal axes, rotated by iterative quantisation.

    With fewer axes than bits, further independent rotations of the same axes fill up."""
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    parts, left = [], bits
    while left > 0:
        n = min(left, x.shape[1])
        z = x @ axes[:, :n]
        r = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ vt).T
        parts.append(axes[:, :n] @ r)
        left -= n
    return np.column_stack(parts)


def encode(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as rows of ``SUBSTRINGS`` bytes."""
    return np.packbits(x @ projection > 0, axis=1)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64).ravel() ^ code.view(np.uint64)[0])


def needed_radius(plain: np.ndarray, codes: np.ndarray, projection: np.ndarray, k: int, target: float) -> int:
    """Smallest radius that holds ``target`` of the k nearest, over up to 256 rows as queries."""
    asked = encode(np.column_stack((plain[:256], np.zeros(len(plain[:256])))), projection)
    far = []
    for i in range(len(asked)):
        score = plain @ plain[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(score) - 1))[:k]
        far.append(hamming(codes[near], asked[i]))
    far = np.sort(np.concatenate(far)) if far else np.array([BITS])
    return int(far[min(len(far) - 1, int(np.ceil(target * len(far))))])


class SubstringIndex:
    """One table per substring: row positions ordered by the substring's value."""

    #: All byte masks ordered by their number of bits, and how many have at most r bits.
    MASKS = np.array(sorted(range(256), key=lambda m: (m.bit_count(), m)), np.uint8)
    WITHIN = [sum(m.bit_count() <= r for m in range(256)) for r in range(9)]

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.at = [np.searchsorted(codes[o, j], np.arange(257)).tolist() for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of every code within the radius."""
        probes = self.WITHIN[min(8, radius // len(self.order))]
        hit = np.zeros(len(self.codes), bool)
        for j, (order, at) in enumerate(zip(self.order, self.at, strict=True)):
            for value in (self.MASKS[:probes] ^ code[j]).tolist():
                hit[order[at[value]:at[value + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], code) <= radius]


def _search(projection: np.ndarray, longest: float, radius: int, k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if index.num_rows and queries.num_rows:
            x, ids = matrix(index, np.float64), index.column("vec_id").to_numpy()
            table = SubstringIndex(encode(augment(x, longest), projection))
            q = matrix(queries, np.float64)
            codes = encode(np.column_stack((q, np.zeros(len(q)))), projection)
            for i, query_id in enumerate(queries.column("vec_id").to_pylist()):
                r = radius
                rows = table.within(codes[i], r)
                rows = rows[ids[rows] != query_id]
                while len(rows) < k and r < BITS:
                    r = min(BITS, r + SUBSTRINGS)
                    rows = table.within(codes[i], r)
                    rows = rows[ids[rows] != query_id]
                if not len(rows):
                    continue
                rough = x[rows] @ q[i]
                if len(rows) > k:  # the last digits are settled on the finalists
                    kth = np.partition(rough, len(rough) - k)[len(rough) - k]
                    rows = rows[rough >= kth - 1e-9 * max(1.0, abs(kth))]
                score = (x[rows] * q[i]).sum(axis=1)
                top = best(score, ids[rows], k)
                out_q += [query_id] * len(top)
                out_v += ids[rows[top]].tolist()
                out_s += score[top].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_s, pa.float64())})
    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, target: float = TARGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``vectors(vec_id, embedding)`` whose id is
    divisible by ``every``, each against all other rows."""
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                  F.col("embedding").cast("array<double>").alias("embedding"))
                   .mapInArrow(usable_vectors(False), ROWS), "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, n in sorted(rows.groupBy("dim").count().collect()):
        own = rows.where(F.col("dim") == dim)
        sample = matrix(own.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow(), np.float64)
        longest = float(own.mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0])
        full = augment(sample, longest)
        projection = learn_rotation(full)
        radius = needed_radius(sample, encode(full, projection), projection, k, target)
        shards, blocks = -(-n // SHARD), max(1, -(-n // every // BLOCK))
        index = own.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
        queries = own.where(F.col("vec_id") % every == 0)
        index, queries = blocked(index, queries, shards, blocks)
        found = (index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block"))
                 .applyInArrow(_search(projection, longest, radius, k), _FOUND))
        out = out.unionByName(merge(found, k))
    return out


def _norms(batches):
    for batch in batches:
        if batch.num_rows:
            x = matrix(pa.Table.from_batches([batch]), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1).max()))])], names=["norm"])
