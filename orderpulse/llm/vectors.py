"""What the two vector searches share: reading vectors inside tasks and merging partial answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = "vec_id long, dim int, v binary"


def usable_vectors(integers: bool):
    """mapInArrow function ``(vec_id, embedding) -> (vec_id, dim, v)``; ``v`` holds doubles, or for
    ``integers`` floor(256 x) as 64-bit integers. Null vectors and vectors holding null or non-finite
    components are left out; zero vectors too unless ``integers``."""
    def run(batches):
        for batch in batches:
            ids, dims, out = [], [], []
            column = batch.column("embedding")
            values = column.values.cast(pa.float64())
            flat = values.to_numpy(zero_copy_only=False)  # nulls become NaN
            offsets, nulls = column.offsets.to_numpy(), column.is_null().to_pylist()
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                x = flat[offsets[i]:offsets[i + 1]]
                if nulls[i] or vec_id is None or not len(x) or not np.isfinite(x).all():
                    continue
                if integers:
                    x = np.floor(256.0 * x)
                    if not float(x @ x) <= 2.0 ** 52:
                        raise ValueError(f"row {vec_id}: too long a vector for exact scores")
                    x = x.astype(np.int64)
                elif not x.any():
                    continue
                ids.append(vec_id)
                dims.append(len(x))
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                names=["vec_id", "dim", "v"])
    return run


def matrix(table: pa.Table, dtype, column: str = "v") -> np.ndarray:
    """The vectors of a table as rows of one array."""
    raw = table.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= kth)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of all partial answers ``(query_id, vec_id, score)`` with their ranks."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def blocked(index: DataFrame, queries: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Index rows repeated per query block, queries repeated per shard: groups (shard, block) of bounded size."""
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    return index, queries
