"""Helpers shared by the training-data operators.

* ``written``     writes a frame as Parquet below the shared checkpoint folder
                  and reads it back: lineage is cut, losing an executor costs a re-read.
* ``components``  connected components of an edge table (large-star / small-star),
                  DataFrame operations only.
* ``hash_words``  vectorised 64-bit hashes of the words of UTF-8 bytes (numpy, used inside tasks).
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.session import ensure_checkpoint_dir

#: Word separators everywhere in this package: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from that table."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id128(*cols: Column) -> Column:
    """128-bit hash of some columns as 16 bytes: equality, ordering and shuffling work on it."""
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _fingerprint(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return r["n"], r["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every id of ``edges(u, v)``; label is the smallest id of its component.

    Large-star and small-star steps: each replaces a vertex's links by links to
    the smallest id it knows, so hub vertices never gather their neighbours in
    one row; per vertex only a minimum is aggregated (map-side combined) and
    joined back (AQE splits a hot hub). Rounds grow with the logarithm of the
    component size. Self-loops and null ids are ignored; an empty table gives
    an empty result."""
    e = (edges.select("u", "v").where("u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
         .checkpoint())
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(m, "u")
        e = (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
             .unionByName(m.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("id"), F.col("v").alias("label"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def hash_words(data: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Hashes and start offsets of the words in UTF-8 bytes, A-Z folded to a-z.

    ``prefixes``: also hash the first so many bytes of every longer word; these
    come as further ``(hashes, starts)`` after the words' own, in one flat pair.

    A word's hash is a polynomial of its bytes modulo 2**64, taken as a
    difference of prefix sums, then mixed with its length. Works in blocks of
    about 1 MB that end at a separator, so memory does not grow with the text."""
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(at + _BLOCK, n)
        if end < n:  # end the block at a separator; a longer word makes a longer block
            gap = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gap) and end < n:
                nxt = min(end + _BLOCK, n)
                gap = np.flatnonzero(_SPACE[data[end:nxt]]) + (end - at)
                end = nxt
            end = at + int(gap[-1]) + 1 if len(gap) else n
        block = data[at:end]
        word = ~_SPACE[block]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _power_tables(len(block) + 1)
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((_LOWER[block].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            h = (total[e] - total[s]) * down[s]
            hashes.append(mix64(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
            starts.append(s + at)
            for n_bytes in prefixes:
                long = e - s > n_bytes
                h = (total[s[long] + n_bytes] - total[s[long]]) * down[s[long]]
                hashes.append(mix64(h ^ np.uint64((n_bytes * 0x9FB21C651E98DF25) & _MASK)))
                starts.append(s[long] + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column joined by spaces, and the n + 1 row offsets (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    n = len(column)
    out = np.full(int(off[-1] - off[0]) + n, 0x20, np.uint8)
    at = off - off[0] + np.arange(n + 1)
    if len(data):
        keep = np.ones(len(out), bool)
        keep[at[1:] - 1] = False
        out[keep] = data[off[0]:off[-1]]
    return out, at


def chunks(batch, max_bytes: int = 4 << 20):
    """Slices of an Arrow batch whose column ``text`` holds about ``max_bytes`` each (one row at least)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(size):
        if total and total + n > max_bytes:
            yield batch.slice(begin, i - begin)
            total, begin = 0, i
        total += int(n)
    if begin < len(size):
        yield batch.slice(begin)
