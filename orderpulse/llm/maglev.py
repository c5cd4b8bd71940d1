"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the table's slots (an offset and a
skip derived from the shard's name; the table size is prime, so the order visits
every slot). Shards take turns: each claims its most preferred free slot until
the table is full, so shares differ by at most one slot per weight unit, and
adding or removing a shard moves few slots. The table (``table_size`` numbers,
whatever the data) is broadcast; a row's shard is one array lookup.

Defined results: null keys go to the slot of the hash of null; equal keys go to
one shard; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


def preferences(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's preference order."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> np.ndarray:
    """Slot -> position in ``shards``. A shard of weight w claims w slots per turn."""
    if not _prime(size):
        raise ValueError(f"table size {size} is not prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most one per slot")
    place = [preferences(s, size) for s in shards]
    turns = [(weights or {}).get(s, 1) for s in shards]
    table, step, free = np.full(size, -1, np.int32), [0] * len(shards), size
    while free:
        for i, (offset, skip) in enumerate(place):
            for _ in range(turns[i]):
                slot = (offset + step[i] * skip) % size
                while table[slot] >= 0:
                    step[i] += 1
                    slot = (offset + step[i] * skip) % size
                table[slot] = i
                step[i] += 1
                free -= 1
                if not free:
                    return table
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text (null: empty text) modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
          weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (the shard's name), replacing columns so named."""
    spark = df.sparkSession
    table = lookup_table(shards, size, weights)
    rows = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(table.tolist())], "slot int, shard string")
    out = df.drop("shard").withColumn("slot", slot_of(F.col(key), size))
    return out.join(F.broadcast(rows), "slot").select(*[c for c in out.columns if c != "slot"], "slot", "shard")
