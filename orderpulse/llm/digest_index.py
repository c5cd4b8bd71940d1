"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one partition per
delivery. A delivery is first grouped by digest (combined map-side, so a text that
a third of all rows share is one row before it is shuffled), then sort-merge
anti-joined with the index: digests that the index lacks are appended to ``fresh``,
the others to ``again``. Only the delivery's groups move; the index is read bucket
by bucket where it lies. A delivery that is run again overwrites its own partition,
so losing the job between the two writes doubles nothing. ``compact`` rewrites all
deliveries as one.

Texts are equal when identical after every run of U+0020, U+0009 to U+000D became
one space; the digest is the SHA-256 of that form in UTF-8. Of equal texts the row
with the smallest doc_id stays, whichever delivery brought it.

Defined results: a null text is an empty text; a null doc_id counts as a copy and
never wins against an id (a group of null ids alone has ``keep_id`` null and all its
rows ``kept``); rows repeating both id and text carry the same answer each, and
``new_documents`` returns one of them; other columns, whatever their names, are not
read; an empty table gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.llm.common import scratch_path, written

#: Index rows of one bucket: about 200 MB at 50 bytes each.
ROWS_PER_BUCKET = 4_000_000
#: Groups above 1 / HOT of all rows are looked up by broadcast: there are at most HOT of them.
HOT = 4096

_COLUMNS = "digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING"


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of every row of ``docs(doc_id, text)``."""
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


class DigestIndex:
    """The index stored below ``path``; ``create`` makes a new one, ``open`` attaches to a stored one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._names = {part: f"digest_index_{part}_{uuid.uuid4().hex}" for part in ("fresh", "again")}
        for part, name in self._names.items():
            spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet PARTITIONED BY (batch) "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                      f"LOCATION '{self.path}/{part}'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_rows: int) -> DigestIndex:
        """An empty index with a bucket per ``ROWS_PER_BUCKET`` expected rows (eight at least)."""
        buckets = max(8, -(-expected_rows // ROWS_PER_BUCKET))
        return cls._new(spark, path, buckets)

    @classmethod
    def _new(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        index = cls(spark, path, buckets)
        for part in index._names:  # the folders exist from the start
            index._append(part, spark.createDataFrame([], "digest binary, keep_id long, copies long"), "origin")
        spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{index.path}/layout")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        index = cls(spark, path, spark.read.parquet(f"{path.rstrip('/')}/layout").first()["buckets"])
        for name in index._names.values():
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return index

    def close(self) -> None:
        """Forget the catalogue entries; the stored files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(self._names[part])

    def _append(self, part: str, groups: DataFrame, batch: str) -> None:
        # one file a bucket: the rows arrive at the writer in the index's own partitioning
        rows = groups.select("digest", "keep_id", "copies").repartition(self.buckets, "digest")
        view = f"digest_rows_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self._names[part]} PARTITION (batch = '{batch}') "
                       f"SELECT digest, keep_id, copies FROM {view}")
        self.spark.catalog.dropTempView(view)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Deliver ``rows(doc_id, digest)`` under the name ``batch``; the same name again replaces it."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"a delivery is named by letters, digits, '_' and '-': {batch!r}")
        groups = written(_groups(rows), "groups")
        known = self._table("fresh").where(F.col("batch") != batch).select("digest").hint("merge")
        # written before either is appended: a table cannot be overwritten while it is read
        fresh = written(groups.join(known, "digest", "left_anti"), "fresh")
        again = written(groups.join(known, "digest", "left_semi"), "again")
        self._append("fresh", fresh, batch)
        self._append("again", again, batch)

    def state(self) -> DataFrame:
        """``(digest, keep_id, copies)`` over all deliveries."""
        both = self._table("fresh").unionByName(self._table("again"))
        return both.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows(doc_id, digest)`` with ``keep_id, group_size, kept``; every digest must have been delivered."""
        state = written(self.state(), "state")
        total = state.agg(F.sum("copies")).first()[0] or 0
        # at most HOT groups hold more than 1 / HOT of all rows each
        hot = F.broadcast(state.where(F.col("copies") > max(1, total // HOT)))
        cold = rows.join(hot.select("digest"), "digest", "left_anti").join(state.hint("merge"), "digest")
        both = rows.join(hot, "digest").unionByName(cold)
        return both.select("doc_id", "digest", "keep_id", F.col("copies").alias("group_size"),
                           F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))

    def new_documents(self, docs: DataFrame, batch: str) -> DataFrame:
        """Deliver ``docs`` and return the rows, with all their columns, whose text no other delivery holds:
        one a text, with the smallest doc_id."""
        own = "__digest"
        while own in docs.columns:
            own = "_" + own
        normal = docs.withColumn(own, F.unhex(F.sha2(F.regexp_replace(
            F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)))
        self.add(normal.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("digest")), batch)
        new = self._table("fresh").where(F.col("batch") == batch)
        # id and digest together: rows of a hot text spread by their ids
        match = (normal[own] == new["digest"]) & normal["doc_id"].cast("long").eqNullSafe(new["keep_id"])
        return normal.join(new, match, "left_semi").dropDuplicates([own]).drop(own)

    def compact(self, path: str) -> DigestIndex:
        """All deliveries rewritten as one below a new ``path``."""
        out = DigestIndex._new(self.spark, path, self.buckets)
        out._append("fresh", self.state(), "compacted")
        return out


def exact_duplicates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    The rows reach a new index below ``path`` (default: a scratch folder) as two deliveries, the lower
    and the upper half of the id range; the second is deduplicated against the first."""
    spark = docs.sparkSession
    rows = written(digests(docs), "digests")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    index = DigestIndex.create(spark, path or scratch_path(spark, "digest-index"), n)
    middle = 0 if low is None else (low + high) // 2
    first = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    index.add(rows.where(first), "lower")
    index.add(rows.where(~first), "upper")
    return index.lookup(rows).select("doc_id", "keep_id", "group_size", "kept",
                                     F.lower(F.hex("digest")).alias("text_sha256"))
