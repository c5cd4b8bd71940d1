"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ')
         ELSE array_to_string(ws[i:i + 3], ' ') END AS s
  FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, link.v FROM reach JOIN link ON link.u = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


@query("op9_chosen_path_near_duplicates", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: sets of 4-word shingles, similarity 0.8."""
    from orderpulse.llm.chosen_path import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), shingle=4, percent=80)


@query("op1_lexical_retrieval_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; ids digested as CRC-32."""
    import public_tokenizers as P

    from orderpulse.llm.packing import pack
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    pieces = pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op7_permutation_table_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document among 64 shards, through a table of 65537 slots."""
    from orderpulse.llm.maglev import place
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    # the text's size is what the shard's load is measured in
    docs = docs.select("doc_id", "source", F.octet_length("text").cast("long").alias("text_bytes"))
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(64)])


@query("op8_pivotal_source_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1 at 150 % of their words."""
    from orderpulse.llm.pivotal_mix import mix
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""


@query("op2_warc_salvage", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as a WARC archive and read back; digests are taken from what was read."""
    from orderpulse.llm import warc
    from orderpulse.llm.common import scratch_path, written
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), path)
    read = warc.read(spark, path).select(
        "kind", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("kind") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
        .alias("payload_digest"))
    return warc.resolve(written(read, "records"))


@query("op4_multi_index_hashing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th vector by inner product, through multi-index hashing."""
    from orderpulse.llm.multi_index import nearest
    return nearest(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), every=20, k=20)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op10_mtree_top_products", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector, through paged M-trees."""
    from orderpulse.llm.mtree import top_products
    return top_products(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), every=50, k=5)


@query("op6_factorization_machine_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labelled rows that are not held out."""
    from orderpulse.llm.toxicity import toxicity
    return toxicity(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                    read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


@query("op3_fuzzy_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines: line counts and the CRC-32 of the text that stays."""
    from orderpulse.llm.fuzzy_lines import dedup_lines
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return dedup_lines(docs).select("doc_id", "lines", "lines_kept",
                                    F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def _license_oracle() -> str:
    from orderpulse.llm.license_rules import oracle
    return oracle()


@query("op5_license_sentence_rules", _license_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named by the sentences of every document."""
    from orderpulse.llm.license_rules import scan
    return scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


OP12_SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
f1 AS (SELECT lang, ws[i] AS x, count(*) AS f FROM w, unnest(range(1, len(ws) + 1)) AS t(i) GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f
       FROM w, unnest(range(1, len(ws))) AS t(i) GROUP BY ALL),
f3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f
       FROM w, unnest(range(1, len(ws) - 1)) AS t(i) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cover AS (SELECT lang, x, y, max(f) AS f FROM (
          SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) AS u GROUP BY ALL),
two AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, l.f AS l, r.f AS r,
         CAST(1000000 AS HUGEINT) * b.f * b.f // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM f2 b JOIN f1 l ON l.lang = b.lang AND l.x = b.x JOIN f1 r ON r.lang = b.lang AND r.x = b.y
  LEFT JOIN cover c ON c.lang = b.lang AND c.x = b.x AND c.y = b.y
  WHERE b.f >= 10 AND (c.f IS NULL OR 100 * c.f < 50 * b.f)),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
         CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(l1.f AS HUGEINT) * r1.f) AS s1,
         CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(l2.f AS HUGEINT) * r2.f) AS s2
  FROM f3 t JOIN f1 l1 ON l1.lang = t.lang AND l1.x = t.x
  JOIN f2 r1 ON r1.lang = t.lang AND r1.x = t.y AND r1.y = t.z
  JOIN f2 l2 ON l2.lang = t.lang AND l2.x = t.x AND l2.y = t.y
  JOIN f1 r2 ON r2.lang = t.lang AND r2.x = t.z),
three AS (SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l,
                 CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, least(s1, s2) AS score FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
           FROM (SELECT * FROM two UNION ALL SELECT * FROM three) AS u)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_direct_address_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words per language over all documents, counted in pair tiles."""
    from orderpulse.llm.tiling import collocations
    return collocations(read_table(spark, sf_dir, "documents", ["lang", "text"]))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY h)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM t JOIN g USING (h)
"""


@query("op13_digest_index_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents, through a bucketed and sorted digest index."""
    from orderpulse.llm.digest_index import exact_duplicates
    return exact_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) AS t
  WHERE place <= 5),
r AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
   AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM r WHERE rank <= 5
"""


@query("op11_cover_tree_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector below each of its five positives, through cover trees."""
    from orderpulse.llm.cover_tree import hard_negatives
    return hard_negatives(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
