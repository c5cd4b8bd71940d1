"""Lexical retrieval packing of documents into fixed-length token sequences.

1. Tokenise: every text becomes BPE ids (``tokenizers`` vocabulary, given as its
   rank file) and the end id 0. Whole windows of ``window`` ids are sequences of
   their own; the tail of fewer ids remains to be packed. Document frequencies
   of all ids are gathered over all documents in the same pass.
2. Shard: tails are range-partitioned by two minwise ids, so lexically close
   tails tend to meet; shards hold about ``shard_docs`` tails, and equal keys
   (a group of copies) are split among shards by document id.
3. Pack, per shard: a BM25 inverted index over the shard's tails returns the
   unused neighbours of each seed, which fill the seed's window greedily;
   the neighbour that crosses the end is cut there and its rest is the next seed.
   Only the last window of a shard can be padded.

The window's ids are carried whole (``ids``, little-endian unsigned 32-bit).

Defined results: null or empty text is the end id alone; repeated rows and null
ids are packed row by row; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import chunks, mix64, written

RUNS = r"|\s+(?!\S)|\s+"                   # how the split pattern ends: runs of whitespace
TWO_SPACES = r"[\t-\r \x{85}\p{Z}]{2}"     # two characters of the pattern's \s, as Arrow's regex engine names them
QUERY_TERMS = 24     # a seed asks with its heaviest terms
NEIGHBOURS = 64      # neighbours fetched per lookup; the lookup repeats while the window has room
K1, B = 1.2, 0.75
_END = 0
_PIECES = "kind int, doc_id long, start long, doc_tokens long, h1 long, h2 long, ids binary"
_PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_workers: dict = {}


class WordEncoder:
    """Ids of texts.

    Only a run of two or more whitespace characters needs the split pattern's
    lookahead (the run's last character belongs to the next word). Texts without
    such a run are split by the same pattern with single whitespace in its place,
    which the tokenizer's regex engine runs several times as fast."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        single = pattern.removesuffix(RUNS) + r"|\s" if pattern.endswith(RUNS) else pattern
        self.full, self.single = [tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                                  for p in (pattern, single)]

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow.compute as pc

        runs = pc.match_substring_regex(pa.array(texts, pa.large_string()), TWO_SPACES).to_pylist()
        return [np.array((self.full if run else self.single).encode_ordinary(text), "<u4").tobytes()
                for text, run in zip(texts, runs, strict=True)]


def _tokenise(ranks_path: str, pattern: str, window: int, vocabulary: int):
    def run(batches):
        key = ("encoder", ranks_path)
        if key not in _workers:
            _workers[key] = WordEncoder(ranks_path, pattern)
        encoder = _workers[key]
        order = mix64(np.arange(2 * vocabulary, dtype=np.uint64)).reshape(2, vocabulary) >> np.uint64(1)
        df, end = np.zeros(vocabulary, np.int64), np.array([_END], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch, 1 << 20):
                ids = part.column("doc_id").to_pylist()
                rows = []
                for doc, raw in zip(ids, encoder.encode([t or "" for t in part.column("text").to_pylist()]),
                                    strict=True):
                    raw += end
                    token = np.frombuffer(raw, "<u4")
                    own, _ = _distinct(token)
                    df[own] += 1
                    n, whole = len(token), len(token) // window * window
                    for a in range(0, whole, window):
                        rows.append((0, doc, a, n, 0, 0, raw[4 * a:4 * (a + window)]))
                    if whole < n:
                        h = order[:, token[whole:] if whole else own].min(axis=1)
                        rows.append((1, doc, whole, n, int(h[0]), int(h[1]), raw[4 * whole:]))
                yield _batch(rows, (pa.int32(), *[pa.int64()] * 5, pa.binary()),
                             ("kind", "doc_id", "start", "doc_tokens", "h1", "h2", "ids"))
        if df.any():
            yield _batch([(2, 0, 0, 0, 0, 0, df.astype("<i8").tobytes())], (pa.int32(), *[pa.int64()] * 5, pa.binary()),
                         ("kind", "doc_id", "start", "doc_tokens", "h1", "h2", "ids"))
    return run


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a non-empty array in order, and how often each occurs."""
    ids = np.sort(ids)
    last = np.append(np.flatnonzero(ids[1:] != ids[:-1]), len(ids) - 1)
    return ids[last], np.diff(last, prepend=-1)


def _batch(rows, types, names):
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))


def _add_counts(batches):
    """Sum of a partition's document-frequency vectors as (term, df) rows."""
    total = None
    for batch in batches:
        for raw in batch.column("ids"):
            v = np.frombuffer(raw.as_buffer(), "<i8")
            total = v.copy() if total is None else total + v
    if total is not None:
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(total[term], pa.int64())],
                                         names=["term", "df"])


class Bm25Shard:
    """Inverted index over the token arrays of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = zip(*[_distinct(d) for d in docs], strict=True)
        size = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(counts)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))
        self.queries = []
        at = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        for i in range(len(docs)):
            w = weight[at[i]:at[i + 1]]
            top = np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS] if len(w) > QUERY_TERMS else np.arange(len(w))
            self.queries.append(terms[i][top])
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.n = len(docs)

    def neighbours(self, seed: int, free: np.ndarray, many: int) -> np.ndarray:
        """Unused documents by falling BM25 score for the seed's heaviest terms (ties: smaller position)."""
        terms = self.queries[seed].astype(np.int64)
        lists = list(map(slice, self.at[terms].tolist(), self.at[terms + 1].tolist()))
        # one count over all lists: a document's weights are added in the order of the terms
        score = np.bincount(np.concatenate([self.owner[x] for x in lists]),
                            np.concatenate([self.weight[x] for x in lists]), self.n)
        score = np.where(free, score, -1.0)
        many = min(many, self.n)
        top = np.argpartition(-score, many - 1)[:many]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]


def pack_shard(rows: list[tuple], idf: np.ndarray, mean: float, window: int):
    """Pieces ``(row, from, to, sequence, offset)`` of one shard's tails ``(doc_id, start, tokens, ...)``."""
    if not rows:
        return
    rows_tokens = [r[2] for r in rows]
    index = Bm25Shard(rows_tokens, idf, mean)
    free = np.ones(len(rows), bool)
    sequence, fill, rest, cursor = 0, 0, None, 0

    def put(i, a):
        """Place tokens of row i from a on; returns the row's rest that did not fit."""
        nonlocal sequence, fill
        n = len(rows_tokens[i])
        b = min(n, a + window - fill)
        piece = (i, a, b, sequence, fill)
        fill += b - a
        if fill == window:
            sequence, fill = sequence + 1, 0
        return piece, ((i, b) if b < n else None)

    while True:
        if rest is None:
            while cursor < len(rows) and not free[cursor]:
                cursor += 1
            if cursor == len(rows):
                return
            seed, begin = cursor, 0
            free[seed] = False
        else:
            seed, begin = rest
        piece, rest = put(seed, begin)
        yield piece
        while fill and rest is None:
            near = index.neighbours(seed, free, NEIGHBOURS)
            if not len(near):
                break  # nothing shares a term: the next free tail continues the window
            for i in near.tolist():
                free[i] = False
                piece, rest = put(i, 0)
                yield piece
                if rest is not None or not fill:
                    break


def _packer(frequencies, documents: int, mean: float, window: int, vocabulary: int):
    def run(batches):
        df = np.zeros(vocabulary)
        term, count = frequencies.value
        df[term] = count
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        rows = []
        for batch in batches:
            for d, s, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(),
                                    batch.column("doc_tokens").to_pylist(), batch.column("ids"), strict=True):
                rows.append((d, s, np.frombuffer(raw.as_buffer(), "<u4").astype(np.uint16 if vocabulary <= 1 << 16
                                                                               else np.uint32), n))
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        base = ((1 << 20) + TaskContext.get().partitionId()) << 40
        out = []
        for i, a, b, sequence, offset in pack_shard(rows, idf, mean, window):
            d, s, ids, n = rows[i]
            out.append((d, s + a, b - a, ids[a:b].astype("<u4").tobytes(), n, base + sequence, offset))
            if len(out) == 2000:
                yield _batch(out, _TYPES, _NAMES)
                out = []
        yield _batch(out, _TYPES, _NAMES)
    return run


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, ranks_path: str, pattern: str, vocabulary: int = 50_257, window: int = 1024,
         shard_docs: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = docs.mapInArrow(_tokenise(ranks_path, pattern, window, vocabulary), _PIECES)
    path = written(pieces, "tokens", compression="zstd")
    tails = path.where("kind = 1")
    totals = tails.agg(F.count("*").alias("n"), F.avg(F.octet_length("ids") / 4).alias("mean")).first()
    # document frequencies: one number per id of the vocabulary, so the result is bounded by the vocabulary
    counts = (path.where("kind = 2").select("ids").mapInArrow(_add_counts, "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).orderBy("term").toPandas())
    documents = path.where("start + octet_length(ids) / 4 = doc_tokens and kind < 2").count()
    shared = docs.sparkSession.sparkContext.broadcast((counts["term"].to_numpy(), counts["df"].to_numpy()))
    shards = max(1, -(-totals["n"] // shard_docs))
    packed = (tails.select("doc_id", "start", "doc_tokens", "ids", "h1", "h2")
              .repartitionByRange(shards, "h1", "h2", "doc_id", "start")
              .mapInArrow(_packer(shared, documents, float(totals["mean"] or 1.0), window, vocabulary), _PACKED))
    whole = (path.where("kind = 0")
             .select("doc_id", "start", F.lit(window).cast("long").alias("length"), "ids", "doc_tokens",
                     F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return whole.unionByName(packed)
