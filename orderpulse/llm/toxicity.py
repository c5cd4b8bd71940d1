"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and the first 4, 5 and 6 bytes of longer
words (inflected insults share them), hashed to 32 bits. The machine's score is
a bias, a weight per term, and for every pair of terms the product of two
learned factor vectors, so a pair such as an insult with a mention of a group
counts beyond the sum of its parts.

Fitting uses a bounded sample: at most ``sample_rows`` labelled rows in the order
of a hash of their id. Their term counts are aggregated by Spark; the
``TERMS`` terms that separate the labels best (chi-square) are kept, and the
machine is fitted to the sample's kept terms on the driver. Scoring reads every
whole text inside tasks; the model is broadcast (``TERMS`` x (2 + ``FACTORS``)
numbers, whatever the data).

Rows with crc32(id as text) mod 3 = 1 are held out: their labels are never read.

Defined results: null or empty text is scored with the bias alone; a null id is
not held out and never labelled; of repeated labels of an id the larger counts;
labels that are null or neither 0 nor 1 are ignored; without labelled rows of
both kinds every score is 0; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import chunks, hash_words, text_buffer

PREFIXES = (4, 5, 6)
TERMS = 4096
FACTORS = 8
SAMPLE_ROWS = 20_000
MIN_COUNT = 4
LEAST_CHI = 20.0  # a weaker link between term and label may be chance
_ROW = "doc_id long, toxic int, terms binary"


def text_terms(texts):
    """Sorted distinct 32-bit terms of each row of an Arrow text column."""
    data, at = text_buffer(texts)
    hashes, starts = hash_words(data, PREFIXES)
    row = np.searchsorted(at, starts, side="right") - 1
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    cut = np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    return [low[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    terms: np.ndarray    # kept terms, ascending
    bias: float
    weight: np.ndarray
    factor: np.ndarray   # terms x FACTORS

    def active(self, terms: np.ndarray) -> np.ndarray:
        """Positions of the kept terms among ``terms``."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == terms] if len(self.terms) else np.empty(0, np.int64)

    def logit(self, active: np.ndarray) -> float:
        v = self.factor[active]
        s = v.sum(axis=0)
        return self.bias + float(self.weight[active].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())

    def score(self, active: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(active), -30, 30))))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, epochs: int = 20,
                rate: float = 0.15, decay: float = 2e-4, seed: int = 5) -> Model:
    """Logistic loss, AdaGrad, minibatches of 128 rows; rows hold positions of their kept terms."""
    rng = np.random.default_rng(seed)
    n, k = len(terms), FACTORS
    w, v, bias = np.zeros(n), rng.normal(0, 0.02, (n, k)), float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, k), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 128):
            batch = order[i:i + 128]
            lens = np.array([len(rows[j]) for j in batch])
            idx = np.concatenate([rows[j] for j in batch])
            owner = np.repeat(np.arange(len(batch)), lens)
            vi = v[idx]
            s = np.zeros((len(batch), k))
            np.add.at(s, owner, vi)
            pair = 0.5 * ((s * s).sum(axis=1) - np.bincount(owner, (vi * vi).sum(axis=1), len(batch)))
            z = bias + np.bincount(owner, w[idx], len(batch)) + pair
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch) * 16
            gb += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / gb ** 0.5
            used, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, g[owner], len(used)) + decay * w[used]
            dv = np.zeros((len(used), k))
            np.add.at(dv, inverse, g[owner, None] * (s[owner] - vi))
            dv += decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Model(terms, bias, w, v)


def _sample_terms(batches):
    for batch in batches:
        for part in chunks(batch):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"),
                 pa.array([t.tobytes() for t in text_terms(part.column("text"))], pa.binary())],
                names=["doc_id", "toxic", "terms"])


def _count_terms(batches):
    """Term counts by label of a partition: one row per term and partition."""
    parts = {0: [], 1: []}
    for batch in batches:
        for toxic, raw in zip(batch.column("toxic").to_pylist(), batch.column("terms"), strict=True):
            parts[toxic].append(np.frombuffer(raw.as_buffer(), np.uint32))
    zero, one = (np.concatenate(p) if p else np.empty(0, np.uint32) for p in (parts[0], parts[1]))
    terms, inverse = np.unique(np.concatenate((zero, one)), return_inverse=True)
    n1 = np.bincount(inverse[len(zero):], minlength=len(terms))
    n = np.bincount(inverse, minlength=len(terms))
    yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(n), pa.array(n1)],
                                     names=["term", "n", "n1"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most ``sample_rows`` labelled rows that are not held out; None without both labels."""
    known = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id"))
             .agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out("l_id"))
             .orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows))
    rows = (docs.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).dropDuplicates(["doc_id"])
            .select("doc_id", "toxic", "text"))
    rows = rows.mapInArrow(_sample_terms, _ROW).checkpoint()
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    n, n1 = total["n"], total["n1"] or 0
    if not n1 or n1 == n:
        return None
    count = (rows.select("toxic", "terms").mapInArrow(_count_terms, "term long, n long, n1 long")
             .groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= MIN_COUNT))
    a, b = F.col("n1"), F.col("n") - F.col("n1")
    c, d = F.lit(n1) - a, F.lit(n - n1) - b
    chi = (a * d - b * c) * (a * d - b * c) * float(n) / (F.greatest((a + b) * (c + d), F.lit(1)).cast("double") * float(n1) * float(n - n1))
    best = count.select("term", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(TERMS)
    terms = np.sort(best.select("term").toArrow().column(0).to_numpy()).astype(np.uint32)
    if not len(terms):
        return None
    empty = Model(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))
    kept = rows.mapInArrow(_activate(empty), _ROW).orderBy("doc_id").toArrow()
    active = [np.frombuffer(x, np.int64) for x in kept.column("terms").to_pylist()]
    return fit_machine(active, kept.column("toxic").to_numpy().astype(float), terms)


def _activate(model: Model):
    def run(batches):
        for batch in batches:
            out = [model.active(np.frombuffer(x.as_buffer(), np.uint32)).tobytes() for x in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"),
                                              pa.array(out, pa.binary())], names=["doc_id", "toxic", "terms"])
    return run


def _scorer(shared, columns):
    def run(batches):
        model = shared.value
        # most terms are not kept: a bit per low half of the hash sorts them out before the search
        maybe = np.zeros(1 << 16, bool)
        if model is not None:
            maybe[model.terms & np.uint32(0xFFFF)] = True
        for batch in batches:
            for part in chunks(batch):
                if model is None:
                    score = [0.0] * part.num_rows
                else:
                    score = [model.score(model.active(t[maybe[t & np.uint32(0xFFFF)]]))
                             for t in text_terms(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(score, pa.float64())],
                                                 names=[*columns, "score"])
    return run


def score_texts(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``, from the whole of column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    need = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*[f"`{c}` {need.schema[c].dataType.simpleString()}" for c in keep], "score double"])
    return need.mapInArrow(_scorer(shared, keep), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_texts(docs, fit(docs, labels, sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
               sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score lies below ``threshold``; same columns."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(plain, labels, sample_rows)
    named = docs.toDF(*[c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)])  # no name clashes with the score's
    kept = score_texts(named, model, tuple(named.columns)).where(F.col("score") < threshold)
    return kept.select(*named.columns).toDF(*docs.columns)
