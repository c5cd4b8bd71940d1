"""MinHash near-dedup by a chosen-path set-similarity join.

A document's set holds its distinct shingles of ``k`` consecutive words. Equal
sets are collapsed to one class first, so a group of copies costs one row. Then,
for each of ``TREES`` independent trees, every class descends from the root
into the nodes named by ``FANOUT`` selected minwise tokens (node key = tree,
token position, token). Nodes with few classes are compared exhaustively;
larger nodes branch again on further minwise tokens until they are small.

Recall: two sets of similarity 0.8 miss both selected tokens of a tree's root
with probability 0.04; where nodes are large they must also share one of two
tokens a level below. Over five trees a pair at the threshold is lost with
probability below 5e-7, and the sketch tests lose it with about 3e-5 each.

Whole results: the outcome is connected components, so comparisons that cannot
change them are left out. First every node elects a leader, each class is
compared with the most similar leader of its nodes, and confirmed links merge
classes under one label (``LEADER_TURNS`` rounds). A node whose members share a
label is settled. In the others, small nodes compare all pairs of different
labels; large ones branch on, again electing leaders. Those still large and
unsettled at the last depth compare every member outside the commonest label
with all members of other labels. No node is dropped or capped. Every link is
confirmed on the full shingle sets.

Defined results: null, empty or blank text gives an empty set linked with
nothing; a text with fewer than ``k`` words is one shingle; repeated rows are
returned as often as they come; a null id takes the smallest non-null id of its
component (null if there is none) and is kept only if that is null too; an empty
table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import chunks, components, hash_words, mix64, text_buffer, written
from orderpulse.sources.tables import bounded_broadcast

TOKENS = 64      # minwise tokens per class
TREES = 5        # independent trees
FANOUT = 2       # selected tokens per node
SMALL = 24       # largest node that is compared exhaustively
DEPTH = 1        # branchings below a root child
LEADER_TURNS = 2  # rounds in which every node compares its members with an elected leader
FINE = 2048      # parity bits of the sharper sketch that classes of unsettled nodes get
SIGMAS = 4.0     # a pair is confirmed unless a sketch lies this far below the threshold
BROADCAST_ROWS = 1_000_000  # longer lists of document ids are joined by shuffle

_RNG = np.random.default_rng(20240229)
_COEF = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERM = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SKETCH = "doc_id long, n_shingles long, sid binary, sig array<int>, sketch array<long>"
_SKETCH_COLS = [f"k{i}" for i in range(TOKENS // 8)]
_SETS = "sid binary, shingles binary"
_FINE_ROW = "sid binary, fine array<long>"


def shingle_sets(texts, k: int):
    """One sorted array of distinct shingle hashes per row of an Arrow text column."""
    data, at = text_buffer(texts)
    words, starts = hash_words(data)
    first = np.searchsorted(starts, at)
    coef = [_COEF[i % len(_COEF)] * np.uint64(2 * (i // len(_COEF)) + 1) for i in range(k)]
    rolling = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k if len(rolling) else 0):
        rolling += words[i:i + len(rolling)] * coef[i]
    rolling = mix64(rolling)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolling[a:b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = (words[a:b] * np.array(coef[:b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            yield mix64(whole ^ np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def _sid(s: np.ndarray) -> bytes:
    """128-bit name of a set: two sums of differently mixed members."""
    with np.errstate(over="ignore"):
        a = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = mix64(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _odd_sketch(s: np.ndarray) -> np.ndarray:
    """``FINE`` bits, each flipped by the members that fall to it: two sets differ in as many members at least."""
    at = (mix64(s ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(FINE)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=FINE) & 1).astype(np.uint8)).view(np.int64)


def _minwise(s: np.ndarray, perm: np.ndarray = _PERM) -> np.ndarray:
    """The smallest 32-bit value of the set under each of some multiplicative orders."""
    best = np.full(len(perm), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 2048):
        best = np.minimum(best, ((s[None, i:i + 2048] * perm[:, None]) >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32).view(np.int32)


def _sketcher(k: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                ids, n, sid, sig = part.column("doc_id"), [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n.append(len(s))
                    sid.append(_sid(s))
                    sig.append(_minwise(s) if len(s) else None)
                flat = np.concatenate([x for x in sig if x is not None] or [np.empty(0, np.int32)])
                off = np.concatenate(([0], np.cumsum([0 if x is None else TOKENS for x in sig])))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(off // 8, pa.int32()),
                                              pa.array(flat.astype(np.uint8).view(np.int64), pa.int64()))],
                    names=["doc_id", "n_shingles", "sid", "sig", "sketch"])
    return run


def _set_writer(k: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = list(shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_sid(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "shingles"])
    return run


def _fine_writer(k: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = [s for s in shingle_sets(part.column("text"), k) if len(s)]
                fine = [_odd_sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_sid(s) for s in sets], pa.binary()), pa.array(fine, pa.list_(pa.int64()))],
                    names=["sid", "fine"])
    return run


def _confirm(percent: int):
    def run(batches):
        last = (b"", None)
        for batch in batches:
            keep = []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
                if u != last[0]:
                    last = (u, np.frombuffer(a.as_buffer(), np.uint64))
                x, y = last[1], np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(
                pa.array(keep, pa.bool_()))
    return run


def _least(tokens: int, percent: int) -> int:
    p = percent / 100
    return max(1, int(p * tokens - SIGMAS * (tokens * p * (1 - p)) ** 0.5))


def _alike(a: str, b: str, percent: int):
    """Sketch and size test of a pair: false only if it is safely below the threshold."""
    fits = (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent)
    return fits & (_matches(a, b) >= _least(TOKENS, percent))


def _finely_alike(a: str, b: str, percent: int):
    """The same with the parity sketch: exact, as similar sets differ in few members and so in few bits."""
    differ = F.aggregate(F.zip_with(f"{a}.fine", f"{b}.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda t, x: t + x)
    return _alike(a, b, percent) & (differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent))


def _unequal_bytes(x):
    """Number of non-zero bytes of a long: each byte is folded onto its last bit."""
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return F.bit_count(x)


def _matches(a: str, b: str):
    """Number of equal bytes in two sketches of 8 longs (64 minwise tokens, 8 bits each)."""
    total = F.lit(TOKENS)
    for k in _SKETCH_COLS:
        total = total - _unequal_bytes(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")))
    return total


def _sized(nodes: DataFrame) -> DataFrame:
    """Members of nodes with at least two classes, with the node's size."""
    size = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return nodes.join(size, "node")


def _small_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of small nodes that differ in label and pass the sketch test."""
    small = nodes.where(F.col("size") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    return (a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.sid") < F.col("b.sid"))
                   & (F.col("a.label") != F.col("b.label")) & _finely_alike("a", "b", percent))
            .select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")))


def _leader_pairs(nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each class with the most similar of the leaders that its nodes elect in this turn."""
    rank = F.xxhash64(F.lit(turn), "node", "sid").alias("rank")
    lead = (nodes.groupBy("node").agg(F.min(F.struct(rank, "sid", "label", "n", *_SKETCH_COLS)).alias("l"))
            .select("node", "l.*"))
    a, b = nodes.alias("a"), lead.alias("b")
    near = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
                  & _alike("a", "b", percent))
    best = near.groupBy(F.col("a.sid").alias("sid")).agg(
        F.max(F.struct(_matches("a", "b").alias("m"), F.col("b.sid").alias("other"))).alias("x"))
    return best.select(F.greatest("sid", "x.other").alias("v"), F.least("sid", "x.other").alias("u")).select("u", "v")


def _loose_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """In each node, members outside its commonest label with all members of other labels."""
    per = nodes.groupBy("node", "label").agg(F.count("*").alias("c"))
    main = per.groupBy("node").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    a = nodes.join(main, "node").where("label <> main").alias("a")
    b = nodes.alias("b")
    return (a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
                   & _finely_alike("a", "b", percent))
            .select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v")))


def _unsettled(nodes: DataFrame) -> DataFrame:
    """Members of nodes that still hold more than one label."""
    open_ = nodes.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return nodes.join(open_.select("node"), "node", "left_semi")


def _children(nodes: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Two branches per member: minwise tokens selected by the node's own key."""
    picks = [F.pmod(F.xxhash64(F.lit(level), F.lit(i), F.col("node")), F.lit(TOKENS)) for i in range(FANOUT)]
    picks[1:] = [F.pmod(picks[0] + 1 + F.pmod(p, F.lit(TOKENS - 1)), F.lit(TOKENS)) for p in picks[1:]]
    kids = [F.xxhash64(F.lit(level), "node", p, F.get("sig", p.cast("int"))) for p in picks]
    full = nodes.drop("size").join(classes.select("sid", "sig"), "sid")
    return full.withColumn("node", F.explode(F.array(*kids))).drop("sig")


def _relabel(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return (nodes.drop("label").join(labels.withColumnRenamed("id", "sid"), "sid", "left")
            .withColumn("label", F.coalesce("label", "sid")))


class _Confirmer:
    """Confirms candidate pairs on full sets and keeps the links found so far."""

    def __init__(self, docs, classes, k, percent):
        self.docs, self.classes, self.k, self.percent = docs, classes, k, percent
        self.links = None

    def add(self, pairs: DataFrame) -> bool:
        """Confirm ``pairs`` and report whether there were any links."""
        pairs = written(pairs.distinct(), "pairs")
        ids = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
        sets = (self.texts(ids).mapInArrow(_set_writer(self.k), _SETS).join(ids, "sid", "left_semi")
                .dropDuplicates(["sid"]))
        sets = written(sets, "sets")
        a = sets.select(F.col("sid").alias("u"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("sid").alias("v"), F.col("shingles").alias("sb"))
        links = written(pairs.join(b, "v").join(a, "u").select("u", "v", "sa", "sb")
                        .mapInArrow(_confirm(self.percent), "u binary, v binary"), "links")
        # groups found before enter as stars, which settle in few rounds
        self.links = links if self.links is None else self.links.unionByName(links)
        return bool(links.take(1))

    def texts(self, ids: DataFrame) -> DataFrame:
        """Documents that represent the classes named by ``ids(sid)``."""
        reps = written(self.classes.join(ids, "sid", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "reps")
        return self.docs.join(bounded_broadcast(reps, BROADCAST_ROWS), "doc_id", "left_semi")

    def labels(self) -> DataFrame:
        labels = components(self.links).checkpoint()
        self.links = labels.select(F.col("id").alias("u"), F.col("label").alias("v"))
        return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``; see the module text.

    ``percent``: link when ``100 * |A and B| >= percent * |A or B|``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(docs.mapInArrow(_sketcher(shingle), _SKETCH), "sketches")
    full = rows.where("n_shingles > 0")
    first = F.min(F.struct(F.col("n_shingles").alias("n"), "sig", "sketch")).alias("s")
    classes = written(full.groupBy("sid").agg(F.min("doc_id").alias("rep"), first)
                      .select("sid", "rep", "s.n", "s.sig",
                              *[F.get("s.sketch", F.lit(i)).alias(k) for i, k in enumerate(_SKETCH_COLS)]), "classes")
    # a class whose rows all have a null id is represented by null; its text is found through a stand-in id
    null_id = F.lit(-(1 << 63))
    confirm = _Confirmer(docs.withColumn("doc_id", F.coalesce("doc_id", null_id)),
                         classes.withColumn("rep", F.coalesce("rep", null_id)), shingle, percent)

    roots = [F.xxhash64(F.lit(t), F.lit(t * FANOUT + i), F.get("sig", F.lit(t * FANOUT + i)))
             for t in range(TREES) for i in range(FANOUT)]
    light = _sized(classes.select("sid", F.explode(F.array(*roots)).alias("node")))
    nodes = written(light.join(classes.drop("sig", "rep"), "sid").withColumn("label", F.col("sid")), "nodes")
    labels = None
    for turn in range(LEADER_TURNS):
        if not confirm.add(_leader_pairs(nodes, percent, turn)):
            break
        labels = confirm.labels()
        nodes = written(_unsettled(_relabel(nodes, labels)), "nodes")

    fine = confirm.texts(nodes.select("sid").distinct()).mapInArrow(_fine_writer(shingle), _FINE_ROW)
    nodes = nodes.join(written(fine.dropDuplicates(["sid"]), "fine"), "sid")
    found = []
    for depth in range(DEPTH + 1):
        found.append(_small_pairs(nodes, percent))
        nodes = nodes.where(F.col("size") > SMALL)
        if depth == DEPTH or not nodes.take(1):
            break
        nodes = written(_sized(_unsettled(_children(nodes, classes, depth + 1))), "nodes")
        found.append(_leader_pairs(nodes.where(F.col("size") > SMALL), percent, LEADER_TURNS + depth))
    pairs = found[0]
    for p in found[1:]:
        pairs = pairs.unionByName(p)
    if confirm.add(pairs):
        labels = confirm.labels()
        nodes = _unsettled(_relabel(nodes, labels))
    if nodes.take(1) and confirm.add(_loose_pairs(nodes, percent)):
        labels = confirm.labels()
    if labels is None:
        labels = classes.select(F.col("sid").alias("id"), F.col("sid").alias("label")).limit(0)

    named = rows.select("doc_id", "n_shingles", "sid").join(
        labels.withColumnRenamed("id", "sid"), "sid", "left")
    smallest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("by_label"))
    own = named.where("label is null and n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("by_set"))
    out = named.join(smallest, "label", "left").join(own, "sid", "left")
    component = (F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                 .otherwise(F.coalesce("by_label", "by_set")))
    return (out.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is kept: one document of each near-duplicate group stays.

    Repeated rows of the kept document are reduced to one; documents without
    words all stay. Columns of the input are returned unchanged."""
    found = near_duplicates(docs, shingle=shingle, percent=percent)
    kept = found.where("kept").select("doc_id").distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    words = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "")) > 0
    return out.where(~words).unionByName(out.where(words).dropDuplicates(["doc_id", "text"]))
