"""Hard negatives by best-first search in cover trees.

Candidates of one label are split by a hash of their id into shards of about
``SHARD`` rows (copies of one vector and a hot label spread over many). Each shard's
vectors get one more component that makes their norms equal (norm augmentation), so
all lie on a sphere and inner products with a query follow from angles. A shard holds
a cover tree: a node of level ``i`` covers its points within ``BASE ** i`` of its
centre, and its children's centres, more than ``BASE ** (i - 1)`` apart, form a net of
them. The radius stored is the largest distance found, at most that power.

A centre's angle to the query, plus and minus the angle of the covering radius, bounds
all inner products below a node. Search goes best-first by upper bound, for a block of
anchors at once: a node is entered only with the goals whose window ``[low, high]``
meets its bounds and whose k-th best score so far does not exceed its upper bound.
Leaves are verified exactly: integer components whose squared norm stays below 2**52
multiply exactly in doubles. Bounds carry a slack far above rounding errors.

The table is searched twice: the positives of an anchor among its own label, then, with
one window per positive, the negatives among all other labels. Goals travel to the
shards in blocks of ``BLOCK``; a shard is repeated once per block.

Defined results: rows with a null id or label, a null or empty vector, or a null or
non-finite component (also after scaling) take no part; vectors of different lengths are
searched apart; rows that share an anchor's id are not its candidates, other repeated
rows each count; a repeated anchor row gets its lists once per repetition; a negative
positive score has an empty window; ties go to the smaller id; an empty table gives an
empty result; other columns are ignored. A row whose scaled squared norm exceeds 2**52
raises, as its scores would not be exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import written

BASE = 1.3
LEAF = 128
KIDS = 32
#: Children of fewer points share leaves under their parent's centre.
LEAST = 8
SHARD = 8192
BLOCK = 8192

_ROWS = "vec_id long, label long, dim int, v binary"
_PAGES = ("dim int, label long, part int, node int, parent int, level int, radius double, top double, "
          "center binary, ids binary, points binary")
_FOUND = "anchor long, goal int, vec_id long, score long"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part; ``v`` holds floor(256 x) as doubles."""
    for batch in batches:
        column = batch.column("embedding")
        flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(256.0 * flat)
        offsets = column.offsets.to_numpy()
        there = column.is_valid().to_numpy(zero_copy_only=False).copy()
        for c in ("vec_id", "label"):
            there &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
        rows, raw, dims = [], [], []
        for i in np.flatnonzero(there).tolist():
            x = flat[offsets[i]:offsets[i + 1]]
            if not len(x) or not np.isfinite(x).all():
                continue
            if float(x @ x) > 2.0 ** 52:
                raise ValueError(f"row {batch.column('vec_id')[i]}: too long a vector for exact scores")
            rows.append(i)
            raw.append((x + 0.0).tobytes())
            dims.append(len(x))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(dims, pa.int32()),
             pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "v"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def lift(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Points with a further component on a sphere, and its radius (1 at least)."""
    n2 = (x * x).sum(axis=1)
    top2 = max(1.0, float(n2.max()))
    return np.column_stack((x, np.sqrt(np.maximum(0.0, top2 - n2)))), math.sqrt(top2)


def build(points: np.ndarray) -> list[tuple]:
    """Pages ``(parent, level, radius, center, rows)`` of the tree; inner pages have no rows."""
    pages, todo = [], [(np.arange(len(points)), 0, -1)]
    while todo:
        rows, center, parent = todo.pop()
        far = np.sqrt(((points[rows] - points[center]) ** 2).sum(axis=1))
        reach = float(far.max())
        level = math.ceil(math.log(reach, BASE)) if reach > 0 else -(1 << 30)
        node, leaf = len(pages), len(rows) <= LEAF or reach == 0
        pages.append((parent, level, reach, center, rows if leaf else rows[:0]))
        if leaf:
            continue
        # the net one level down; its first centre is the node's own
        step = min(BASE ** (level - 1), reach / 1.0001)
        left, net, loose = rows, center, []
        for _ in range(KIDS):
            d = np.sqrt(((points[left] - points[net]) ** 2).sum(axis=1))
            near = d <= step
            near[np.flatnonzero(left == net)] = True
            if int(near.sum()) >= LEAST:
                todo.append((left[near], net, node))
            else:
                loose.append(left[near])
            left = left[~near]
            if not len(left):
                break
            net = int(left[np.argmax(d[~near])])
        if len(left) > len(rows) // 2:  # points too far apart for a net of this size
            loose.append(left)
        elif len(left):
            todo.append((left, center, node))
        if loose:
            rest = np.concatenate(loose)
            rest = rest[np.argsort(((points[rest] - points[center]) ** 2).sum(axis=1), kind="stable")]
            todo += [(rest[i:i + LEAF], center, node) for i in range(0, len(rest), LEAF)]
    return pages


def _builder(table: pa.Table) -> pa.Table:
    dim, label, part = (table.column(c)[0].as_py() for c in ("dim", "label", "part"))
    ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
    points, top = lift(x)
    parent, level, radius, center, rows = zip(*build(points), strict=True)
    n = len(parent)
    return pa.table({
        "dim": pa.array([dim] * n, pa.int32()), "label": pa.array([label] * n, pa.int64()),
        "part": pa.array([part] * n, pa.int32()), "node": pa.array(range(n), pa.int32()),
        "parent": pa.array(parent, pa.int32()), "level": pa.array(level, pa.int32()),
        "radius": pa.array(radius, pa.float64()), "top": pa.array([top] * n, pa.float64()),
        "center": pa.array([points[c].tobytes() for c in center], pa.binary()),
        "ids": pa.array([ids[r].tobytes() for r in rows], pa.binary()),
        "points": pa.array([x[r].tobytes() for r in rows], pa.binary())})


class Tree:
    """Search over the pages of one shard."""

    def __init__(self, pages: pa.Table):
        pages = pages.sort_by("node")
        self.radius, self.top = pages.column("radius").to_numpy(), float(pages.column("top")[0].as_py())
        self.center = _matrix(pages.column("center"))
        dim = self.center.shape[1] - 1
        self.ids = [np.frombuffer(b, np.int64) for b in pages.column("ids").to_pylist()]
        self.points = [np.frombuffer(b, np.float64).reshape(-1, dim) for b in pages.column("points").to_pylist()]
        parent = pages.column("parent").to_numpy()
        order = np.argsort(parent, kind="stable")
        first, count = np.searchsorted(parent[order], np.arange(len(parent))), np.bincount(parent[1:], minlength=len(parent))
        self.kids = [order[f:f + c] for f, c in zip(first.tolist(), count.tolist(), strict=True)]
        self.verified = 0

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray):
        """Lower and upper bounds of the inner products of ``queries`` with all points below ``nodes``."""
        scale = np.maximum(norms, 1.0)[:, None] * self.top
        cos = np.clip((queries @ self.center[nodes][:, :-1].T) / scale, -1.0, 1.0)
        wide = np.clip(1.0 - self.radius[nodes] ** 2 / (2.0 * self.top ** 2), -1.0, 1.0)[None]
        sines = np.sqrt((1.0 - cos * cos) * (1.0 - wide * wide))
        slack = 1e-6 * (1.0 + scale)
        upper = np.where(cos >= wide, 1.0, cos * wide + sines) * scale + slack
        lower = np.where(cos <= -wide, -1.0, cos * wide - sines) * scale - slack
        return lower, upper

    def search(self, queries: np.ndarray, own: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """The ``k`` best scores and ids within ``[low, high]`` of every goal; ``which`` is its query's row, ``own``
        the query's id. Places not filled hold -inf."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        scores = np.full((len(which), k), -np.inf)
        ids = np.full((len(which), k), np.iinfo(np.int64).max)

        def wanted(goals, lower, upper):
            return (upper >= np.maximum(low[goals], scores[goals, -1])) & (lower <= high[goals])

        heap, pushed = [], 0

        def push(nodes, goals):
            nonlocal pushed
            asked, row = np.unique(which[goals], return_inverse=True)
            lower, upper = self.bounds(queries[asked], norms[asked], nodes)
            for j, node in enumerate(nodes.tolist()):
                keep = wanted(goals, lower[row, j], upper[row, j])
                if keep.any():
                    up = upper[row[keep], j]
                    heapq.heappush(heap, (-float(up.max()), pushed, node, goals[keep], up))
                    pushed += 1

        push(np.array([0]), np.arange(len(which)))
        while heap:
            _, _, node, goals, upper = heapq.heappop(heap)
            goals = goals[upper >= scores[goals, -1]]  # the k-th best may have risen since
            if not len(goals):
                continue
            if len(self.kids[node]):
                push(self.kids[node], goals)
                continue
            asked, row = np.unique(which[goals], return_inverse=True)
            s = (queries[asked] @ self.points[node].T)[row]
            self.verified += len(asked) * len(self.ids[node])
            hit = ((s >= np.maximum(low[goals], scores[goals, -1])[:, None]) & (s <= high[goals][:, None])
                   & (self.ids[node][None] != own[which[goals]][:, None]))
            g, p = np.nonzero(hit)
            if not len(g):
                continue
            touched = np.unique(g)
            at = np.concatenate((goals[g], np.repeat(goals[touched], k)))
            value = np.concatenate((s[g, p], scores[goals[touched]].ravel()))
            name = np.concatenate((self.ids[node][p], ids[goals[touched]].ravel()))
            order = np.lexsort((name, -value, at))
            at, value, name = at[order], value[order], name[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            top = place < k
            scores[at[top], place[top]], ids[at[top], place[top]] = value[top], name[top]
        return scores, ids


def _searcher(k: int) -> Callable:
    """Goals ``(anchor, vec_id, v, scores)``: one per score, its window 80 to 100 percent of it; without scores one
    goal without window."""
    def run(pages: pa.Table, goals: pa.Table) -> pa.Table:
        cols = ([], [], [], [])
        if pages.num_rows and goals.num_rows:
            tree = Tree(pages)
            lists = goals.column("scores").to_pylist()
            which = np.repeat(np.arange(len(lists)), [1 if s is None else len(s) for s in lists])
            high = np.array([x for s in lists for x in ([np.inf] if s is None else s)], np.float64)
            low = np.array([x for s in lists for x in ([-np.inf] if s is None else [-(-4 * p // 5) for p in s])], np.float64)
            number = np.concatenate([np.arange(1 if s is None else len(s)) for s in lists])
            scores, ids = tree.search(_matrix(goals.column("v")), goals.column("vec_id").to_numpy(), which, low, high, k)
            g, place = np.nonzero(np.isfinite(scores))
            cols = (goals.column("anchor").to_numpy()[which[g]], number[g], ids[g, place], scores[g, place])
        return pa.table({n: pa.array(np.asarray(c).astype(t), t) for n, c, t in
                         zip(("anchor", "goal", "vec_id", "score"), cols, ("int64", "int32", "int64", "int64"), strict=True)})
    return run


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``vectors(vec_id, embedding, label)`` whose id is divisible by ``every``."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_usable, _ROWS)
    rows = written(rows.withColumn("anchor", F.monotonically_increasing_id()), "vectors")
    # a few rows: one per vector length and label
    sizes = rows.groupBy("dim", "label").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    sharded = rows.join(sizes, ["dim", "label"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "anchor"), F.col("parts")).cast("int"))
    pages = written(sharded.groupBy("dim", "label", "part").applyInArrow(_builder, _PAGES), "pages")
    anchors = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // BLOCK))
    own = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
    shards = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    many = pages if blocks == 1 else pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "label", "part", "block"]
    many = many if blocks > 1 else many.withColumn("block", F.lit(0))

    def search(goals: DataFrame, k: int) -> DataFrame:
        goals = goals.withColumn("block", own).select(*key, "anchor", "vec_id", "v", "scores")
        return goals.groupBy(*key).cogroup(many.groupBy(*key)).applyInArrow(
            lambda g, p: _searcher(k)(p, g), _FOUND)

    def best(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("anchor", "goal").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    none = F.lit(None).cast("array<long>")
    first = best(search(anchors.join(shards, ["dim", "label"]).withColumn("scores", none), positives), positives)
    # the positives of an anchor, at most ``positives``, in order
    lists = written(first.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct(F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), "score"))).alias("pos")), "positives")
    goals = anchors.join(lists, "anchor").withColumn("scores", F.col("pos.score"))
    others = shards.withColumnRenamed("label", "other")
    goals = (goals.join(others, "dim").where(F.col("other") != F.col("label"))
             .drop("label").withColumnRenamed("other", "label"))
    found = best(search(goals, negatives), negatives)
    return (found.join(lists, "anchor").join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", F.col("pos")[F.col("goal")]["positive_id"].alias("positive_id"),
                    F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    F.col("pos")[F.col("goal")]["score"].alias("positive_score"), F.col("score").alias("negative_score")))
