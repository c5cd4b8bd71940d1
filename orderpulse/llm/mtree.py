"""Exact top-k inner products by M-tree best-first search.

Integer vectors get one more component that makes their norms equal, so the
largest inner product is the smallest Euclidean distance. The table is cut into
metric shards: each row goes to the nearest of some routing objects drawn from a
bounded sample, and a routing object's rows are split by hash into shards of
about ``SHARD`` rows, so copies of one vector never meet in one task. Each shard
holds an M-tree of pages (at most ``PAGE`` entries): a page stores its routing
object, its covering radius and its distance to the parent's routing object;
leaf entries store their distance to the leaf's routing object.

A query searches its own shard first; its k-th best distance there prunes whole
shards (distance to the routing object minus covering radius). In a shard, pages
are visited best-first by lower bound. Distances to pages and entries are left
uncomputed where the stored parent distance and the triangle inequality already
show that they cannot beat the k-th best. Bounds carry a slack far above rounding
errors, so the result is exact, ties included.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part; zero vectors do; vectors of
different lengths are searched apart; rows that share an id are candidates of
each other only as far as their ids differ; an empty table gives an empty
result. A row whose scaled squared norm exceeds 2**52 raises, as its scores would not
be exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import written
from orderpulse.llm.vectors import ROWS, matrix, merge, usable_vectors

PAGE = 256
BRANCH = 12
SHARD = 8192
BLOCK = 512
SAMPLE = 4096
ROUTES = 256
_ROUTED = "vec_id long, v binary, route int, far double"
_NODES = ("shard int, node int, parent int, radius double, parent_far double, center binary, "
          "ids binary, points binary, far binary")
_FOUND = "query_id long, vec_id long, score long, v binary, shard int"
_GOALS = "vec_id long, v binary, home int, kth double, shard int"


def lift(x: np.ndarray, top2: float) -> np.ndarray:
    """Points on a sphere of squared radius ``top2``."""
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(0.0, top2 - (x * x).sum(axis=1)))))


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((points - q) ** 2).sum(axis=1)))


def slack(top2: float) -> float:
    return 1e-6 * (1.0 + top2 ** 0.5)


def build(points: np.ndarray, seed: int = 1):
    """Pages ``(node, parent, radius, parent_far, center, members, far)`` of the tree over lifted points;
    inner pages have no members."""
    rng = np.random.default_rng(seed)
    pages, todo = [], [(np.arange(len(points)), -1, None)]
    while todo:
        rows, parent, up = todo.pop()
        own = points[rows]
        middle = own.mean(axis=0)
        center = own[int(np.argmin(((own - middle) ** 2).sum(axis=1)))]
        far = distances(own, center)
        node = len(pages)
        leaf = len(rows) <= PAGE
        up_far = 0.0 if up is None else float(distances(center[None], up)[0])
        pages.append((node, parent, float(far.max()), up_far, center, rows if leaf else rows[:0],
                      far if leaf else far[:0]))
        if leaf:
            continue
        picks = own[rng.choice(len(rows), min(BRANCH, len(rows)), replace=False)]
        near = np.argmin(((own ** 2).sum(axis=1)[:, None] - 2 * own @ picks.T) + (picks ** 2).sum(axis=1), axis=1)
        parts = [np.flatnonzero(near == j) for j in range(len(picks))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # copies of one point: pages by position
            parts = np.array_split(np.arange(len(rows)), -(-len(rows) // PAGE))
        todo += [(rows[p], node, center) for p in parts]
    return pages


class Tree:
    """Search over the pages of one shard, for a block of queries at once."""

    def __init__(self, table: pa.Table, top2: float):
        order = np.argsort(table.column("node").to_numpy())
        table = table.take(pa.array(order))
        self.radius, self.up_far = table.column("radius").to_numpy(), table.column("parent_far").to_numpy()
        self.center = matrix(table, np.float64, "center")
        children: dict[int, list[int]] = {}
        for node, parent in enumerate(table.column("parent").to_pylist()):
            children.setdefault(parent, []).append(node)
        self.children = {k: np.array(v) for k, v in children.items()}
        dim = self.center.shape[1] - 1
        self.ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        # whole numbers whose products stay below 2**53 multiply exactly as doubles
        self.points = [np.frombuffer(x, np.int64).reshape(-1, dim).astype(np.float64)
                       for x in table.column("points").to_pylist()]
        self.far = [np.frombuffer(x, np.float64) for x in table.column("far").to_pylist()]
        self.top2, self.slack, self.computed = top2, slack(top2), 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray):
        """Scores and ids of the k best of every query (-inf where there are fewer); ``kth`` holds distances that
        the k-th best are known not to exceed.

        Pages are visited best-first by the smallest lower bound of their queries; a page goes on with those queries
        only that it can still serve."""
        queries, kth = queries.astype(np.float64), kth.astype(np.float64).copy()
        reach2 = (queries * queries).sum(axis=1) + self.top2
        scores = np.full((len(queries), k), -np.inf)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)

        def distance(goals, nodes):  # all points lie on one sphere, queries have no further component
            product = queries[goals] @ self.center[nodes][:, :-1].T
            return np.sqrt(np.maximum(0.0, reach2[goals][:, None] - 2.0 * product))

        everyone = np.arange(len(queries))
        root = distance(everyone, np.array([0]))[:, 0]
        heap, pushed = [(float((root - self.radius[0]).min(initial=0.0)), 0, 0, everyone, root, root - self.radius[0])], 1
        while heap:
            _, _, node, goals, d, bound = heapq.heappop(heap)
            keep = bound <= kth[goals] + self.slack  # the k-th best may have come closer since
            goals, d, bound = goals[keep], d[keep], bound[keep]
            if not len(goals):
                continue
            limit = (kth[goals] + self.slack)[:, None]
            kids = self.children.get(node)
            if kids is not None:
                # the triangle inequality over the parent's routing object, before any distance is computed
                near = np.abs(d[:, None] - self.up_far[kids]) - self.radius[kids] <= limit
                kids, near = kids[near.any(axis=0)], near[:, near.any(axis=0)]
                ds = distance(goals, kids)
                self.computed += int(near.sum())
                near &= ds - self.radius[kids] <= limit
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    at = near[:, j]
                    low = np.maximum(bound[at], ds[at, j] - self.radius[kids[j]])
                    heapq.heappush(heap, (float(low.min()), pushed, int(kids[j]), goals[at], ds[at, j], low))
                    pushed += 1
                continue
            near = np.abs(d[:, None] - self.far[node]) <= limit
            near &= self.ids[node][None] != query_ids[goals][:, None]
            self.computed += int(near.sum())
            rows = near.any(axis=0)
            s = queries[goals] @ self.points[node][rows].T
            g, p = np.nonzero(near[:, rows] & (s >= scores[goals, -1][:, None]))
            if not len(g):
                continue
            touched = np.unique(g)
            at = np.concatenate((goals[g], np.repeat(goals[touched], k)))
            value = np.concatenate((s[g, p], scores[goals[touched]].ravel()))
            name = np.concatenate((self.ids[node][rows][p], ids[goals[touched]].ravel()))
            order = np.lexsort((name, -value, at))
            at, value, name = at[order], value[order], name[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            top = place < k
            scores[at[top], place[top]], ids[at[top], place[top]] = value[top], name[top]
            full = np.isfinite(scores[goals, -1])
            goals = goals[full]
            kth[goals] = np.minimum(kth[goals], np.sqrt(np.maximum(0.0, reach2[goals] - 2.0 * scores[goals, -1])))
        return scores, ids


def _router(routes: np.ndarray, top2: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lift(matrix(pa.Table.from_batches([batch]), np.int64), top2)
            d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ routes.T + (routes * routes).sum(axis=1)
            route = np.argmin(d2, axis=1)
            far = np.sqrt(((x - routes[route]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"),
                                              pa.array(route, pa.int32()), pa.array(far)],
                                             names=["vec_id", "v", "route", "far"])
    return run


def _builder(top2: float):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, x = table.column("vec_id").to_numpy(), matrix(table, np.int64)
        pages = build(lift(x, top2), seed=shard + 1)
        node, parent, radius, up, center, rows, far = zip(*pages, strict=True)
        return pa.table({
            "shard": pa.array([shard] * len(pages), pa.int32()), "node": pa.array(node, pa.int32()),
            "parent": pa.array(parent, pa.int32()), "radius": pa.array(radius, pa.float64()),
            "parent_far": pa.array(up, pa.float64()), "center": pa.array([c.tobytes() for c in center], pa.binary()),
            "ids": pa.array([ids[r].tobytes() for r in rows], pa.binary()),
            "points": pa.array([x[r].tobytes() for r in rows], pa.binary()),
            "far": pa.array([f.tobytes() for f in far], pa.binary())})
    return run


def _searcher(top2: float, k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        cols = [[], [], [], [], []]
        if pages.num_rows and queries.num_rows:
            tree = Tree(pages, top2)
            who, raw = queries.column("vec_id").to_numpy(), queries.column("v").to_pylist()
            home = queries.column("home").to_numpy()
            scores, ids = tree.search(who, matrix(queries, np.int64), k, queries.column("kth").to_numpy())
            q, place = np.nonzero(np.isfinite(scores))
            # a query that finds nothing in its own shard still has to visit the others
            none = np.flatnonzero(~np.isfinite(scores[:, 0]) & (home == queries.column("shard")[0].as_py()))
            cols = [np.concatenate((who[q], who[none])), [*ids[q, place].tolist(), *[None] * len(none)],
                    [*scores[q, place].astype(np.int64).tolist(), *[None] * len(none)],
                    [raw[i] for i in (*q.tolist(), *none.tolist())], np.concatenate((home[q], home[none]))]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        return pa.table({n: pa.array(c, t) for n, c, t in
                         zip(("query_id", "vec_id", "score", "v", "shard"), cols, types, strict=True)})
    return run


def _goals(centers: np.ndarray, radii: np.ndarray, top2: float):
    """Shards other than its own that may still hold a better row, per query."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(pa.Table.from_batches([batch]), np.int64).astype(np.float64)
            q = np.column_stack((q, np.zeros(len(q))))
            d2 = (q * q).sum(axis=1)[:, None] - 2 * q @ centers.T + (centers * centers).sum(axis=1)
            bound = np.sqrt(np.maximum(0.0, d2)) - radii
            kth, home = batch.column("kth").to_numpy(), batch.column("home").to_numpy()
            row, shard = np.nonzero(bound <= kth[:, None] + slack(top2))
            other = shard != home[row]
            row, shard = row[other], shard[other]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(row)) for c in ("vec_id", "v", "home", "kth")],
                 pa.array(shard, pa.int32())], names=["vec_id", "v", "home", "kth", "shard"])
    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of floor(256 x) for the rows
    of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``, each against all other rows."""
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                  F.col("embedding").cast("array<double>").alias("embedding"))
                   .mapInArrow(usable_vectors(True), ROWS), "integers")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim, n in sorted(rows.groupBy("dim").count().collect()):
        own = rows.where(F.col("dim") == dim)
        top2 = float(own.mapInArrow(_norms2, "n2 long").agg(F.max("n2")).first()[0])
        sample = lift(matrix(own.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow(), np.int64), top2)
        routes = sample[:max(1, min(ROUTES, len(sample), -(-n // SHARD)))]
        routed = written(own.select("vec_id", "v").mapInArrow(_router(routes, top2), _ROUTED), "routed")
        # a routing object's rows go to as many shards as they need; at most ROUTES rows are collected here
        sizes = sorted(routed.groupBy("route").count().collect())
        parts = {r: -(-c // SHARD) for r, c in sizes}
        first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
        plan = F.broadcast(spark.createDataFrame([(r, first[r], parts[r]) for r in parts],
                                                 "route int, first int, parts int"))
        routed = (routed.join(plan, "route")
                  .withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")))
        pages = written(routed.select("shard", "vec_id", "v").groupBy("shard").applyInArrow(_builder(top2), _NODES),
                        "pages")
        root = pages.where("parent = -1").select("shard", "radius", "center").toArrow().to_pylist()
        shards = max(r["shard"] for r in root) + 1
        centers, radii = np.zeros((shards, dim + 1)), np.full(shards, -np.inf)
        for r in root:  # one row per shard: n / SHARD rows
            centers[r["shard"]], radii[r["shard"]] = np.frombuffer(r["center"]), r["radius"]
        blocks = max(1, -(-n // every // BLOCK))

        def searched(goals, own_pages=pages, top2=top2, blocks=blocks):
            goals = goals.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
            many = own_pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            return (many.groupBy("shard", "block").cogroup(goals.groupBy("shard", "block"))
                    .applyInArrow(_searcher(top2, k), _FOUND))

        start = (routed.where(F.col("vec_id") % every == 0)
                 .select("vec_id", "v", F.col("shard").alias("home"), F.lit(float("inf")).alias("kth"), "shard"))
        home = written(searched(start), "home")
        kth = home.groupBy("query_id", "v", "shard").agg(F.count("score").alias("c"), F.min("score").alias("s"))
        goals = kth.mapInArrow(_kth(top2, k), "vec_id long, v binary, home int, kth double").mapInArrow(
            _goals(centers, radii, top2), _GOALS)
        rest = searched(goals)
        found = home.unionByName(rest).where("vec_id is not null").select("query_id", "vec_id", "score")
        out = out.unionByName(merge(found, k))
    return out


def _kth(top2: float, k: int):
    """Distance of the k-th best score of each query so far (infinite while there are fewer)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(pa.Table.from_batches([batch]), np.int64).astype(np.float64)
            s = batch.column("s").to_numpy(zero_copy_only=False).astype(np.float64)
            d = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + top2 - 2 * np.nan_to_num(s)))
            kth = np.where(batch.column("c").to_numpy() >= k, d, np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), batch.column("shard"),
                                              pa.array(kth)], names=["vec_id", "v", "home", "kth"])
    return run


def _norms2(batches):
    for batch in batches:
        if batch.num_rows:
            x = matrix(pa.Table.from_batches([batch]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int((x * x).sum(axis=1).max())], pa.int64())], names=["n2"])
