"""Vector searches against brute force."""

import numpy as np
import pytest

from orderpulse.llm import mtree, multi_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n, dim=16, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[:copies] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(9000, None, 0), (9020, [float("nan")] * dim, 0), (9040, [None] + [1.0] * (dim - 1), 0), (None, [1.0] * dim, 0)]
    return spark.createDataFrame(rows, SCHEMA), x


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("copies", [0, 300])
def test_mtree_is_exact(spark, copies, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 200)
    df, x = table(spark, 900, copies=copies)
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = by_query(mtree.top_products(df, every=50, k=5).collect())
    ids = np.arange(len(v))
    assert len(got) == 18
    for q in range(0, 900, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert got[q] == [(i, int(s[i])) for i in order]


def test_mtree_avoids_distances():
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 8)) * 50
    x = np.floor(256 * (np.repeat(centers, 200, axis=0) + rng.standard_normal((4000, 8)))).astype(np.int64)
    top2 = float((x * x).sum(axis=1).max())
    import pyarrow as pa
    table_ = pa.table({"shard": pa.array([0] * len(x), pa.int32()), "vec_id": np.arange(len(x)),
                       "v": pa.array([r.tobytes() for r in x], pa.binary())})
    tree = mtree.Tree(mtree._builder(top2)(table_), top2)
    q = int(np.argmax((x * x).sum(axis=1)))
    scores, ids = (a[0] for a in tree.search(np.array([q]), x[q:q + 1], 5, np.array([np.inf])))
    s = x @ x[q]
    s[q] = -(10 ** 15)
    assert ids.tolist() == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
    assert tree.computed < len(x) / 2


def test_mtree_edge_cases(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0), (50, [1.0, 2.0], 0), (51, [1.0], 0), (52, [], 0)], SCHEMA)
    got = by_query(mtree.top_products(df, every=50, k=5).collect())
    assert got == {0: [(50, 0)], 50: [(0, 0)]}
    assert mtree.top_products(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [False, True])
def test_multi_index_recall(spark, scale, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD", 700)
    df, x = table(spark, 2000, dim=32, seed=3)
    if scale:  # norms differ: the inner product is not the cosine
        x = x * np.random.default_rng(1).uniform(0.2, 3, (len(x), 1)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = by_query(multi_index.nearest(df, every=20, k=20).collect())
    hit = total = 0
    for q in range(0, 2000, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        want = set(np.argsort(-s)[:20].tolist())
        assert len(got[q]) == 20 and all(abs(sc - s[i]) < 1e-9 for i, sc in got[q])
        hit, total = hit + len(want & {i for i, _ in got[q]}), total + 20
    assert hit >= 0.9 * total


def test_multi_index_holds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    index = multi_index.SubstringIndex(codes)
    for r in (0, 5, 17, 24, 40):
        want = np.flatnonzero(multi_index.hamming(codes, codes[7]) <= r)
        assert index.within(codes[7], r).tolist() == want.tolist()


def test_multi_index_edge_cases(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (21, [0.0, 0.0], 0), (22, [3.0], 0)], SCHEMA)
    got = by_query(multi_index.nearest(df).collect())
    assert got == {0: [(20, 1.0)], 20: [(0, 1.0)]}
    assert multi_index.nearest(df.limit(0)).count() == 0


def test_mtree_block_equals_single_searches():
    """A block of queries finds what each finds alone, ties to the smaller id included."""
    import pyarrow as pa
    rng = np.random.default_rng(9)
    x = rng.integers(-40, 40, (1500, 6))
    x[700:900] = x[3]
    top2 = float((x * x).sum(axis=1).max())
    table_ = pa.table({"shard": pa.array([0] * len(x), pa.int32()), "vec_id": np.arange(len(x)),
                       "v": pa.array([r.astype(np.int64).tobytes() for r in x], pa.binary())})
    tree = mtree.Tree(mtree._builder(top2)(table_), top2)
    who = np.arange(0, 1500, 7)
    scores, ids = tree.search(who, x[who], 5, np.full(len(who), np.inf))
    for i, q in enumerate(who):
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != q][:5]
        assert ids[i].tolist() == order and scores[i].tolist() == s[order].tolist()


def test_mtree_refuses_vectors_beyond_exact_scores(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 0), (50, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too long a vector"):
        mtree.top_products(df).count()
