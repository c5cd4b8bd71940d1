"""Digest index, tiled collocations and cover-tree mining against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpulse.llm import tiling
from orderpulse.llm.common import scratch_path
from orderpulse.llm.digest_index import DigestIndex, digests, exact_duplicates

DOCS = "doc_id long, text string"


def _sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_exact_duplicates_equal_brute_force(spark):
    rows = [(i, ["a  b", "a\tb", "a b", "c", None, "", " ", "x" * 300_000][i % 8]) for i in range(200)]
    rows += [(500 + i, "hot text") for i in range(400)] + [(-3, "a\nb"), (None, "a b"), (None, "alone"), (7, "x" * 300_000)]
    got = exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[_sha(t)].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, _sha(t)) for i, t in rows)
    assert exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_digest_index_persists_and_appends(spark):
    path = scratch_path(spark, "test-index")
    index = DigestIndex.create(spark, path, 100)
    first = spark.createDataFrame([(5, "a", "x"), (6, "b", "y"), (9, "a ", "z")], "doc_id long, text string, digest string")
    assert sorted(r.doc_id for r in index.new_documents(first, "d1").collect()) == [5, 6, 9]  # "a" and "a " differ
    index.close()
    index = DigestIndex.open(spark, path)  # as a later session would
    second = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c"), (3, "c"), (4, None), (None, "n")], DOCS)
    for _ in range(2):  # a delivery that is run again doubles nothing
        assert sorted((r.doc_id is None, r.doc_id) for r in index.new_documents(second, "d2").collect()) == [
            (False, 2), (False, 4), (True, None)]
        state = {bytes(r.digest).hex(): (r.keep_id, r.copies) for r in index.state().collect()}
        assert state[_sha("a")] == (1, 2) and state[_sha("c")] == (2, 3) and state[_sha("b")] == (6, 1)
    small = index.compact(scratch_path(spark, "test-compact"))
    assert {bytes(r.digest).hex(): (r.keep_id, r.copies) for r in small.state().collect()} == state
    with pytest.raises(ValueError):
        index.add(digests(second), "no'name")


def test_digest_join_reads_the_index_where_it_lies(spark):
    index = DigestIndex.create(spark, scratch_path(spark, "test-plan"), 100)
    index.add(digests(spark.createDataFrame([(1, "a")], DOCS)), "d1")
    groups = digests(spark.createDataFrame([(2, "b")], DOCS)).groupBy("digest").count()
    joined = groups.join(index._table("fresh").select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def brute_collocations(rows, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in cand.items()):
                continue
            cuts = [(1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _collocation_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["É", "New", "york", "w,x", "long" * 40]
    rows = []
    for i in range(60):
        text = " ".join(words[min(int(rng.exponential(8)), len(words) - 1)] for _ in range(120))
        rows.append((["en", "de", None, "und", ""][i % 5], text.replace("w3 ", "new york. ").replace("w7 ", "w7\t w7 ")))
    rows += [("en", None), ("en", ""), ("xx", "..,,\n"), ("en", "new york city " * 3000), ("en", "a" * 200_000)]
    rows += [("hot", "to be or not to be")] * 300
    return rows


@pytest.mark.parametrize("head,gather", [(1 << 20, 4_000_000), (25, 500), (3, 200)])
def test_collocations_equal_brute_force(spark, head, gather, monkeypatch):
    """With every word numbered, and with few numbers (the rest is counted as strings)."""
    monkeypatch.setattr(tiling, "HEAD", head)
    rows = _collocation_rows()
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, w1 string")
    got = tiling.collocations(df.repartition(5), top=30)
    want = [r for r in brute_collocations(rows, top=30)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert tiling.collocations(df.where("false")).count() == 0


def test_tiles_count_both_ways(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = rng.zipf(1.3, 300_000) % 3000, rng.zipf(1.3, 300_000) % 500_000
    want = Counter(zip(left.tolist(), right.tolist()))
    for tile, crowded in ((64, 1 / 8), (64, 100.0), (1024, 0.0)):
        monkeypatch.setattr(tiling, "TILE", tile)
        monkeypatch.setattr(tiling, "CROWDED", crowded)
        got = Counter()
        for t, cells, counts in tiling.count_tiles(left.astype(np.int32), right.astype(np.int32)):
            assert (np.diff(cells) > 0).all() and cells.max() < tiling.tile_cells(t)
            for key, part, n in tiling._split(t, cells, counts, 3):
                assert key // 3 == t
                for a, b, k in zip(*tiling.tile_ranks(t, part), n):
                    got[(int(a), int(b))] += int(k)
        assert got == want
        a = np.array([5, 1, 5, 9]), np.array([1, 2, 3, 4])
        assert [x.tolist() for x in tiling.merge_cells(*a, size=tile * tile)] == [[1, 5, 9], [2, 4, 4]]
    for values in ([0, 1, 5], [2**40, 1], []):
        import pyarrow as pa
        assert tiling._unpacked(pa.py_buffer(tiling._packed(np.array(values, np.int64)))).tolist() == values


def test_partial_tiles_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(tiling, "FAN", 3)
    monkeypatch.setattr(tiling, "SPLIT_WORDS", 3000)
    monkeypatch.setattr(tiling, "TILE", 4)
    rows = _collocation_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(10)
    assert sorted(tuple(r) for r in tiling.collocations(df).collect()) == brute_collocations(rows)


def brute_negatives(rows):
    """rows: (vec_id, vector or None, label or None); one result per distinct anchor id."""
    use = []
    for i, x, label in rows:
        if i is None or x is None or label is None or not len(x) or not all(c is not None and np.isfinite(c) for c in x):
            continue
        use.append((i, [int(np.floor(256 * float(c))) for c in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, x, label in use:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, other == label) for j, y, other in use if j != i and len(y) == len(x)]
        for ps, pid, _ in sorted(t for t in scored if t[2])[:5]:
            inside = sorted(t for t in scored if not t[2] and 80 * -ps <= 100 * -t[0] <= 100 * -ps)[:5]
            out += [(i, pid, r + 1, j, -ps, -s) for r, (s, j, _) in enumerate(inside)]
    return sorted(out)


def _vectors(n, spread, seed=1, dim=16, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, dim))
    x = (centers[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)
    x[n - copies:] = x[0]
    return [(i, v.tolist(), int(rng.integers(0, 10)) if i % 3 else 4) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread,copies,shard,block", [(0.3, 0, 150, 8192), (1.0, 400, 8192, 3), (0.05, 0, 8192, 8192)])
def test_hard_negatives_equal_brute_force(spark, spread, copies, shard, block, monkeypatch):
    from orderpulse.llm import cover_tree
    monkeypatch.setattr(cover_tree, "SHARD", shard)
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = _vectors(1100, spread, copies=copies)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = cover_tree.hard_negatives(df)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_hard_negatives_edge_rows(spark):
    from orderpulse.llm.cover_tree import hard_negatives
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.9, 0.1], 1), (3, [-1.0, 0.0], 1), (4, [0.9, 0.0], 3),
            (4, [0.9, 0.0], 3), (5, None, 1), (6, [float("nan"), 1.0], 2), (8, [None, 1.0], 2), (9, [1.0, 0.0], None),
            (None, [1.0, 0.0], 2), (10, [], 2), (100, [1.0], 5), (101, [1.0], 5), (200, [0.0, 0.0], 2), (11, [1e308, 1.0], 2)]
    schema = "vec_id long, embedding array<double>, label int, dim int, anchor string"
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], schema)
    want = brute_negatives([r for r in rows if r[0] != 11])  # 256e308 is not finite
    assert sorted(tuple(r) for r in hard_negatives(df).collect()) == want and want
    assert hard_negatives(df.where("false")).count() == 0
    assert hard_negatives(df.where("vec_id = 200")).count() == 0
    long = spark.createDataFrame([(1, [1e9, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too long a vector"):
        hard_negatives(long).count()


def test_cover_tree_radii_and_pruning():
    from orderpulse.llm import cover_tree
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.standard_normal((40, 8)) * 4, 100, axis=0) + 0.1 * rng.standard_normal((4000, 8))))
    points, _ = cover_tree.lift(x)
    pages = cover_tree.build(points)
    seen = np.concatenate([p[4] for p in pages])
    assert sorted(seen.tolist()) == list(range(4000))
    below = [set(p[4].tolist()) for p in pages]
    for node in range(len(pages) - 1, 0, -1):
        below[pages[node][0]] |= below[node]
    for (_, level, radius, center, _), rows in zip(pages, below):
        far = np.sqrt(((points[sorted(rows)] - points[center]) ** 2).sum(axis=1)).max()
        assert far <= radius + 1e-6 and (radius == 0 or radius <= cover_tree.BASE ** level * (1 + 1e-9))
    import pyarrow as pa
    table = pa.table({"dim": pa.array([8] * 4000, pa.int32()), "label": pa.array([1] * 4000), "part": pa.array([0] * 4000, pa.int32()),
                      "vec_id": np.arange(4000), "v": pa.array([r.tobytes() for r in x], pa.binary())})
    tree = cover_tree.Tree(cover_tree._builder(table))
    q = x[:1]
    top = float((x @ q[0]).max())
    scores, ids = tree.search(q, np.array([-1]), np.array([0, 0]), np.array([-np.inf, 0.4 * top]), np.array([np.inf, 0.5 * top]), 5)
    s = x @ q[0]
    for g, (lo, hi) in enumerate([(-np.inf, np.inf), (0.4 * top, 0.5 * top)]):
        inside = np.flatnonzero((s >= lo) & (s <= hi))
        order = inside[np.lexsort((inside, -s[inside]))][:5]
        assert ids[g][:len(order)].tolist() == order.tolist()
    assert tree.verified < len(x) / 2
