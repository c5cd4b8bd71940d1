"""Near-duplicate documents and lines against brute force, and the defined edge cases."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpulse.llm.chosen_path import drop_near_duplicates, near_duplicates
from orderpulse.llm.common import components
from orderpulse.llm.fuzzy_lines import dedup_lines, drop_repeated_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid string, label int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in rows], SCHEMA)


def groups_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    g = groups_of(len(rows), links)
    out = {}
    for i, (doc, _) in enumerate(rows):
        out[doc] = (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if g[j] == g[i]))
    return out


def variants(seed, groups, size, changes):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for _ in range(size):
            words = list(base)
            for at in rng.integers(0, 60, rng.integers(0, changes + 1)):
                words[at] = f"c{rng.integers(0, 9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert got[300] == got[299] == 299
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rows = variants(1, 6, 9, 4) + [(1000, None), (1001, ""), (1002, "A b"), (1003, "a  B"), (1004, "x " * 300)]
    # a large group of variants: its nodes exceed the exhaustive size
    rows += [(2000 + i, t) for i, t in variants(2, 1, 70, 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in near_duplicates(docs_of(spark, rows), shingle=4).collect()}
    want = {d: (n, c, d == c) for d, (n, c) in brute_near(rows, 4, 80).items()}
    assert got == want


def test_near_duplicates_edge_cases(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text), (3, text), (None, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(docs_of(spark, rows)).collect())
    assert got == [("3", "3", True), ("5", "3", False), ("5", "3", False), ("None", "3", False), ("None", "None", True)]
    assert near_duplicates(docs_of(spark, []).limit(0)).count() == 0
    kept = drop_near_duplicates(docs_of(spark, [(3, text), (3, text), (9, text), (4, None)]))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def norm(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_lines_are_deduplicated_once_per_group(spark):
    long = " ".join(f"longish{i}word" for i in range(60))
    near = long.replace("longish59word", "other")  # one word of sixty
    rows = [(2, f"alpha beta\n{long}\n\nALPHA, beta!"), (1, f"first line here\n{near}"),
            (3, "alpha beta\nsomething else entirely"), (4, None), (5, ""), (6, "!!!\n...\n!!!")]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got[4] is None and got[5] == "" and got[6] == "!!!\n...\n!!!"
    assert got[3] == "something else entirely"
    assert got[1] == f"first line here\n{near}"
    # the near copy is removed where SimHash puts it within the distance; exact copies always are
    assert got[2] in ("alpha beta\n", f"alpha beta\n{long}\n")
    assert distance(norm(long).split(), norm(near).split()) == 1


def test_exact_line_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"t{x}" for x in rng.integers(0, 10**6, 8)) for _ in range(40)]
    rows = [(i, "\n".join(pool[j] for j in rng.integers(0, 40, 6))) for i in range(50)]
    seen, want = set(), {}
    for i, text in rows:
        left = [line for line in text.split("\n") if not (line in seen or seen.add(line))]
        want[i] = "\n".join(left)
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got == want
    left = {r.doc_id for r in drop_repeated_lines(docs_of(spark, rows)).collect()}
    assert left == {i for i, t in want.items() if t}


def test_lines_edge_cases(spark):
    rows = [(7, "same text here\nsame text here"), (7, "same text here\nsame text here"), (None, "same text here")]
    got = sorted((str(r.doc_id), r.text) for r in dedup_lines(docs_of(spark, rows)).collect())
    assert got == [("7", "same text here"), ("7", "same text here"), ("None", "")]
    assert dedup_lines(docs_of(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_buckets_hold_every_pair_within_the_distance(spark, bits):
    from orderpulse.llm.fuzzy_lines import _bucket_keys
    rng = np.random.default_rng(bits)
    pairs = []
    for _ in range(50):
        x = int(rng.integers(-(1 << 63), 1 << 63))
        y = x
        for b in rng.choice(64, bits, replace=False):
            y ^= (1 << int(b)) if b < 63 else -(1 << 63)
        pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x long, y long")
    meet = F.size(F.array_intersect(_bucket_keys(F.col("x")), _bucket_keys(F.col("y"))))
    assert df.where(meet == 0).count() == 0


def test_similar_lines_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 12))) for _ in range(400)]
    lines = []
    for size in (5, 6, 9, 10, 20, 40):
        for _ in range(8):
            base = list(rng.choice(vocabulary, size))
            lines.append(" ".join(base))
            for changes in (size // 5, size // 5, size // 5 + 1):  # at 0.8, at 0.8 and below
                words = list(base)
                for at in rng.choice(size, changes, replace=False):
                    words[at] = str(rng.choice(vocabulary)) if rng.random() < 0.7 else ""
                lines.append(" ".join(w for w in words if w))
    lines = [lines[i] for i in rng.permutation(len(lines))]
    split = [line.split() for line in lines]
    links = [(i, j) for i, j in combinations(range(len(lines)), 2)
             if distance(split[i], split[j]) <= max(len(split[i]), len(split[j])) * 0.2 + 1e-9]
    group, seen = groups_of(len(lines), links), set()
    want = {i: not (group[i] in seen or seen.add(group[i])) for i in range(len(lines))}
    got = {r.doc_id: r.lines_kept == 1 for r in dedup_lines(docs_of(spark, list(enumerate(lines)))).collect()}
    assert got == want


def test_one_word_of_sixty_goes(spark):
    long = " ".join(f"longish{i}word" for i in range(60))
    near = long.replace("longish59word", "other")
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, [(1, near), (2, f"alpha beta\n{long}")])).collect()}
    assert got == {1: near, 2: "alpha beta"}


def test_common_word_pairs_give_way(spark, monkeypatch):
    from orderpulse.llm import fuzzy_lines
    monkeypatch.setattr(fuzzy_lines, "COMMON", 10)
    rng = np.random.default_rng(9)
    slogan = "internationalisation organisationally"
    lines = [slogan + " " + " ".join(f"v{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(40)]
    rows = list(enumerate(lines)) + [(100 + i, line + " more") for i, line in enumerate(lines)]
    got = {r.doc_id: r.lines_kept for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {**{i: 1 for i in range(40)}, **{100 + i: 0 for i in range(40)}}


def test_near_never_drops_a_link(spark):
    """Lengths and parities are bounds: no pair within the edit distance fails them, most unlike pairs do."""
    from orderpulse.llm.fuzzy_lines import _described, _near
    rng = np.random.default_rng(12)
    rows = []
    for size in (5, 10, 40, 90):
        for _ in range(12):
            base = [f"w{x}" for x in rng.integers(0, 3000, size)]
            near = list(base)
            for at in rng.choice(size, size // 5, replace=False):
                near[at] = f"c{rng.integers(0, 9999)}"
            rows += [" ".join(base), " ".join(near)]
    lines = _described(docs_of(spark, list(enumerate(rows)))).select("doc_id", "n", "p", "q")
    x, y = (lines.select(*[F.col(c).alias(f"{s}_{c}") for c in lines.columns]) for s in ("x", "y"))
    got = x.join(y, F.col("x_doc_id") < F.col("y_doc_id")).select("x_doc_id", "y_doc_id", _near("x_", "y_").alias("ok")).collect()
    assert all(r.ok for r in got if r.y_doc_id == r.x_doc_id + 1 and r.x_doc_id % 2 == 0)
    assert np.mean([r.ok for r in got if r.y_doc_id // 2 != r.x_doc_id // 2]) < 0.05


def test_buckets_are_shuffled_without_text(spark):
    """Bucket rows carry two numbers, and a bucket of one line never becomes a member."""
    from orderpulse.llm.fuzzy_lines import _described, _members
    from orderpulse.llm.common import written
    a = " ".join(f"alpha{i}" for i in range(12))
    lines = written(_described(docs_of(spark, [(1, a), (2, a + " more"), (3, "something else entirely here")])), "lines")
    members = _members(lines)
    assert members.columns == ["key", "line", "lead", "c"]
    found = lines.where("doc_id < 3").select("line").collect()
    assert {(r.line, r.lead) for r in members.collect()} <= {(x.line, y.line) for x in found for y in found}
    assert members.count() > 0


def test_parity_sketch_is_an_exact_bound():
    """Sets differ in at least as many members as their sketches in bits, and in hardly more while few differ."""
    from orderpulse.llm.chosen_path import FINE, _odd_sketch
    rng = np.random.default_rng(5)
    for size, apart in ((1, 1), (50, 6), (150, 33), (150, 60), (4000, 900)):
        base = rng.integers(0, 1 << 63, size + apart, dtype=np.uint64)
        x, y = _odd_sketch(base[:size]), _odd_sketch(base[apart:size + apart])
        assert len(x) == FINE // 64
        differ = sum(int(a ^ b).bit_count() if a ^ b >= 0 else (int(a ^ b) + (1 << 64)).bit_count()
                     for a, b in zip(x.tolist(), y.tolist(), strict=True))
        true = len(set(base[:size].tolist()) ^ set(base[apart:size + apart].tolist()))
        assert differ <= true and (true > 70 or differ >= 0.9 * true)


def test_last_comparisons_of_a_large_group_stay_few(spark, monkeypatch):
    """Near copies around the threshold: sets below it are not confirmed one by one, and no link is lost."""
    from orderpulse.llm import chosen_path
    seen, written = {}, chosen_path.written

    def counted(df, name, **options):
        out = written(df, name, **options)
        seen.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(chosen_path, "written", counted)
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(90):  # 3 to 7 words of 200 changed: pairs at about 0.65 to 0.9
        words = list(base)
        for at in rng.choice(200, rng.integers(3, 8), replace=False):
            words[at] = f"c{rng.integers(0, 99999)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(spark, rows), shingle=4).collect()}
    assert got == brute_near(rows, 4, 80)
    # the leader rounds list one pair a class at most; the last step lists hardly more than the links
    assert seen["pairs"][-1] <= 2 * seen["links"][-1]


def test_fine_parity_bounds_the_edit_distance(spark):
    from orderpulse.llm.fuzzy_lines import FINE, _described, _fine_parity, _near
    rng = np.random.default_rng(13)
    rows = []
    for size in (6, 10, 40, 90):
        for _ in range(10):
            base = [f"w{x}" for x in rng.integers(0, 3000, size)]
            near = list(base)
            for at in rng.choice(size, size // 5, replace=False):
                near[at] = "" if rng.random() < 0.3 else f"c{rng.integers(0, 9999)}"
            far = list(base)
            for at in rng.choice(size, size // 5 + max(2, size // 6), replace=False):
                far[at] = f"d{rng.integers(0, 9999)}"
            rows += [" ".join(base), " ".join(w for w in near if w), " ".join(far)]
    lines = _described(docs_of(spark, list(enumerate(rows)))).cache()
    lines = lines.select("line", "doc_id").join(_fine_parity(lines), "line")
    x, y = (lines.select(*[F.col(c).alias(f"{s}_{c}") for c in lines.columns]) for s in ("x", "y"))
    ok = {(r.x_doc_id, r.y_doc_id): r.ok for r in x.join(y, F.col("x_doc_id") < F.col("y_doc_id"))
          .select("x_doc_id", "y_doc_id", _near("x_", "y_", FINE).alias("ok")).collect()}
    assert all(ok[i, i + 1] for i in range(0, len(rows), 3))
    assert np.mean([ok[i, i + 2] for i in range(0, len(rows), 3)]) < 0.3


def test_common_word_pairs_are_counted_on_all_lines(spark, monkeypatch):
    """No sample and no list of a given length decides which pairs come last, and no link is lost by it."""
    from orderpulse.llm import fuzzy_lines
    assert not {"SAMPLE", "COMMONEST", "_common_pairs"} & set(vars(fuzzy_lines))
    seen, spread = [], fuzzy_lines._spread

    def counted(open_, common, lines, docs):
        seen.append({r.key for r in common.collect()})
        return spread(open_, common, lines, docs)
    monkeypatch.setattr(fuzzy_lines, "COMMON", 8)
    monkeypatch.setattr(fuzzy_lines, "_spread", counted)
    rng = np.random.default_rng(31)
    slogans = [f"internationalisation{i} organisationally{i}" for i in range(3)]
    lines = []
    for i in range(48):
        base = [f"v{x}" for x in rng.integers(0, 10**6, 11)]
        at = int(rng.integers(0, 11))
        near, far = list(base), list(base)
        near[at:at + 1] = [f"c{i}"]
        for j in rng.choice(11, 4, replace=False):
            far[j] = f"d{i}x{j}"
        lines += [f"{slogans[i % 3]} {' '.join(w)}" for w in (base, near, far)]
    lines += [f"{slogans[i]} {slogans[i]} {slogans[i]}" for i in range(3)]  # hardly a pair that is not common
    lines += [f"{slogans[i]} {slogans[i]} {slogans[i]} more" for i in range(3)]
    lines = [lines[i] for i in rng.permutation(len(lines))]
    split = [line.split() for line in lines]
    group, first = groups_of(len(lines), [
        (i, j) for i, j in combinations(range(len(lines)), 2)
        if distance(split[i], split[j]) <= max(len(split[i]), len(split[j])) * 0.2 + 1e-9]), set()
    want = {i: not (group[i] in first or first.add(group[i])) for i in range(len(lines))}
    rows = [(i, line) for i, line in enumerate(lines)] + [(i, line) for i, line in enumerate(lines) if i % 9 == 0]
    got = {r.doc_id: r.lines_kept == 1 for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got == want
    assert seen and all(len(keys) >= 3 for keys in seen)


def test_buckets_are_dealt_out_once(spark, monkeypatch):
    from orderpulse.llm import fuzzy_lines
    a = " ".join(f"alpha{i}" for i in range(12))
    lines = fuzzy_lines.written(fuzzy_lines._described(docs_of(spark, [(1, a), (2, a + " more")])), "lines")
    plans = []

    def ran(df, name, **options):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return df
    monkeypatch.setattr(fuzzy_lines, "written", ran)
    fuzzy_lines._members(lines)
    assert "ReusedExchange" in plans[0]
