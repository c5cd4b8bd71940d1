"""Packing, archives, licences, toxicity, sharding, mixing and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpulse.llm import license_rules, maglev, packing, pivotal_mix, toxicity, warc
from orderpulse.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


# ---- packing

def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    fast = packing.WordEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng, marks = random.Random(3), [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "a", "Éb", "l'été", "don't",
                                    "12", "!?", "日本", "🙂", "\x1c", "\x85", ""]
    texts = ["", " ", "a", "a b\nc d.", "<|endoftext|> x", "I'll  go", " lead", "trail "]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for text, raw in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_only_runs_of_whitespace_take_the_lookahead():
    import public_tokenizers as P
    fast = packing.WordEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
    runs = [f"ab{x}{y}c" for x in spaces for y in spaces] + [f"ab{x}{y}" for x in spaces for y in spaces]
    single = [f"{x}ab{x}cd{x}12{x}!{x}é{x}" for x in [*spaces, "\x1c", "\u200b", "\u180e"]]
    slow, fast.single = fast.single, None          # texts with a run never reach the shorter pattern
    want = [np.array(fast.full.encode_ordinary(x), "<u4").tobytes() for x in runs]
    assert fast.encode(runs) == want
    full, fast.single, fast.full = fast.full, slow, None
    assert fast.encode(single) == [np.array(full.encode_ordinary(x), "<u4").tobytes() for x in single]
    assert packing.WordEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN + "|x").encode(["a  x b"])


def check_pieces(rows, want, window=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for doc, pieces in by_doc.items():
        ids = []
        for start, part, total in sorted(pieces):
            assert start == len(ids) and total == len(want[doc])
            ids += part
        assert ids == want[doc]
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return by_seq


def test_packing_places_every_id_once(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 5000)], "doc_id long, text string"))
    want = {r.doc_id: slow.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shard_docs=60).collect()
    by_seq = check_pieces(rows, want)
    total = sum(len(x) for x in want.values())
    assert len(by_seq) * 1024 - total <= 0.05 * total
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_seed_windows_take_the_best_scoring_unused_neighbours():
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.integers(1 + 500 * (i % 3), 500 + 500 * (i % 3), 100).astype(np.uint16), 100) for i in range(30)]
    idf = np.full(2000, 1.0)
    first = [p[0] for p in packing.pack_shard(rows, idf, 100.0, 1000) if p[3] == 0]
    index = packing.Bm25Shard([r[2] for r in rows], idf, 100.0)
    free = np.ones(30, bool)
    free[0] = False
    # ten tails of a window of 1000: the seed, then its neighbours by BM25 score (all of its topic)
    assert first == [0, *index.neighbours(0, free, 64).tolist()[:9]]
    assert {i % 3 for i in first} == {0}


def test_neighbours_score_as_a_sum_over_the_seeds_terms():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint16) for _ in range(80)]
    for d in docs:
        want = np.unique(d, return_counts=True)
        assert all((a == b).all() for a, b in zip(packing._distinct(d), want, strict=True))
    idf = rng.random(300)
    index = packing.Bm25Shard(docs, idf, 100.0)
    free = rng.random(80) < 0.7
    for seed in range(80):
        score = np.zeros(80)
        for t in index.queries[seed]:
            for i, d in enumerate(docs):
                tf = int((d == t).sum())
                score[i] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 100.0)) if tf else 0.0
        want = sorted((i for i in range(80) if free[i] and score[i] > 0), key=lambda i: (-score[i], i))
        assert index.neighbours(seed, free, 80).tolist() == want


# ---- archives

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compress", [True, False])
def test_archive_round_trip(spark, tmp_path, compress):
    big = "<p>été</p>" * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b", "small"), (3, None, big), (4, "http://c", None),
            (5, "http://d", "small"), (6, "http://e", "a\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08 b"), (None, "u", big)]
    path = str(tmp_path / "w")
    warc.write(pages(spark, rows), path, compress=compress)
    read = warc.read(spark, path).collect()
    assert not [r for r in read if r.kind == "gap"]
    got = {r.page_id: r for r in read}
    assert {i: got[i].kind for i in got} == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response",
                                             6: "response", None: "revisit"}
    assert got[1].refers_to == 3 and got[None].refers_to == 3
    for i, _, html in rows:
        if got[i].kind == "response":
            assert bytes(got[i].payload).decode() == (html or "")
    df = warc.read(spark, path).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    out = {r.page_id: r for r in warc.resolve(df).collect()}
    assert out[1].payload_bytes == out[None].payload_bytes == len(big.encode())
    assert out[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    if compress:  # every file is a valid gzip stream of records
        for f in (tmp_path / "w").glob("part-*"):
            gzip.decompress(f.read_bytes())
    warc.write(pages(spark, rows).limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_every_record_around_damage(compress):
    def record(i):
        body = f"payload {i} ".encode() * 50
        raw = warc.record_bytes(i, "http://x", body, hashlib.sha1(body).hexdigest(), None, "2024-01-01T00:00:00Z")
        return gzip.compress(raw, mtime=0) if compress else raw
    parts = [record(i) for i in range(20)]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    whole = b"".join(parts)
    for seed in range(30):
        rng = random.Random(seed)
        data, hurt = bytearray(whole), set()
        for _ in range(3):
            at = rng.randrange(len(data))
            data[at] ^= 0xFF
            hurt.add(max(i for i in range(20) if starts[i] <= at))
        found = list(warc.salvage(bytes(data)))
        ids = [x[1] for _, _, x in found if not isinstance(x, str)]
        # a plain record's header has no checksum: damage there can change its fields, not those of others
        assert sorted(i for i in ids if i is not None and i not in hurt) == sorted(set(range(20)) - hurt)
        covered = sorted((a, b) for a, b, _ in found)
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
    cut = list(warc.salvage(whole[:starts[5] + 10]))
    assert [x[1] for _, _, x in cut[:5]] == list(range(5)) and cut[-1][:2] == (starts[5], starts[5] + 10)


# ---- licences

def test_licence_rules(spark):
    mit = " ".join(t + "." for n, t in license_rules.SENTENCES[:4])
    wrapped = mit.replace(" to deal", "\nto deal").replace("copyright holders", "COPYRIGHT\nHOLDERS")
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + wrapped, "s"), (2, "foo bar\nLicensed under CC BY-NC 4.0.", "s"),
            (3, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "s"), (4, None, "s"),
            (5, "See the GNU General Public License for more details.", "s"), (6, "", None)]
    got = {r.doc_id: r for r in license_rules.scan(docs_of(spark, rows)).collect()}
    assert [got[i].licenses for i in range(1, 7)] == ["MIT", "CC-BY-NC-4.0", "Apache-2.0,MIT", "", "", ""]
    assert got[1].copyrights == 1 and got[1].sentences == 4 and got[5].unmatched == "GplSee"
    assert license_rules.scan(docs_of(spark, rows).limit(0)).count() == 0


# ---- toxicity

def test_machine_learns_a_pair_that_weights_miss():
    rng = np.random.default_rng(0)
    terms = np.arange(40, dtype=np.uint32)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([0] * int(a) + [1] * int(b) + rng.choice(np.arange(2, 40), 4, replace=False).tolist(), np.int64))
        y.append(float(a == b))  # neither term alone tells anything
    model = toxicity.fit_machine(rows, np.array(y), terms)
    right = np.mean([(model.score(r) >= 0.5) == bool(t) for r, t in zip(rows, y, strict=True)])
    assert right > 0.95


def test_toxicity_holds_out_and_scores_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = toxicity.held_out()
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    second = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert {k: v.score for k, v in first.items()} == second  # held-out labels are never read
    truth = [(first[r.doc_id].predicted, r.toxic) for r in labels.join(docs, "doc_id").where(held).collect()]
    assert sum(p == t for p, t in truth) >= 0.95 * len(truth)
    assert sum(p > t for p, t in truth) <= 1
    more = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    row = toxicity.toxicity(more, labels).first()
    assert row.held_out is False and 0 <= row.score <= 1
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


# ---- sharding

def test_lookup_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(10)]
    t = maglev.lookup_table(shards, 10_007)
    counts = np.bincount(t)
    assert counts.max() - counts.min() <= 1
    # brute force: turns by turn, each shard's most preferred free slot
    want, at = {}, [0] * 10
    while len(want) < 10_007:
        for i, s in enumerate(shards):
            o, k = maglev.preferences(s, 10_007)
            while (o + at[i] * k) % 10_007 in want:
                at[i] += 1
            want[(o + at[i] * k) % 10_007] = i
            if len(want) == 10_007:
                break
    assert [want[i] for i in range(10_007)] == t.tolist()
    fewer = maglev.lookup_table(shards[:-1], 10_007)
    assert np.mean((t != fewer) & (t != 9)) < 0.2
    with pytest.raises(ValueError):
        maglev.lookup_table(shards, 10_000)


def test_placement_edge_cases(spark):
    df = spark.createDataFrame([(None, 1, "x"), (5, 2, "x"), (5, 3, "x")], "doc_id long, slot int, shard string")
    got = maglev.place(df, "doc_id", ["a", "b"], 11).collect()
    assert len(got) == 3 and len({(r.slot, r.shard) for r in got if r.doc_id == 5}) == 1
    table = maglev.lookup_table(["a", "b"], 11)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 11
        assert r.shard == ["a", "b"][table[r.slot]]


# ---- mixing

def brute_targets(sizes, weights, share, cap):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap * sizes[s] + 1e-9}
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", "Z", "é", None][int(rng.integers(0, 5))])
            for i in range(900)]
    rows += [(0, "twin words", "a"), (0, "twin words", "a"), (None, "x y", "b"), (None, None, None)]
    docs = docs_of(spark, rows)
    got = pivotal_mix.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= 40
    assert all(r.taken <= 2 * r.size for r in got)
    again = pivotal_mix.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.h, r.k, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert pivotal_mix.take(docs).count() == sum(r.copies for r in got)
    assert pivotal_mix.mix(docs.limit(0)).count() == 0


def test_rounding_keeps_expectations(spark):
    rows = [(i, "w " * (1 + i % 7), "s") for i in range(60)] + [(1000 + i, "w", "t") for i in range(30)]
    docs, mean = docs_of(spark, rows), {}
    for seed in range(12):
        for r in pivotal_mix.mix(docs, share=1.0, weights=(1, 1), seed=seed).collect():
            mean.setdefault(r.source, []).append(r.copies)
    targets = brute_targets({"s": sum(1 + i % 7 for i in range(60)), "t": 30}, (1, 1), 1.0, 2.0)
    assert abs(np.mean(mean["s"]) - targets["s"] / sum(1 + i % 7 for i in range(60))) < 0.05
    assert abs(np.mean(mean["t"]) - targets["t"] / 30) < 0.05


# ---- pipeline and registry

def test_registry_has_every_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
    assert {n.split("_")[0] for n in SQL} >= {"op2", "op5", "op9", "op10"}


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from orderpulse.llm.chosen_path import near_duplicates
    from orderpulse.llm.common import written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        out[name] = (before, docs)
    scored = {r.doc_id for r in toxicity.toxicity(out["toxicity"][0], labels).where("predicted = 1").collect()}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids(out["toxicity"][1])) == sorted(set(ids(out["toxicity"][0])) - scored)
    before, after = out["minhash_near_dedup"]
    blank = {r.doc_id for r in near_duplicates(before).where("n_shingles = 0").collect()}
    kept = {r.doc_id for r in near_duplicates(before).where("kept").collect()}
    assert set(ids(after)) == kept | blank
    for name in ("toxicity", "line_dedup", "minhash_near_dedup", "source_mix"):
        assert out[name][1].columns == columns
    before, after = out["source_mix"]
    taken = {r.doc_id: r.copies for r in pivotal_mix.mix(before).collect()}
    counts = {}
    for i in ids(after):
        counts[i] = counts.get(i, 0) + 1
    assert counts == {i: c for i, c in taken.items() if c}
    before, after = out["packing"]
    assert set(ids(after)) == set(ids(before))


@pytest.mark.parametrize("n,words,share", [(2000, 3, 1.5), (500, 1, 1.5), (400, 4, 0.75), (300, 2, 1.3)])
def test_mix_of_equal_rows_meets_its_target(spark, n, words, share):
    """Equal sizes with fractions 1/2, 3/4, 3/10: a pair's masses often vanish together."""
    from orderpulse.llm.pivotal_mix import mix
    df = spark.createDataFrame([(i, " ".join(["w"] * words), "s") for i in range(n)], "doc_id long, text string, source string")
    r = mix(df, share=share).agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.max("copies").alias("c")).first()
    assert abs(r["t"] - r["x"]) <= words and r["c"] <= 2


def test_mix_of_copies_of_one_row(spark):
    from orderpulse.llm.pivotal_mix import mix
    df = spark.range(70_000).select(F.lit(1).alias("doc_id"), F.lit("two words").alias("text"), F.lit("s").alias("source"))
    r = mix(df).agg(F.sum("taken").alias("t"), F.count("*").alias("n"), F.max("k").alias("k")).first()
    assert (r["n"], r["k"]) == (70_000, 70_000) and abs(r["t"] - 210_000) <= 2


def test_licence_of_repeated_and_widely_set_rows(spark):
    """Repeated rows give the licence of one; decoration does not hide a sentence."""
    from orderpulse.llm import license_rules as R
    text = "\n".join(t for name, t in R.SENTENCES if name.startswith("Mit"))
    wide = text.replace(" ", " " * 40)
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, wide), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.licenses, r.sentences) for r in R.scan(df).collect()]
    one = next(x for x in got if x[0] == 2)
    assert "MIT" in one[1] and sorted(got)[:2] == [(1, *one[1:])] * 2 and (3, *one[1:]) in got and (4, "", 0) in got


def test_stages_leave_other_columns_alone(spark):
    """Columns named like those the operators make come back as they were."""
    from orderpulse.llm.fuzzy_lines import drop_repeated_lines
    from orderpulse.llm.toxicity import drop_toxic
    rows = [(i, f"first line of text number {i}\nshared line that every document repeats", 7, 8.5, "x") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines int, score double, __gone string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for out in (drop_repeated_lines(df), drop_toxic(df, labels)):
        assert out.columns == df.columns
        assert {(r["lines"], r["score"], r["__gone"]) for r in out.collect()} == {(7, 8.5, "x")}


@pytest.mark.parametrize("name", ["op3_fuzzy_line_dedup", "op5_license_sentence_rules", "op8_pivotal_source_mix"])
def test_native_operators_run_no_python(spark, name, monkeypatch):
    """Every plan that a [native] operator executes, intermediate tables included."""
    import __spark_entry__ as E
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter
    from tests.conftest import SF_SMALL
    plans = []

    def noting(method, frame):
        def run(self, *args, **kwargs):
            plans.append(frame(self)._jdf.queryExecution().executedPlan().toString())
            return method(self, *args, **kwargs)
        return run
    monkeypatch.setattr(DataFrameWriter, "parquet", noting(DataFrameWriter.parquet, lambda w: w._df))
    monkeypatch.setattr(DataFrame, "checkpoint", noting(DataFrame.checkpoint, lambda d: d))
    out = E.queries()[name](spark, SF_SMALL)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any(word in p for p in plans for word in ("Python", "InPandas", "InArrow", "CoGroup"))

