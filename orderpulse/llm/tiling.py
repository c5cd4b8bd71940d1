"""Phrase collocations counted by direct-address tiling.

Words of a language are numbered by falling frequency. A pair of numbers is a cell of
a square grid cut into tiles: bands of ``TILE``, then as many again, then twice as many
and so on, both ways. Frequencies fall about as fast as bands widen, so tiles carry
comparable loads and there are few of them, however many words have numbers. Each task
counts its own occurrences tile by tile: a crowded tile with a dense numpy ``bincount``
over its direct addresses, the others as sorted coordinates with counts (COO). Tiles
then meet in rounds of ``FAN`` partial tiles, so a tile that every task has never
gathers in one of them; sums go the same two ways, and a tile of a very large corpus is
split by cell. Pairs that reach the least count are numbered anew by falling frequency,
and (pair, word) cells are counted by the same code; that is the recursion to longer
phrases.

Numbers are given to the ``HEAD`` most frequent words (pairs) only, so what is sent to
the tasks has a fixed bound. While every word that reaches the least count has a
number, an occurrence without numbers cannot belong to a candidate. Otherwise such
occurrences are counted exactly as strings, by an ordinary grouped sum.

Defined results: a null text is empty, a null lang is ``und``; texts without words give
nothing; a repeated row counts again; ids are not read; other columns are ignored; a text
is taken whole, memory grows with the largest one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import chunks, text_buffer, written

TILE = 1024
BANDS = 64
#: Occurrences a task gathers before it counts them.
GATHER = 1_000_000
#: Text bytes cut into words at a time (one text at least).
CHUNK = 1 << 21
#: Cells a row of partial counts holds.
ROW_CELLS = 1 << 16
#: Partial tiles (by task) that one step of a round sums.
FAN = 64
#: Words and pairs with a number, and the longest word with one (bytes).
HEAD = 1 << 20
HEAD_BYTES = 64
#: Share of a tile that must be filled for the dense count, and the largest tile counted so.
CROWDED = 1 / 8
DENSE_CELLS = 1 << 22
#: Words of the corpus per split of its tiles: what one task sums stays bounded.
SPLIT_WORDS = 1 << 30

_CELLS = "lang string, tile long, part int, cells binary, counts binary, phrase string, c long"
_SPACE, _BREAK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Words of some rows in order: ``codes`` into ``words``, ``lang`` numbers into ``langs``, and whether
    a word and the next one stand in the same piece (``linked``)."""

    def __init__(self, batch: pa.RecordBatch):
        lang = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        data, at = text_buffer(batch.column("text"))
        data = _LOWER[data]
        data[at[1:] - 1] = 0x0A  # rows end a piece
        kind = _CLASS[data]
        word = kind == 0
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[word]))
        coded = text.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy()
        row = np.searchsorted(at, start, side="right") - 1
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[row]
        piece = np.searchsorted(np.flatnonzero(kind == _BREAK), start)
        self.linked = piece[1:] == piece[:-1]


def _token_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for part in chunks(batch, CHUNK):
            yield Tokens(part)


def _string_counts(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("c", "sum")]).rename_columns(
        ["lang", "phrase", "c"])


def _string_table(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": phrases.cast(pa.string()),
                     "c": pa.array(counts, pa.int64())})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, phrase, c)``: partial counts of words, and of all words under a null phrase."""
    parts, held = [], 0
    for t in _token_chunks(batches):
        for number, lang in enumerate(t.langs):
            count = np.bincount(t.codes[t.lang == number], minlength=len(t.words))
            seen = np.flatnonzero(count)
            if len(seen):
                parts += [_string_table(lang, t.words.take(pa.array(seen)), count[seen]),
                          _string_table(lang, pa.nulls(1, pa.large_string()), count.sum(keepdims=True))]
                held += len(seen)
        if held > GATHER // 2:
            parts = [_string_counts(parts)]
            if parts[0].num_rows > GATHER // 4:  # mostly new words: nothing more to combine
                yield from parts[0].to_batches(max_chunksize=1 << 16)
                parts = []
            held = sum(p.num_rows for p in parts)
    if parts:
        yield from _string_counts(parts).to_batches(max_chunksize=1 << 16)


def merge_cells(cells: np.ndarray, counts: np.ndarray, size: int):
    """Sums of the counts of equal cells: dense by address if crowded, else by sorting."""
    if size <= DENSE_CELLS and len(cells) >= size * CROWDED:
        total = np.bincount(cells, weights=counts, minlength=size)  # exact below 2**53
        seen = np.flatnonzero(total)
        return seen, total[seen].astype(np.int64)
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[first], np.add.reduceat(counts, first) if len(first) else counts


def band(rank: np.ndarray) -> np.ndarray:
    """Band of a number: 0 below ``TILE``, then one more at every doubling."""
    return np.frexp((rank // TILE).astype(np.float64))[1].astype(np.int16)


def band_base(b):
    return np.where(b == 0, 0, TILE << np.maximum(b - 1, 0))


def band_size(b):
    return TILE << np.maximum(b - 1, 0)


def tile_cells(tile: int) -> int:
    """Number of cells of a tile."""
    return int(band_size(np.int64(tile // BANDS))) * int(band_size(np.int64(tile % BANDS)))


def tile_ranks(tile: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right numbers of a tile's cells."""
    i, j = np.int64(tile // BANDS), np.int64(tile % BANDS)
    width = int(band_size(j))
    return band_base(i) + cells // width, band_base(j) + cells % width


def count_tiles(left: np.ndarray, right: np.ndarray):
    """``(tile, cells, counts)`` for each tile that holds a pair, cells ascending."""
    i, j = band(left), band(right)
    tile = (i * BANDS + j).astype(np.int16)
    order = np.argsort(tile, kind="stable")  # radix sort on 16 bits
    i, j, tile = i[order].astype(np.int64), j[order].astype(np.int64), tile[order]
    cell = (left[order] - band_base(i)) * band_size(j) + (right[order] - band_base(j))
    start = np.flatnonzero(np.diff(tile, prepend=-1))
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(tile)], strict=True):
        size = tile_cells(int(tile[s]))
        if size <= DENSE_CELLS and e - s >= size * CROWDED:
            total = np.bincount(cell[s:e], minlength=size)
            cells = np.flatnonzero(total)
            yield int(tile[s]), cells, total[cells]
        else:
            yield int(tile[s]), *np.unique(cell[s:e], return_counts=True)


def _packed(values: np.ndarray) -> bytes:
    """A width byte, then whole numbers of four bytes each if they fit, else of eight."""
    wide = len(values) and values.max() >= 1 << 31
    return (b"\x08" if wide else b"\x04") + values.astype(np.int64 if wide else np.int32).tobytes()


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    data = memoryview(raw)
    return np.frombuffer(data[1:], np.int64 if data[0] == 8 else np.int32).astype(np.int64)


def _cell_rows(rows: list, strings: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """Partial counts as Arrow batches of bounded size."""
    cut = [(lang, tile, part, cells[i:i + ROW_CELLS], counts[i:i + ROW_CELLS])
           for lang, tile, part, cells, counts in rows for i in range(0, len(cells), ROW_CELLS)]
    at = 0
    while at < len(cut):
        end, size = at, 0
        while end < len(cut) and size < 1 << 21:
            size += len(cut[end][3]) + 16
            end += 1
        lang, tile, part, cells, counts = zip(*cut[at:end], strict=True)
        none = pa.nulls(end - at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(tile, pa.int64()), pa.array(part, pa.int32()),
             # cells ascend: steps between them are small numbers
             pa.array([_packed(np.diff(c, prepend=0)) for c in cells], pa.binary()),
             pa.array([_packed(c) for c in counts], pa.binary()),
             none.cast(pa.string()), none.cast(pa.int64())],
            names=["lang", "tile", "part", "cells", "counts", "phrase", "c"])
        at = end
    if strings is not None:
        for b in strings.to_batches(max_chunksize=1 << 16):
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()),
                 none.cast(pa.binary()), b.column("phrase"), b.column("c")],
                names=["lang", "tile", "part", "cells", "counts", "phrase", "c"])


class Numbers:
    """Numbers of the most frequent words and pairs, by language; sent to the tasks."""

    def __init__(self, words: pa.Table, complete: bool):
        self.complete = complete
        self.words: dict[str, pa.Array] = {}
        lang = words.column("lang").to_numpy(zero_copy_only=False)
        text = words.column("phrase").combine_chunks().cast(pa.large_string())
        for name in set(lang.tolist()):  # the table comes by falling count
            self.words[name] = text.take(pa.array(np.flatnonzero(lang == name)))
        self.pairs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.pairs_complete = False

    def word_ids(self, t: Tokens, number: int) -> np.ndarray:
        """Number of every word of the chunk's dictionary in a language, -1 without one."""
        known = self.words.get(t.langs[number])
        if known is None:
            return np.full(len(t.words), -1, np.int64)
        return pc.fill_null(pc.index_in(t.words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def set_pairs(self, pairs: pa.Table, complete: bool) -> None:
        """Frequent pairs ``(lang, w1, w2)`` by falling count; pairs of a word without number are left out."""
        self.pairs_complete = complete
        lang = pairs.column("lang").to_numpy(zero_copy_only=False)
        for name in set(lang.tolist()):
            own = pairs.filter(pa.array(lang == name))
            ids = [pc.index_in(own.column(c).combine_chunks().cast(pa.large_string()), value_set=self.words[name])
                   for c in ("w1", "w2")]
            a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ids)
            code = a * len(self.words[name]) + b
            order = np.argsort(code)
            self.pairs[name] = (code[order], order)  # sorted codes, number of each

    def pair_ids(self, lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of every pair of word numbers, -1 without one."""
        if lang not in self.pairs or not len(a):
            return np.full(len(a), -1, np.int64)
        codes, number = self.pairs[lang]
        code = a * len(self.words[lang]) + b
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where((codes[at] == code) & (a >= 0) & (b >= 0), number[at], -1)


def _occurrences(t: Tokens, number: int, numbers: Numbers, length: int):
    """Cells ``(left, right)`` of a language's phrases of ``length`` words, and the first word's positions of those
    whose numbers are unknown but which may still be frequent."""
    here = t.linked & (t.lang[:-1] == number)
    if length == 3:
        here = here[:-1] & t.linked[1:]
    at = np.flatnonzero(here)
    ids = numbers.word_ids(t, number)
    a, b = ids[t.codes[at]], ids[t.codes[at + 1]]
    if length == 2:
        known = (a >= 0) & (b >= 0)
        return a[known].astype(np.int32), b[known].astype(np.int32), at[:0] if numbers.complete else at[~known]
    c = ids[t.codes[at + 2]]
    lang = t.langs[number]
    left, right = numbers.pair_ids(lang, a, b), numbers.pair_ids(lang, b, c)
    known = (left >= 0) & (right >= 0)
    rest = at[:0] if numbers.complete and numbers.pairs_complete else at[~known]
    return left[known].astype(np.int32), c[known].astype(np.int32), rest


def _split(tile: int, cells: np.ndarray, counts: np.ndarray, splits: int):
    """Parts of a tile by cell, each with its own key."""
    if splits == 1:
        yield tile, cells, counts
        return
    own = cells % splits
    order = np.argsort(own, kind="stable")
    own, cells, counts = own[order], cells[order], counts[order]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(own)], strict=True):
        yield tile * splits + int(own[s]), cells[s:e], counts[s:e]


def _cell_counts(sent, length: int, splits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, part = sent.value, TaskContext.get().partitionId()
        cells: dict[str, list] = {}
        strings, held, loose = [], 0, 0

        def counted():
            for lang, pairs in cells.items():
                left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
                for tile in count_tiles(left, right):
                    for key, cell, count in _split(*tile, splits):
                        yield lang, key, part, cell, count

        for t in _token_chunks(batches):
            if len(t.codes) < length:
                continue
            for number, lang in enumerate(t.langs):
                left, right, rest = _occurrences(t, number, numbers, length)
                if len(left):
                    cells.setdefault(lang, []).append((left, right))
                    held += len(left)
                if len(rest):
                    words = [t.words.take(pa.array(t.codes[rest + i])) for i in range(length)]
                    joined = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
                    strings.append(_string_table(lang, joined, np.ones(len(rest), np.int64)))
                    loose += len(rest)
            if held > GATHER:
                yield from _cell_rows(list(counted()))
                cells, held = {}, 0
            if loose > GATHER // 4:
                yield from _cell_rows([], _string_counts(strings))
                strings, loose = [], 0
        yield from _cell_rows(list(counted()), _string_counts(strings) if strings else None)
    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], splits: int):
    """``(key, cells, counts)`` of consecutive rows with equal ``keys``, merged as they come."""
    now, held, bound, cells, counts = None, 0, 0, [], []

    def merged():
        return merge_cells(np.concatenate(cells), np.concatenate(counts), tile_cells(now[1] // splits))
    for batch in batches:
        keyed = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        for i, key in enumerate(keyed):
            if key != now:
                if cells:
                    yield now, *merged()
                now, held, bound, cells, counts = key, 0, 1 << 21, [], []
            cells.append(np.cumsum(_unpacked(batch.column("cells")[i].as_buffer())))
            counts.append(_unpacked(batch.column("counts")[i].as_buffer()))
            held += len(cells[-1])
            if held > bound:
                cells, counts = ([x] for x in merged())
                held = len(cells[0])
                bound = max(bound, 2 * held)
    if cells:
        yield now, *merged()


def _merged(splits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, tile, part), cells, counts in _runs(batches, ["lang", "tile", "part"], splits):
            yield from _cell_rows([(lang, tile, part, cells, counts)])
    return run


def _frequent(sent, least: int, length: int, splits: int) -> Callable:
    """Last round: cells that reach the least count, as words again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        by_number: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for (lang, tile), cells, counts in _runs(batches, ["lang", "tile"], splits):
            keep = counts >= least
            if not keep.any():
                continue
            left, right = tile_ranks(tile // splits, cells[keep])
            counts = counts[keep]
            words = numbers.words[lang]
            if length == 3:
                if lang not in by_number:
                    codes, number = numbers.pairs[lang]
                    plain = np.empty(len(codes), np.int64)
                    plain[number] = codes
                    by_number[lang] = plain
                pair = by_number[lang][left]
                at = [pair // len(words), pair % len(words), right]
            else:
                at = [left, right]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()),
                 *[words.take(pa.array(x)).cast(pa.string()) for x in at], pa.array(counts, pa.int64())],
                names=["lang", *[f"w{i + 1}" for i in range(length)], "a"])
    return run


def count_phrases(docs: DataFrame, numbers: Numbers, length: int, least: int, splits: int = 1) -> DataFrame:
    """``(lang, w1, .., a)``: phrases of ``length`` words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(numbers)  # at most HEAD words and HEAD pairs
    tasks = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    partial = docs.mapInArrow(_cell_counts(sent, length, splits), _CELLS)
    names = [f"w{i + 1}" for i in range(length)]
    complete = numbers.complete and (length == 2 or numbers.pairs_complete)
    tiles = partial
    if not complete:
        partial = written(partial, "cells")
        tiles = partial.where("tile is not null")
    for _ in range(math.ceil(math.log(tasks + 1, FAN)) - 1):
        tiles = (tiles.withColumn("part", F.expr(f"cast(part div {FAN} as int)"))
                 .repartition("lang", "tile", "part").sortWithinPartitions("lang", "tile", "part")
                 .mapInArrow(_merged(splits), _CELLS))
    out = ", ".join(["lang string", *[f"{w} string" for w in names], "a long"])
    found = (tiles.repartition("lang", "tile").sortWithinPartitions("lang", "tile")
             .mapInArrow(_frequent(sent, least, length, splits), out))
    if not complete:
        rest = partial.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("c").alias("a"))
        rest = rest.where(F.col("a") >= least).withColumn("_w", F.split("phrase", " "))
        found = found.unionByName(rest.select("lang", *[F.col("_w")[i].alias(w) for i, w in enumerate(names)], "a"))
    return written(found, f"phrases{length}")


def _head(table: DataFrame, short, columns: list[str]) -> tuple[pa.Table, bool]:
    """The ``HEAD`` most frequent rows by falling count, and whether that is all of them."""
    total = table.count()
    rows = (table.where(short).orderBy(F.col("a").desc(), *columns).limit(HEAD)
            .select(*columns).toArrow())
    return rows, rows.num_rows == total


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top`` phrases of two and three words of
    ``docs(lang, text)`` by the lowest-scoring cut, without those that a longer phrase covers to ``inside`` percent."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = docs.mapInArrow(_word_counts, "lang string, phrase string, c long")
    counts = counts.groupBy("lang", "phrase").agg(F.sum("c").alias("a"))
    counts = written(counts.where((F.col("a") >= least) | F.col("phrase").isNull()), "words")
    words = counts.where("phrase is not null")
    totals = counts.where("phrase is null").select("lang", F.col("a").alias("n"))

    numbers = Numbers(*_head(words, F.octet_length("phrase") <= HEAD_BYTES, ["lang", "phrase"]))
    splits = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // SPLIT_WORDS))
    pairs = count_phrases(docs, numbers, 2, least, splits)
    if numbers.complete:
        numbered = pairs
    else:  # a pair has a number if both its words have one
        known = docs.sparkSession.createDataFrame(pa.table(
            {"lang": [k for k, v in numbers.words.items() for _ in range(len(v))],
             "w": [w for v in numbers.words.values() for w in v.to_pylist()]},
            schema=pa.schema([("lang", pa.string()), ("w", pa.string())])))
        numbered = (pairs.join(known.withColumnRenamed("w", "w1"), ["lang", "w1"], "left_semi")
                    .join(known.withColumnRenamed("w", "w2"), ["lang", "w2"], "left_semi"))
    rows, all_numbered = _head(numbered, F.lit(True), ["lang", "w1", "w2"])
    numbers.set_pairs(rows, all_numbered and numbers.complete)
    triples = count_phrases(docs, numbers, 3, least, splits)

    def freq(table, names, as_name):
        return table.select("lang", *[F.col(c).alias(n) for c, n in names.items()], F.col("a").alias(as_name))

    def score(a, left, right):
        # products of up to 37 and 38 digits; the quotient is at most 1,000,000
        return F.expr(f"(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) div "
                      f"(cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")

    two = (pairs.join(freq(words, {"phrase": "w1"}, "l"), ["lang", "w1"])
           .join(freq(words, {"phrase": "w2"}, "r"), ["lang", "w2"])
           .withColumn("score", score("a", "l", "r")))
    covers = (triples.select("lang", "w1", "w2", "a")
              .unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
              .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer")))
    two = (two.join(covers, ["lang", "w1", "w2"], "left")
           .where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score"))
    three = (triples.join(freq(words, {"phrase": "w1"}, "l1"), ["lang", "w1"])
             .join(freq(pairs, {"w1": "w2", "w2": "w3"}, "r1"), ["lang", "w2", "w3"])
             .join(freq(pairs, {"w1": "w1", "w2": "w2"}, "l2"), ["lang", "w1", "w2"])
             .join(freq(words, {"phrase": "w3"}, "r2"), ["lang", "w3"])
             .withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2")))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                         F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
                         F.least("s1", "s2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold a third of all candidates: first the best of each of its parts
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    cand = two.unionByName(three).withColumn("_part", part)
    cand = (cand.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
            .where(F.col("_r") <= top))
    best = (cand.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n",
                                            F.col("score").cast("long").alias("score"))
