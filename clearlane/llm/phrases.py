"""Phrase collocations by direct-address tiling.

Words, and later the frequent phrases of each length, are numbered by frequency,
so a pair of neighbours is a cell of a square table. The table is cut into tiles
of ``TILE`` x ``TILE`` cells. A tile with many pairs is counted with
``np.bincount`` straight by address, any other as sorted coordinates. Pairs that
are frequent are numbered by frequency again and are the units of the next
length: a phrase of m words is a pair of overlapping phrases of m - 1 words.

The text is read once. Tasks cut it into slices of a language (some MB of text,
words as numbers of the slice's own dictionary), and only dictionaries meet the
table of words: a word is one row for each slice, however frequent it is. The
same holds for pairs, which meet the table of frequent pairs as one block for
each slice and tile. No table is collected or broadcast by this module. Blocks of
one tile are added up in a tree of at most ``FAN`` blocks a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlane.llm import tokens as T
from clearlane.operators.ranking import sequence_number
from clearlane.operators.staging import stage_table

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
TILE_BITS = 10
TILE = 1 << TILE_BITS
TILE_SHIFT = 31 - TILE_BITS
# numbers of words and phrases of one length; a tile number and a cell fit 64 bits
MOST = 1 << 31
SLICE_BYTES = 4 << 20
# pairs of a tile from which on it is counted by address
DENSE = TILE * TILE // 32
FAN = 64
# words of a block of the word table
BLOCK_WORDS = 4096
WAITING = 8 * SLICE_BYTES
# units of a slice that are looked up at once
RUN = 1 << 16
# rows of this module are long; Spark and Python each hold a batch or two of them for each task
BATCH_BYTES = 8 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


def pack(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: first all lowest bytes, then the next ones.
    Most of the higher ones are zero, which shuffles and files store for nothing."""
    if not len(values):
        return b""
    wide = values.view(np.uint8).reshape(-1, values.itemsize)
    planes = np.empty((values.itemsize, len(values)), np.uint8)
    for i, plane in enumerate(planes):  # one strided copy each, much faster than a transposed one
        plane[:] = wide[:, i]
    return planes.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    wide = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        wide[:, i] = plane
    return wide.view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers by their steps, which are small."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def _cut(values: np.ndarray, bounds: np.ndarray, packed) -> pa.Array:
    """``values[bounds[k]:bounds[k + 1]]``, packed, as binary cell k."""
    return pa.array([packed(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def encode(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of the texts as numbers of a dictionary, -1 after each piece, and
    the dictionary."""
    data, offsets = T.text_bytes(column)
    data = T.LOWER[data]
    breaks = _BREAK[data]
    inside = ~(breaks | _SPACE[data])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= cut[1:-1] | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= cut[1:-1] | ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    piece = np.searchsorted(np.flatnonzero(breaks), start) + np.searchsorted(offsets, start, "right")
    lengths = np.concatenate([[0], np.cumsum(end - start)])
    text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(data[inside]))
    known = text.dictionary_encode()
    changes = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    out = np.full(len(start) + changes[-1] + 1, -1, np.int32)
    out[np.arange(len(start)) + changes] = known.indices.to_numpy()
    return out, known.dictionary.cast(pa.string())


def joined(parts: list[tuple[np.ndarray, pa.Array]]) -> tuple[np.ndarray, pa.Array]:
    """Encoded texts after each other, with one dictionary."""
    known = pa.concat_arrays([words for _, words in parts]).dictionary_encode()
    places, at = known.indices.to_numpy(), 0
    out = np.empty(sum(len(seq) for seq, _ in parts), np.int32)
    done = 0
    for seq, words in parts:
        # -1 is the last place, which stays -1
        out[done : done + len(seq)] = np.append(places[at : at + len(words)], np.int32(-1))[seq]
        at, done = at + len(words), done + len(seq)
    return out, known.dictionary


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, lang, n_words, seq, words, counts) of the texts of a task. Texts are
    encoded as they come, so a slice is never held as text."""
    number = TaskContext.get().partitionId() << 32
    waiting: dict[str, list[tuple[np.ndarray, pa.Array]]] = {}
    sizes: dict[str, int] = {}

    def cut(lang: str) -> pa.RecordBatch:
        nonlocal number
        seq, words = joined(waiting.pop(lang))
        del sizes[lang]
        number += 1
        counts = np.bincount(seq[seq >= 0], minlength=len(words)).astype(np.int64)
        bounds = pa.array([0, len(words)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([lang], pa.string()),
                pa.array([int(counts.sum())], pa.int64()),
                pa.array([pack(seq)], pa.binary()),
                pa.ListArray.from_arrays(bounds, words),
                pa.ListArray.from_arrays(bounds, pa.array(counts)),
            ],
            names=["slice", "lang", "n_words", "seq", "words", "counts"],
        )

    for batch in T.slices(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted({*langs}):
            mine = batch.column("text").filter(pa.array(langs == lang))
            waiting.setdefault(lang, []).append(encode(mine))
            sizes[lang] = sizes.get(lang, 0) + mine.nbytes
            if sizes[lang] >= SLICE_BYTES:
                yield cut(lang)
        # however many languages there are, a task holds a bounded piece of text
        while sum(sizes.values()) > WAITING:
            yield cut(max(sizes, key=sizes.get))
    for lang in sorted(sizes):
        yield cut(lang)


def _numbered(rows: DataFrame, least_order: list[str]) -> DataFrame:
    """``rows`` (lang, n, ...) with id 0, 1, ...: a language after the other, the
    frequent ones first."""
    minus = stage_table(rows.withColumn("minus", -F.col("n")))  # read once for the ranges and once for the numbers
    ordered = sequence_number(minus, ["lang", "minus", *least_order], "id")
    return stage_table(ordered.withColumn("id", F.col("id") - 1).drop("minus"))


def _size(table: DataFrame) -> int:
    n = table.count()
    if n >= MOST:
        raise ValueError(f"{n} phrases of one length; at most {MOST - 1} can be numbered")
    return n


def _bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """The block of the word table that a word is in."""
    data, offsets = T.text_bytes(words)
    start, end = offsets[:-1], offsets[1:]
    code = T.mix(T.Rolling(T.BYTE_VALUE[data], T.BASES[0]).of(start, end) + (end - start).astype(np.uint64))
    return (code % np.uint64(buckets)).astype(np.int64)


def _word_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("lang", "phrase", "id")), pa.array(_bucket(batch.column("phrase"), buckets))], names=["lang", "phrase", "id", "bucket"]
            )


def _dictionary_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(slice, lang, bucket, locals, words): the dictionary of each slice, cut as
    the word table is."""
    for batch in batches:
        for number, lang, words in zip(*(batch.column(c) for c in ("slice", "lang", "words")), strict=True):
            words = words.values
            if not len(words):
                continue
            bucket = _bucket(words, buckets)
            order = np.argsort(bucket, kind="stable").astype(np.int32)  # ascending in a bucket
            ordered = bucket[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            bounds = np.append(first, len(order))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), number.as_py(), np.int64)),
                    pa.array([lang.as_py()] * len(first), pa.string()),
                    pa.array(ordered[first]),
                    _cut(order, bounds, pack_sorted),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.take(pa.array(order))),
                ],
                names=["slice", "lang", "bucket", "locals", "words"],
            )


def _known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of a dictionary, the words of the table, with their number."""
    for batch in batches:
        for number, own, words, known in zip(*(batch.column(c) for c in ("slice", "locals", "words", "known")), strict=True):
            phrases, ids = known.values.flatten()
            at = pc.fill_null(pc.index_in(words.values, value_set=phrases), -1).to_numpy(zero_copy_only=False)
            if (at >= 0).any():
                local = unpack_sorted(own.as_py(), np.int32)[at >= 0]
                found = ids.to_numpy(zero_copy_only=False)[at[at >= 0]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()], pa.int64()), pa.array([pack_sorted(local.astype(np.int64))], pa.binary()), pa.array([pack(found)], pa.binary())],
                    names=["slice", "keys", "ids"],
                )


def _recode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of a slice's own numbers as sequences of the numbers of words;
    words that have none, and -1, end a run."""
    for batch in batches:
        for number, seq, size, found in zip(*(batch.column(c) for c in ("slice", "seq", "size", "found")), strict=True):
            ids = np.full(size.as_py() + 1, -1, np.int32)
            for part in found.as_py():
                ids[unpack_sorted(part["keys"], np.int64)] = unpack(part["ids"], np.int32)
            # -1 is the last place, which stays -1
            yield _sequence(number.as_py(), ids[unpack(seq.as_py(), np.int32)])


def _sequence(number: int, ids: np.ndarray) -> pa.RecordBatch:
    """Runs of two numbers or more; a single -1 stands between them."""
    known = np.concatenate([[False], ids >= 0, [False]])
    paired = known[1:-1] & (known[:-2] | known[2:])
    before = np.concatenate([[False], paired[:-1]])
    kept = ids[paired | before]
    kept[~paired[paired | before]] = -1
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([pack(kept)], pa.binary())], names=["slice", "seq"]
    )


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, cell, n) of the different pairs, in the order of tile and cell. A
    tile with ``DENSE`` pairs is counted by address, the rest as coordinates."""
    keys = _pair_keys(left, right)
    tiles, sizes = _runs(np.sort(keys >> (2 * TILE_BITS)))
    parts = []
    for tile in tiles[sizes >= DENSE].tolist():
        mine = keys >> (2 * TILE_BITS) == tile
        counted = np.bincount(keys[mine] & (TILE * TILE - 1), minlength=TILE * TILE)
        seen = np.flatnonzero(counted)
        parts.append((tile << (2 * TILE_BITS) | seen, counted[seen]))
        keys = keys[~mine]
    keys.sort()
    keys, ns = (np.concatenate(x) for x in zip(*parts, _runs(keys), strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return keys >> (2 * TILE_BITS), keys & (TILE * TILE - 1), ns[order]


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tile and cell of pairs as one number."""
    keys = (left >> TILE_BITS).astype(np.int64) << TILE_SHIFT | right >> TILE_BITS
    keys <<= TILE_BITS
    keys |= left & (TILE - 1)
    keys <<= TILE_BITS
    keys |= right & (TILE - 1)
    return keys


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers and how often each occurs."""
    first = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(first, append=len(ordered))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, tile, cells, ns): the pairs of neighbours of each slice."""
    for batch in batches:
        for number, seq in zip(batch.column("slice").to_pylist(), batch.column("seq"), strict=True):
            ids = unpack(seq.as_py(), np.int32)
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            if not both.any():
                continue
            tile, cell, n = count_pairs(ids[:-1][both], ids[1:][both])
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            bounds = np.append(first, len(tile))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(first), number, np.int64)),
                    pa.array(tile[first]),
                    _cut(cell.astype(np.int32), bounds, pack_sorted),
                    _cut(n.astype(np.int64), bounds, pack),
                ],
                names=["slice", "tile", "cells", "ns"],
            )


def _added(cells: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if sum(len(c) for c in cells) >= DENSE:
        total = np.zeros(TILE * TILE, np.int64)
        for c, x in zip(cells, ns, strict=True):
            total[c] += x  # a block has each cell once
        seen = np.flatnonzero(total)
        return seen.astype(np.int32), total[seen]
    cell, n = np.concatenate(cells), np.concatenate(ns)
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], np.add.reduceat(n, first)


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a (tile, part), which come one after the other:
    blocks again, or with ``least`` the frequent pairs as rows."""
    key, cells, ns, waiting = None, [], [], 0

    def out() -> pa.RecordBatch:
        cell, n = _added(cells, ns)
        if not least:
            columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([pack_sorted(cell)], pa.binary()), pa.array([pack(n)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["tile", "part", "cells", "ns"])
        cell, n = cell[n >= least].astype(np.int64), n[n >= least]
        left = key[0] >> TILE_SHIFT << TILE_BITS | cell >> TILE_BITS
        right = (key[0] & ((1 << TILE_SHIFT) - 1)) << TILE_BITS | cell & (TILE - 1)
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n)], names=["left", "right", "n"])

    for batch in batches:
        keys = zip(batch.column("tile").to_pylist(), batch.column("part").to_pylist(), strict=True)
        for this, cell, n in zip(keys, batch.column("cells"), batch.column("ns"), strict=True):
            if this != key:
                if key is not None:
                    yield out()
                key, cells, ns, waiting = this, [], [], 0
            cells.append(unpack_sorted(cell.as_py(), np.int32))
            ns.append(unpack(n.as_py(), np.int64))
            waiting += len(cells[-1])
            if waiting > 2 * TILE * TILE:
                cell, n = _added(cells, ns)
                cells, ns, waiting = [cell], [n], len(cell)
    if key is not None:
        yield out()


def _totals(blocks: DataFrame, slices: int, least: int) -> DataFrame:
    """(left, right, n) of the frequent pairs. A step adds up at most ``FAN``
    blocks of a tile, so the hottest tile is read by as many tasks as it needs."""
    parts = slices
    blocks = blocks.select("tile", F.col("slice").alias("part"), "cells", "ns")
    while True:
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)) if parts > 1 else F.lit(0).cast("long"))
        dealt = blocks.repartition("tile", "part").sortWithinPartitions("tile", "part")
        if parts <= 1:
            return dealt.mapInArrow(partial(_merge, least=least), "left long, right long, n long")
        blocks = dealt.mapInArrow(partial(_merge, least=0), "tile long, part long, cells binary, ns binary")


def _tile(left: Column, right: Column) -> Column:
    return F.shiftleft(F.shiftright(left, TILE_BITS), TILE_SHIFT).bitwiseOR(F.shiftright(right, TILE_BITS))


def _cell(left: Column, right: Column) -> Column:
    low = F.lit(TILE - 1)
    return F.shiftleft(left.bitwiseAND(low), TILE_BITS).bitwiseOR(right.bitwiseAND(low)).cast("int")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the cells that are frequent pairs, with their number."""
    for batch in batches:
        for number, tile, cells, found in zip(*(batch.column(c) for c in ("slice", "tile", "cells", "found")), strict=True):
            mine = unpack_sorted(cells.as_py(), np.int32)
            cell, ids = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())  # sorted by cell
            at = np.minimum(np.searchsorted(cell, mine), len(cell) - 1)
            hit = cell[at] == mine
            if hit.any():
                keys = np.int64(tile.as_py()) << (2 * TILE_BITS) | mine[hit].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()], pa.int64()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([pack(ids[at][hit].astype(np.int32))], pa.binary())],
                    names=["slice", "keys", "ids"],
                )


def _recode_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of phrases as sequences of the phrases one word longer."""
    for batch in batches:
        for number, seq, found in zip(*(batch.column(c) for c in ("slice", "seq", "found")), strict=True):
            parts = found.as_py()
            keys = np.concatenate([unpack_sorted(x["keys"], np.int64) for x in parts])
            ids = np.concatenate([unpack(x["ids"], np.int32) for x in parts])
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            units = unpack(seq.as_py(), np.int32)
            # a break between two pieces keeps a place of its own
            longer = np.full(len(units) - 1, -1, np.int32)
            for a in range(0, len(longer), RUN):
                left, right = units[:-1][a : a + RUN], units[1:][a : a + RUN]
                both = np.flatnonzero((left >= 0) & (right >= 0))
                key = _pair_keys(left[both], right[both])
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                longer[a + both] = np.where(keys[at] == key, ids[at], -1)
            yield _sequence(number.as_py(), longer)


def _replies(found: DataFrame) -> DataFrame:
    """All answers to a slice, at most one for each of its words or pairs, for a
    join by shuffle at every size."""
    return found.groupBy("slice").agg(F.collect_list(F.struct("keys", "ids")).alias("found")).hint("merge")


def _longer(seqs: DataFrame, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The slices as sequences of the frequent pairs (id, left, right)."""
    left, right = F.col("left"), F.col("right")
    by_tile = (
        pairs.select(_tile(left, right).alias("tile"), F.struct(_cell(left, right).alias("cell"), F.col("id").cast("int").alias("id")).alias("pair"))
        .groupBy("tile")
        .agg(F.array_sort(F.collect_list("pair")).alias("found"))  # at most TILE * TILE
    )
    found = blocks.select("slice", "tile", "cells").join(by_tile.hint("merge"), "tile").mapInArrow(_found, "slice long, keys binary, ids binary")
    return stage_table(seqs.join(_replies(found), "slice").mapInArrow(_recode_pairs, "slice long, seq binary"), long_rows=True)


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_BYTES`` and a row between Spark and Python, for
    what is written meanwhile, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_LIMIT)


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... ``longest`` words, as tables (id, lang,
    phrase, n) and, from two words on, (left, right): the numbers of the first and
    of the last words but one. And (lang, total), all words of a language."""
    rows = docs.select(docs[text_col].alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"))
    slices = stage_table(rows.filter("length(text) > 0").mapInArrow(_slices, "slice long, lang string, n_words long, seq binary, words array<string>, counts array<long>"), long_rows=True)
    total = slices.groupBy("lang").agg(F.sum("n_words").alias("total"))
    counts = (
        slices.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
        .groupBy("lang", F.col("x.words").alias("phrase"))
        .agg(F.sum("x.counts").alias("n"))
        .filter(F.col("n") >= least)
    )
    words = _numbered(counts, ["phrase"])
    tables = [words]
    n_words = _size(words)
    if not n_words:
        return tables, total
    buckets = -(-n_words // BLOCK_WORDS)
    blocked = words.select("lang", "phrase", "id").mapInArrow(partial(_word_blocks, buckets=buckets), "lang string, phrase string, id long, bucket long")
    table = blocked.groupBy("lang", "bucket").agg(F.collect_list(F.struct("phrase", "id")).alias("known"))  # some BLOCK_WORDS
    own = slices.select("slice", "lang", "words").mapInArrow(
        partial(_dictionary_blocks, buckets=buckets), "slice long, lang string, bucket long, locals binary, words array<string>"
    )
    found = own.join(table.hint("merge"), ["lang", "bucket"]).mapInArrow(_known_words, "slice long, keys binary, ids binary")
    replies = _replies(found)
    own_numbers = slices.select("slice", "seq", F.size("words").alias("size"))
    seqs = stage_table(own_numbers.join(replies, "slice").mapInArrow(_recode_words, "slice long, seq binary"), long_rows=True)
    n_slices = seqs.count()
    for m in range(2, longest + 1):
        blocks = seqs.mapInArrow(_blocks, "slice long, tile long, cells binary, ns binary")
        blocks = stage_table(blocks, long_rows=True) if m < longest else blocks
        shorter = tables[-1]
        pairs = _totals(blocks, n_slices, least)
        first = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
        last = shorter.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("tail"))
        named = pairs.join(first, "left").join(last, "right").select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "n", "left", "right")
        table = _numbered(named, ["left", "right"])
        if not _size(table):
            break
        tables.append(table)
        if m < longest:
            seqs = _longer(seqs, blocks, table)
    return tables, total


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = TOP,
) -> DataFrame:
    """The phrases of 2 to ``longest`` words of each language that stand together
    more often than their parts let expect: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z), cut into pieces at ``. , ; : ! ?`` and line
    ends, and these into words at blanks and tabs. ``a`` counts all occurrences of
    a phrase inside pieces, overlapping ones too, and is ``least`` or more; n
    counts all words of the language. Cut after its first k words, a phrase has
    parts with l and r occurrences and the score floor(1000 * a * n / (l * r)); the
    lowest score counts, and the smallest k of several. A phrase that is part of a
    longer one that is as frequent is left out. Phrases are ranked by score, then
    a, then by their bytes; the first ``top`` stay (None: all).

    A null or empty text has no words; a null language is ``und``. Repeated rows
    count as often as they occur, ids do not matter, further columns are not read.
    An empty table has no phrases. A text longer than a slice is a slice of its
    own, so a task needs memory for the longest text.
    """
    with _short_batches(docs.sparkSession):
        tables, total = phrase_counts(docs, text_col, lang_col, least, longest)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if len(tables) < 2:
        return docs.sparkSession.createDataFrame([], schema)
    # a phrase inside a longer one is inside one that has a single word more
    longer = [t.select("lang", "n", F.explode(F.array("left", "right")).alias("id")).groupBy("id").agg(F.max("n").alias("longer")) for t in tables[2:]]
    candidates, parts = None, tables[0].select("lang", "phrase", "n")
    for m, table in enumerate(tables[1:], 2):
        kept = table
        if m - 2 < len(longer):
            kept = table.join(longer[m - 2], "id", "left").filter("longer IS NULL OR longer < n")
        kept = kept.select("lang", "phrase", F.col("n").alias("a"))
        candidates = kept if candidates is None else candidates.union(kept)
        parts = parts.union(table.select("lang", "phrase", "n"))
    split = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(split) - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(split, F.col("k") + 1, F.size(split) - F.col("k")), " ").alias("tail"),
    )
    cuts = (
        cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
        .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
        .join(total.withColumnRenamed("total", "n"), "lang")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", wide("a") * wide("n")).withColumn("down", wide("l") * wide("r"))
    # 1000 * a * n / (l * r), in whole numbers
    scored = cuts.withColumn("score", F.expr("CAST(up * 1000 AS DECIMAL(38,0)) div down"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # numbered in ranges of the whole order: no task sorts a language
    minus = stage_table(rows.withColumn("m_score", -F.col("score")).withColumn("m_a", -F.col("a")))
    placed = stage_table(sequence_number(minus, ["lang", "m_score", "m_a", "phrase"], "place"))
    before = placed.groupBy("lang").agg((F.min("place") - 1).alias("before"))
    ranked = placed.join(before, "lang").withColumn("rank", F.col("place") - F.col("before"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
