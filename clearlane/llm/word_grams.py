"""Interpolated modified Kneser-Ney over words, in packed blocks of numbers.

Every table grows with the corpus. Nothing is pruned, collected or broadcast but
one row for each model:

* Tasks cut the texts into slices of one model (some MB). A slice has numbers of
  its own dictionary, and only the dictionaries meet the words of the trusted texts:
  a word that these have gets its number, any other is unknown.
* The n-grams of a slice are sorted and go, packed, to the part of a hash of their
  context. There the trusted ones are added up, and each slice of judged texts gets
  an answer of whole numbers in the order of its n-grams: how often they occur, and
  what follows their context. The same is done for pairs and for words.
* A slice with all its answers has what its probabilities need.

One half of the texts is judged after the other, and the files of a step are
removed when the next one is written.

``model`` is a plain grouping key: ``=en|0`` and ``=en|1`` are learned from the halves
of the trusted texts of a language, ``*|0`` and ``*|1`` from those of all languages.
Texts are halved by a hash of the text, so equal texts are in one half. A text,
trusted or not, is judged by the model of the half that it is not in: perplexities
of models with other words cannot be compared, and a model knows its own texts too
well to set limits by them. A language has its own models if both halves have a
trusted text with words; the others are judged by those of all languages, and by the
limits that trusted texts have there. A text is judged once by a model, however many
documents have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane.llm import phrases
from clearlane.llm import tokens as T
from clearlane.operators.staging import release, stage_table, staged

ORDER = 3
OTHER = "*"
SLICE_BYTES = 1 << 20
ROWS_AT_ONCE = 256
# text of a half for each part that a model's n-grams are dealt to
PART_BYTES = 16 << 20
MOST_PARTS = 1 << 15
# steps in which the slices get their numbers, so that a part of them is shuffled at once
RECODED_IN = 4
UNKNOWN = np.uint32(0xFFFFFFFF)  # 0 is the border of a text, words count from 1
HALF = np.uint64(32)
_CODEC = "zstd"
_SLICE = "slice long, base string, trained boolean, texts binary, lengths binary, words binary, seq binary"
_BLOCK = "base string, part int, judged boolean, slice long, data array<binary>"
_ANSWER = "base string, slice long, part int, kind int, data array<binary>, stat array<long>"
WORDS_OF, GRAMS, PAIRS, STAT, WORD_SUMS = range(5)


def _press(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec=_CODEC, asbytes=True) if data else b""


def _unpress(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True) if data else b""


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs."""
    if not len(values):
        return b""
    size = 8 if values.min() < 0 else next(x for x in (1, 2, 4, 8) if int(values.max()) < 1 << 8 * x)
    return bytes([size]) + _press(phrases.pack(values.astype(f"u{size}")))


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return phrases.unpack(_unpress(data[1:]), f"u{data[0]}").astype(kind) if data else np.zeros(0, kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _batches(schema: list[tuple[str, pa.DataType]], rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some ``SLICE_BYTES`` of their packed numbers at most."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += sum(len(x) for data in row if isinstance(data, list) for x in data if isinstance(x, bytes))
        if size >= SLICE_BYTES or len(waiting) >= ROWS_AT_ONCE:
            yield _batch(schema, waiting)
            waiting, size = [], 0
    if waiting:
        yield _batch(schema, waiting)


_SLICES = [("slice", pa.int64()), ("base", pa.string()), ("trained", pa.bool_()), *[(c, pa.binary()) for c in ("texts", "lengths", "words", "seq")]]
_BLOCKS = [("base", pa.string()), ("part", pa.int32()), ("judged", pa.bool_()), ("slice", pa.int64()), ("data", pa.list_(pa.binary()))]
_ANSWERS = [("base", pa.string()), ("slice", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.list_(pa.binary())), ("stat", pa.list_(pa.int64()))]


# --- slices -------------------------------------------------------------------------


def _factored(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and the place of each among them. Only the
    different ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    found, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), np.uint32)
    place[order] = np.arange(len(found), dtype=np.uint32)
    return found[order], place[code]


def _cut_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the texts (text_id, text, base, trained) of a task. A text to be
    judged is there once in a slice."""
    number = TaskContext.get().partitionId() << 32
    waiting: dict[tuple, list[pa.RecordBatch]] = {}
    sizes: dict[tuple, int] = {}

    def cut(key: tuple) -> Iterator[pa.RecordBatch]:
        nonlocal number
        del sizes[key]
        table = pa.Table.from_batches(waiting.pop(key)).combine_chunks()
        ids = table.column("text_id").to_numpy()
        if not key[1]:
            ids, first = np.unique(ids, return_index=True)
            table = table.take(pa.array(first))
        w = T.words(table.column("text"))
        if not w.n:
            return
        words, seq = _factored(w.hashes())
        lengths = np.diff(w.first)
        some = lengths > 0
        number += 1
        blobs = (_pack(ids[some]), _pack(lengths[some].astype(np.int64)), _pack_sorted(words), _pack(seq.astype(np.uint32)))
        yield _batch(_SLICES, [(number, *key, *blobs)])

    for batch in T.slices(batches, "text", SLICE_BYTES):
        keys = list(zip(batch.column("base").to_pylist(), batch.column("trained").to_pylist(), strict=True))
        for key in sorted({*keys}):
            mine = batch.select(["text_id", "text"]).filter(pa.array([k == key for k in keys]))
            waiting.setdefault(key, []).append(mine)
            sizes[key] = sizes.get(key, 0) + mine.nbytes
            if sizes[key] >= SLICE_BYTES:
                yield from cut(key)
        # however many languages there are, a task holds a bounded piece of text
        while sum(sizes.values()) > 8 * SLICE_BYTES:
            yield from cut(max(sizes, key=sizes.get))
    for key in sorted(sizes):
        yield from cut(key)


def _bounds(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of ascending parts."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(part[at].tolist(), at.tolist(), np.append(at, len(part))[1:].tolist(), strict=True)


def _range_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> HALF) * np.uint64(parts)) >> HALF).astype(np.int64)


def _word_part(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part that numbered a word."""
    return np.where(ids == 0, 0, (ids.astype(np.int64) - 1) % parts)


def _dictionaries(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        words = _unpack_sorted(row["words"], np.uint64)
        out = [
            (row["base"], p, not row["trained"], row["slice"], [_pack_sorted(words[a:b])])
            for p, a, b in _bounds(_range_part(words, parts))
        ]
        yield _batch(_BLOCKS, out)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict], Iterator[dict]]]:
    """(base, part, rows learned from, rows to be answered) of blocks in this
    order. Only what is learned is held."""
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        key, learned = (row["base"], row["part"]), []
        while row is not None and (row["base"], row["part"]) == key and not row["judged"]:
            learned.append(row)
            row = next(rows, None)

        def asked() -> Iterator[dict]:
            nonlocal row
            while row is not None and (row["base"], row["part"]) == key:  # noqa: B023
                yield row
                row = next(rows, None)

        yield *key, learned, asked()
        for _ in asked():
            pass


def _numbered(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple]:
    """Numbers of the words of each dictionary. Word i of part p has the number
    i * parts + p + 1; words of more slices come first, which packs better."""
    for base, p, learned, asked in _groups(batches):
        own = [_unpack_sorted(row["data"][0], np.uint64) for row in learned]
        known, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
        place = np.empty(len(known), np.int64)
        place[np.argsort(-n, kind="stable")] = np.arange(len(known))

        def numbers(words: np.ndarray) -> np.ndarray:
            at, hit = _find(known, words)  # noqa: B023
            return np.where(hit, _taken(place, at, hit) * parts + p + 1, UNKNOWN).astype(np.uint32)  # noqa: B023

        for row, words in zip(learned, own, strict=True):
            yield (base, row["slice"], p, WORDS_OF, [_pack(numbers(words))], None)
        for row in asked:
            yield (base, row["slice"], p, WORDS_OF, [_pack(numbers(_unpack_sorted(row["data"][0], np.uint64)))], None)


def _number(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    return _batches(_ANSWERS, _numbered(batches, parts))


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted numbers are among the known ascending ones, and whether."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The border and the known words of a slice, ascending, and its words by their
    place among them; unknown ones have the place after the last."""
    for row in _rows(batches):
        ids = _column(row["found"], WORDS_OF, 0, np.uint32)
        words = np.unique(np.append(ids[ids != UNKNOWN], np.uint32(0)))
        seq = np.searchsorted(words, ids).astype(np.uint32)[_unpack(row["seq"], np.uint32)]
        kept = (row[c] for c in ("slice", "base", "trained", "texts", "lengths"))
        yield _batch(_SLICES, [(*kept, _pack_sorted(words), _pack(seq))])


def _column(found: list[dict], kind: int, i: int, dtype: type) -> np.ndarray:
    """Answer ``i`` of all parts, in their order."""
    mine = sorted((x for x in found if x["kind"] == kind), key=lambda x: x["part"])
    return np.concatenate([np.zeros(0, dtype), *[_unpack(x["data"][i], dtype) for x in mine]])


# --- n-grams ----------------------------------------------------------------------------


def _grams(row: dict) -> tuple[np.ndarray, ...]:
    """The numbers of a slice's words and of an unknown one, and w0, w1, w2 of every
    word of the slice as places there; before a text there are borders."""
    words = np.append(_unpack_sorted(row["words"], np.uint32), UNKNOWN)
    seq, lengths = _unpack(row["seq"], np.uint32).astype(np.int64), _unpack(row["lengths"], np.int64)
    local = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = [np.concatenate([np.zeros(b, np.int64), seq])[: len(seq)] for b in (2, 1)]
    return words, *[np.where(local >= b, x, 0) for b, x in zip((2, 1), before, strict=True)], seq


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << HALF) | b.astype(np.uint64)


def _ordered(size: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams of places below ``size``, and which are new in it."""
    n = len(columns[0])
    places = max(1, n.bit_length())
    new = np.ones(n, bool)
    if size ** len(columns) << places < 1 << 64:
        # the place goes with the n-gram, as sorting numbers is faster than finding their order
        code = columns[0].astype(np.uint64)
        for x in columns[1:]:
            code = code * np.uint64(size) + x.astype(np.uint64)
        code = np.sort(code << np.uint64(places) | np.arange(n, dtype=np.uint64))
        order = (code & np.uint64((1 << places) - 1)).astype(np.int64)
        code >>= np.uint64(places)
        new[1:] = code[1:] != code[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in columns], axis=0)
    return order, new


def _by_part(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray | None, first: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """Key, other and part of the n-grams at ``first``, in the order of parts; and this
    order."""
    key = _pair(words[a[first]], words[b[first]])
    part = _range_part(T.mix(key), parts)
    dealt = np.argsort(part.astype(np.uint16), kind="stable")
    return key[dealt], None if c is None else words[c[first]][dealt], part[dealt], dealt


def _different(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray | None, parts: int) -> tuple[np.ndarray, ...]:
    """Of the n-grams with the key (a, b) and the other word c: key and other of the
    different ones in the order of parts, keys and others; their parts; and which of
    them each one is."""
    order, new = _ordered(len(words), [x for x in (a, b, c) if x is not None])
    *found, dealt = _by_part(words, a, b, c, order[new], parts)
    place = np.empty(len(dealt), np.int64)
    place[dealt] = np.arange(len(dealt))
    which = np.empty(len(order), np.int64)
    which[order] = place[np.cumsum(new) - 1]
    return *found, which


def _counted(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray | None, parts: int) -> tuple[np.ndarray, ...]:
    """The same key, other and parts as of ``_different``, and how often each occurs."""
    order, new = _ordered(len(words), [x for x in (a, b, c) if x is not None])
    *found, dealt = _by_part(words, a, b, c, order[new], parts)
    return *found, np.diff(np.append(np.flatnonzero(new), len(new)))[dealt]


def _known(grams: tuple[np.ndarray, ...], pairs: bool) -> tuple[np.ndarray, ...]:
    """The words and n-grams to be answered, and the places that have them."""
    words, w0, w1, w2 = grams
    a, b, c = (w1, w2, None) if pairs else (w0, w1, w2)
    known = np.flatnonzero((a < len(words) - 1) & (b < len(words) - 1))
    return words, a[known], b[known], None if pairs else c[known], known


def _asked(grams: tuple[np.ndarray, ...], parts: int, pairs: bool) -> tuple[np.ndarray, ...]:
    """Key and other number of the n-grams to be answered, their parts, which of
    them each known place has, and these places."""
    *columns, known = _known(grams, pairs)
    return *_different(*columns, parts), known


def _ask_words(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a slice's words by parts, and the parts in it."""
    part = _word_part(words, parts)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _deal_grams(batches: Iterator[pa.RecordBatch], parts: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        grams = _grams(row)
        if row["trained"]:
            words, w0, w1, w2 = grams
            key, other, part, n = _counted(words, *((w1, w2, w0) if pairs else (w0, w1, w2)), parts)
            out = [
                (row["base"], p, False, row["slice"], [_pack_sorted(key[a:b]), _pack(other[a:b]), b"" if pairs else _pack(n[a:b])])
                for p, a, b in _bounds(part)
            ]
        else:
            key, other, part, _ = _counted(*_known(grams, pairs)[:4], parts)
            out = [
                (row["base"], p, True, row["slice"], [_pack_sorted(key[a:b]), b"" if pairs else _pack(other[a:b])])
                for p, a, b in _bounds(part)
            ]
        if out:
            yield _batch(_BLOCKS, out)


def _deal_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        words = _unpack_sorted(row["words"], np.uint32)
        order, part = _ask_words(words, parts)
        yield _batch(_BLOCKS, [(row["base"], p, True, row["slice"], [_pack_sorted(words[order[a:b]])]) for p, a, b in _bounds(part)])


def _sums(n: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each run that starts at ``start``: the sum, and how many are 1, 2, more."""
    if not len(start):
        return [np.zeros(0, np.int64)] * 4
    return [np.add.reduceat(x.astype(np.int64), start) for x in (n, n == 1, n == 2, n > 2)]


def _kinds(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, how many there are, and their sum."""
    return [*np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist(), int((n > 0).sum()), int(n.sum())]


def _learned(learned: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (key, other) of the blocks in order, and how often."""
    key = np.concatenate([np.zeros(0, np.uint64), *[_unpack_sorted(x["data"][0], np.uint64) for x in learned]])
    other = np.concatenate([np.zeros(0, np.uint32), *[_unpack(x["data"][1], np.uint32) for x in learned]])
    counted = learned and learned[0]["data"][2]
    n = np.concatenate([_unpack(x["data"][2], np.int64) for x in learned]) if counted else np.ones(len(key), np.int64)
    # blocks are in order, which a stable sort makes use of
    first, size = key >> HALF, int(max(key.max() >> HALF, (key & np.uint64(UNKNOWN)).max(), other.max())) + 1 if len(key) else 1
    if size**3 < 1 << 64:
        order = np.argsort((first * np.uint64(size) + (key & np.uint64(UNKNOWN))) * np.uint64(size) + other, kind="stable")
    else:
        order = np.lexsort((other, key))
    key, other, n = key[order], other[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    at = np.flatnonzero(new)
    return key[at], other[at], np.add.reduceat(n, at) if len(at) else n


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def _taken(values: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return np.where(hit, values[at], 0) if len(values) else np.zeros(len(at), np.int64)


def _gram_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each n-gram asked for, how often it is learned; for each of their
    contexts, the sums of what follows it."""
    for base, p, learned, asked in _groups(batches):
        key, other, n = _learned(learned)
        start = _starts(key)
        contexts, sums = key[start], _sums(n, start)
        place = _pair(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key)))), other)
        yield (base, -1, p, STAT, None, _kinds(n))
        for row in asked:
            k, o = _unpack_sorted(row["data"][0], np.uint64), _unpack(row["data"][1], np.uint32)
            own = _starts(k)
            at, hit = _find(contexts, k[own])
            times = np.diff(np.append(own, len(k)))
            where, found = _find(place, _pair(np.repeat(at, times), o))
            times_n = _taken(n, where, found & np.repeat(hit, times))
            yield (base, row["slice"], p, GRAMS, [_pack(x) for x in (times_n, *[_taken(s, at, hit) for s in sums])], None)


def _answer_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(_ANSWERS, _gram_answers(batches))


def _pair_answers(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple]:
    """For each pair asked for, how many different words come before it, and the
    sums of this for the words of the learned pairs."""
    for base, p, learned, asked in _groups(batches):
        key, _, _ = _learned(learned)
        start = _starts(key)
        pairs, n = key[start], np.diff(np.append(start, len(key)))
        left, right = (pairs >> HALF).astype(np.uint32), (pairs & np.uint64(UNKNOWN)).astype(np.uint32)
        yield (base, -1, p, STAT, None, _kinds(n))
        first = _starts(left)
        ends, count = np.unique(right, return_counts=True)
        words = np.union1d(left[first], ends)
        columns = [np.zeros(len(words), np.int64) for _ in range(5)]
        for column, s in zip(columns, _sums(n, first), strict=False):
            column[np.searchsorted(words, left[first])] = s
        columns[4][np.searchsorted(words, ends)] = count
        part = _word_part(words, parts)
        order = np.lexsort((words, part))
        words, part, columns = words[order], part[order], [c[order] for c in columns]
        for q, a, b in _bounds(part):
            yield (base, -1, q, WORD_SUMS, [_pack_sorted(words[a:b]), *[_pack(c[a:b]) for c in columns]], None)
        for row in asked:
            at, hit = _find(pairs, _unpack_sorted(row["data"][0], np.uint64))
            yield (base, row["slice"], p, PAIRS, [_pack(_taken(n, at, hit))], None)


def _answer_pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    return _batches(_ANSWERS, _pair_answers(batches, parts))


def _word_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each word asked for, the sums of what follows it and how many
    different words come before it."""
    for base, p, learned, asked in _groups(batches):
        all_words = np.concatenate([np.zeros(0, np.uint32), *[_unpack_sorted(x["data"][0], np.uint32) for x in learned]])
        words, of = np.unique(all_words, return_inverse=True)
        columns = []
        for i in range(1, 6):
            sums = np.zeros(len(words), np.int64)
            np.add.at(sums, of, np.concatenate([np.zeros(0, np.int64), *[_unpack(x["data"][i], np.int64) for x in learned]]))
            columns.append(sums)
        yield (base, -1, p, STAT, None, _kinds(columns[4]))
        for row in asked:
            at, hit = _find(words, _unpack_sorted(row["data"][0], np.uint32))
            yield (base, row["slice"], p, WORDS_OF, [_pack(_taken(c, at, hit)) for c in columns], None)


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(_ANSWERS, _word_answers(batches))


# --- scores -----------------------------------------------------------------------------


def _discounts(kinds: list[int]) -> np.ndarray:
    n = [0, *kinds[:4]]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    cuts = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(c, 0.05), k - 0.05) for k, c in enumerate(cuts, 1)]])


def _interpolated(n: np.ndarray, sums: list[np.ndarray], cuts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    total = np.maximum(sums[0], 1)
    share = (n - cuts[np.minimum(n, 3)]) / total
    rest = np.where(sums[0] > 0, (cuts[1] * sums[1] + cuts[2] * sums[2] + cuts[3] * sums[3]) / total, 1.0)
    return share + rest * lower


def _losses(batches: Iterator[pa.RecordBatch], parts: int, kinds: dict) -> Iterator[pa.RecordBatch]:
    """(text_id, base, n_words, word_nats) of the texts of slices with all answers."""
    for row in _rows(batches):
        grams = _grams(row)
        words, _, w1, w2 = grams
        found = row["found"]
        of_grams, of_pairs, of_words = (kinds[row["base"], order] for order in (3, 2, 1))
        order, _ = _ask_words(words[:-1], parts)
        *after, before = [np.zeros(len(words), np.int64) for _ in range(5)]  # an unknown word has zeros
        for i, values in enumerate((*after, before)):
            values[order] = _column(found, WORDS_OF, i, np.int64)
        every = [np.array([x]) for x in (of_words[5], of_words[0], of_words[1], of_words[4] - of_words[0] - of_words[1])]
        p = _interpolated(before, every, _discounts(of_words), np.array([1.0 / (of_words[4] + 1)]))[w2]
        n = np.zeros(len(w2), np.int64)
        *_, which, known = _asked(grams, parts, True)
        n[known] = _column(found, PAIRS, 0, np.int64)[which]
        p = _interpolated(n, [x[w1] for x in after], _discounts(of_pairs), p)
        key, _, _, which, known = _asked(grams, parts, False)
        n, sums = np.zeros(len(w2), np.int64), [np.zeros(len(w2), np.int64) for _ in range(4)]
        n[known] = _column(found, GRAMS, 0, np.int64)[which]
        context = np.zeros(len(key), np.int64)
        context[_starts(key)] = 1
        context = (np.cumsum(context) - 1)[which]
        for i, x in enumerate(sums, 1):
            x[known] = _column(found, GRAMS, i, np.int64)[context]
        p = _interpolated(n, sums, _discounts(of_grams), p)
        lengths = _unpack(row["lengths"], np.int64)
        nats = -np.add.reduceat(np.log(p), np.cumsum(lengths) - lengths) / lengths
        yield pa.RecordBatch.from_arrays(
            [pa.array(_unpack(row["texts"], np.int64)), pa.array([row["base"]] * len(lengths), pa.string()), pa.array(lengths), pa.array(nats)],
            names=["text_id", "base", "n_words", "word_nats"],
        )


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("base", "part").sortWithinPartitions("base", "part", "judged")


def _with_answers(slices: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each slice and all its answers, joined by shuffle at every size."""
    found = answers.groupBy("slice").agg(F.collect_list(F.struct("part", "kind", "data")).alias("found"))
    return slices.join(found.hint("merge"), "slice")


def _kinds_of(answers: DataFrame) -> dict[str, list[int]]:
    """One row for each model."""
    sums = [F.sum(F.col("stat")[i]) for i in range(6)]
    return {r[0]: list(r[1:]) for r in answers.filter(F.col("kind") == STAT).groupBy("base").agg(*sums).collect()}


def _half_scores(texts: DataFrame, parts: int) -> DataFrame:
    """Scores of the texts (text_id, text, base, trained) that are not trained under
    the models of those that are."""
    kept = staged()

    def table(frame: DataFrame, *others: str) -> DataFrame:
        """Staged, its shuffled files and all tables but ``others`` removed."""
        found = stage_table(frame, keep_shuffles=False)
        release(keep=[*kept, *others, staged()[-1]])
        return found

    def spread(frame: DataFrame, function: Callable, schema: str, **options) -> DataFrame:
        return frame.mapInArrow(partial(function, **options) if options else function, schema)

    slices = table(spread(texts, _cut_slices, _SLICE))
    cut = staged()[-1]
    asked = spread(slices.select("slice", "base", "trained", "words"), _dictionaries, _BLOCK, parts=parts)
    numbers = table(spread(_dealt(asked), _number, _ANSWER, parts=parts), cut)
    numbered, keep, coded = staged()[-1], [], None
    for step in range(RECODED_IN):
        mine = F.pmod("slice", F.lit(RECODED_IN)) == step
        found = _with_answers(slices.drop("words").filter(mine), numbers.filter(mine))
        part = table(spread(found, _recode, _SLICE), cut, numbered, *keep)
        keep.append(staged()[-1])
        coded = part if coded is None else coded.union(part)
    release(keep=[*kept, *keep])
    judged = coded.filter(~F.col("trained"))
    answers, kinds = [], {}
    for order, answer, options in ((3, _answer_grams, {}), (2, _answer_pairs, {"parts": parts})):
        dealt = _dealt(spread(coded, _deal_grams, _BLOCK, parts=parts, pairs=order == 2))
        answers.append(table(spread(dealt, answer, _ANSWER, **options), *keep))
        keep.append(staged()[-1])
        kinds |= {(base, order): x for base, x in _kinds_of(answers[-1]).items()}
    sums = answers[-1].filter(F.col("kind") == WORD_SUMS).select("base", "part", F.lit(False).alias("judged"), "slice", "data")
    words = _dealt(spread(judged, _deal_words, _BLOCK, parts=parts).union(sums))
    answers.append(table(spread(words, _answer_words, _ANSWER), *keep))
    kinds |= {(base, 1): x for base, x in _kinds_of(answers[-1]).items()}
    replies = answers[0].union(answers[1]).union(answers[2]).filter("slice >= 0")
    scored = spread(_with_answers(judged, replies), _losses, "text_id long, base string, n_words long, word_nats double", parts=parts, kinds=kinds)
    return table(scored)


def base_of(lang: Column) -> Column:
    """The name of a language's models; no language is called like ``OTHER``."""
    return F.concat(F.lit("="), lang)


def half_model(base: Column, half: Column) -> Column:
    return F.concat_ws("|", base, half.cast("string"))


def text_id(text: str = "text") -> Column:
    """Equal texts under one model have one score, so they share its id."""
    return F.xxhash64(text)


def half_of(text_id: Column) -> Column:
    return F.pmod(text_id, F.lit(2)).cast("int")


def two_halves(trusted: DataFrame) -> DataFrame:
    """The names of the models (own) that the trusted documents (text, lang, half)
    have for both halves, a row for each language and one for all together."""
    some = trusted.filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("lang", "half").distinct()
    names = some.select(F.explode(F.array(base_of(F.col("lang")), F.lit(OTHER))).alias("own"), "half").filter("own IS NOT NULL").distinct()
    return stage_table(names.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("own"), keep_shuffles=False)


def with_model(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``rows`` (lang, half) with ``base``, whose models judge a row, and ``model``,
    that of the other half. Where neither the language nor all languages together
    have two halves (``whole``), both are null and a row is not judged by words."""
    pooled = F.lit(None).cast("string") if whole.filter(F.col("own") == OTHER).isEmpty() else F.lit(OTHER)
    found = rows.withColumn("wanted", base_of(F.col("lang"))).join(whole, F.col("wanted") == F.col("own"), "left")
    base = F.coalesce("own", pooled)
    return found.withColumn("base", base).withColumn("model", F.when(base.isNotNull(), half_model(base, 1 - F.col("half")))).drop("wanted", "own")


def word_scores(judged: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text_id, model, n_words, word_nats): the mean loss of the different
    texts of ``judged`` (text_id, text, base, half) that have words, under the model of
    the ``trusted`` (text_id, text, base, half) of the other half."""
    judged = judged.filter("base IS NOT NULL")
    size = judged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, 1 + size // (2 * PART_BYTES))
    columns = ("text_id", "text", "base")
    found = None
    for half in (0, 1):
        texts = trusted.filter(F.col("half") == half).select(*columns, F.lit(True).alias("trained")).union(
            judged.filter(F.col("half") == 1 - half).select(*columns, F.lit(False).alias("trained"))
        )
        part = _half_scores(texts, parts).select("text_id", half_model(F.col("base"), F.lit(half)).alias("model"), "n_words", "word_nats")
        found = part if found is None else found.union(part)
    # copies in several slices have the same sums
    return found.groupBy("text_id", "model").agg(F.min("n_words").alias("n_words"), F.min("word_nats").alias("word_nats"))
