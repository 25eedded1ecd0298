"""Benchmark items in documents, also reworded ones, by latent semantic
retrieval.

1. The vocabulary are the words of the benchmark; all others cannot count for a
   match. Their document frequencies are taken over all documents.
2. Documents are kept as word numbers if any of their passages has
   ``MIN_TERMS`` weighty words; only these can be found. A passage is a window of
   ``PASSAGE`` words at every half window, and a sparse TF-IDF vector over the
   vocabulary without the most common words. The text of all documents is read
   twice, however many items there are; all that follows reads the word numbers.
3. A randomised SVD gives the ``RANK`` leading directions of the passages and
   items together, where the few items have as much weight as all passages.
   With a random start, two passes over the passages compute A'(A Q); tasks add
   up their own products, and Spark sums them by term.
4. Passages and items are compared by cosine in that space, relative to the
   share of the item that the space holds. An item of more than ``WHOLE`` words is
   looked for by its own passages, any of which can show it.
5. For the candidates, the longest common subsequence of the whole item and the
   words where it would be, as a share of the item, decides, together with the
   answer: the item's last words have to be there, in order.

The SVD and the comparison take ``ITEMS`` items or passages of items at a time,
which bounds the directions' share of each and everything that is broadcast. The
benchmark itself is taken ``WORDS`` words at a time. Sums of single precision
depend on the order of tasks, so a pair that has the limit of the cosine to the
last digits can be a candidate in one run and none in another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane.llm import tokens as T
from clearlane.operators.staging import stage_table

PASSAGE = 32
STEP = 16
# words that may stand between those of an item, and a share of its length more
AROUND = 20
STRETCH = 8
# words of an item that is compared as a whole
WHOLE = 64
# words of the items that are looked for at once
WORDS = 1 << 20
RANK = 256
ITEMS = RANK // 2  # half of the weight is the items', so a block fits the directions
OVERSAMPLING = 16
ITEMS_AT_ONCE = 16
# words in more than this share of documents, and in more than ``FEW``, are left
# out of the vectors, but for the rarest words of each item
COMMON = 0.02
FEW = 20
SLICE = 1 << 20  # bytes of word numbers that are handled at once
RAREST = 8
MIN_TERMS = 2
COSINE = 0.4
# an item is there if so much of it is, in order
LCS_ALONE = 0.7
LCS_WITH_ANSWER = 0.5
ANSWER_WORDS = 3


@dataclass
class Vocabulary:
    """Sorted word hashes; ``items`` are the word numbers of each item."""

    hashes: np.ndarray
    items: list[np.ndarray]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for words that no item has."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class Terms:
    """The words of a block: ``local`` gives the number of a word among them, or
    -1, ``weight`` its weight, ``rows`` the numbers of each wanted passage."""

    local: np.ndarray
    weight: np.ndarray
    rows: list[np.ndarray]


@dataclass
class Wanted:
    """A passage of an item, or a whole one: the item, and its first word there."""

    item: int
    offset: int
    words: np.ndarray


def vocabulary_of(texts: list[str]) -> Vocabulary:
    w = T.words(pa.array(texts, pa.string()), lower=True)
    g = w.hashes() if w.n else np.zeros(0, np.uint64)
    hashes, numbers = np.unique(g, return_inverse=True)
    return Vocabulary(hashes, [numbers[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)])


def wanted_passages(items: list[np.ndarray]) -> list[Wanted]:
    found = []
    for i, words in enumerate(items):
        n = len(words)
        starts = [0] if n <= WHOLE else [*range(0, n - PASSAGE, STEP), n - PASSAGE]
        found += [Wanted(i, at, words if n <= WHOLE else words[at : at + PASSAGE]) for at in starts if n]
    return found


def _numbered(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    w = T.words(column, lower=True)
    return (vocabulary.number(w.hashes()) if w.n else np.zeros(0, np.int64)), w.first


def _stored_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of stored documents, and where each begins."""
    data, offsets = T.text_bytes(column)
    return np.frombuffer(data.tobytes(), np.int32).astype(np.int64), offsets // 4


def _able(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The documents with a passage that has enough weighty words, as numbers."""
    vocabulary, weighs = shared.value
    for batch in T.slices(batches, "text"):
        number, first = _numbered(batch.column("text"), vocabulary)
        docs = np.unique(_vectors(number, first, weighs)[0])
        if len(docs):
            number = number.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs)), pa.array([number[first[d] : first[d + 1]].tobytes() for d in docs], pa.binary())],
                names=["doc_id", "numbers"],
            )


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Documents of a task that have a word, and their number under -1."""
    vocabulary = shared.value
    found, docs = np.zeros(len(vocabulary.hashes), np.int64), 0
    for batch in T.slices(batches, "text"):
        number, first = _numbered(batch.column("text"), vocabulary)
        docs += batch.num_rows
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        hit = number >= 0
        pairs = np.unique(doc[hit] * len(found) + number[hit]) if len(found) else np.zeros(0, np.int64)
        found += np.bincount(pairs % max(1, len(found)), minlength=len(found))
    seen = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(seen, -1)), pa.array(np.append(found[seen], docs))], names=["term", "n"]
    )


def _vectors(number: np.ndarray, first: np.ndarray, weight: np.ndarray):
    """Passages with enough weighty terms: their document and first word, and
    their vectors as (passage, term, value), sorted by passage."""
    hit = np.flatnonzero(number >= 0)
    hit = hit[weight[number[hit]] > 0]
    doc = np.searchsorted(first, hit, "right") - 1
    local = hit - first[doc]
    # a word is in the passage that begins at its step, and in the one before
    passage = np.concatenate([local // STEP, local // STEP - 1])
    doc, term = np.tile(doc, 2), np.tile(number[hit], 2)
    valid = passage >= 0
    passage, doc, term = passage[valid], doc[valid], term[valid]
    width = int(passage.max()) + 1 if len(passage) else 1
    terms = max(1, len(weight))
    key, tf = np.unique((doc * width + passage) * terms + term, return_counts=True)
    place, term = key // terms, key % terms
    row_first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(row_first, len(place)))
    enough = np.repeat(sizes >= MIN_TERMS, sizes)
    place, term, tf = place[enough], term[enough], tf[enough]
    rows, row = np.unique(place, return_inverse=True)
    value = (1 + np.log(tf)) * weight[term]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(rows)))
    return rows // width, rows % width * STEP, row, term, value / norm[row]


def _local(number: np.ndarray, terms: Terms) -> np.ndarray:
    return np.where(number >= 0, terms.local[number], -1)


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The sparse rows times ``basis``."""
    if not len(row):
        return np.zeros((n, basis.shape[1]), basis.dtype)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return np.add.reduceat(basis[term] * value[:, None].astype(basis.dtype), starts, axis=0)


def _gram(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A'(A Q) of the passages of a task, one row for each term it has."""
    terms, basis = shared.value
    total, passages = np.zeros(basis.shape, np.float32), 0
    for batch in T.slices(batches, "numbers", SLICE):
        number, first = _stored_numbers(batch.column("numbers"))
        _, _, row, term, value = _vectors(_local(number, terms), first, terms.weight)
        if not len(row):
            continue
        product = _times(row, term, value, int(row[-1]) + 1, basis)
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
        total[term[order][starts]] += np.add.reduceat(
            product[row[order]] * value[order][:, None].astype(np.float32), starts, axis=0
        )
        passages += int(row[-1]) + 1
    # the number of passages goes with the terms, in the place after the last
    total = np.append(total, np.full((1, basis.shape[1]), passages, np.float32), axis=0)
    seen = np.flatnonzero(np.abs(total).sum(axis=1))
    yield _rows_of(seen, total[seen])


def _rows_of(term: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(term) + 1, dtype=np.int32) * vectors.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(term), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=["term", "v"])


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of a partition's terms, which come one after the other."""
    last, total = None, None
    for batch in parts:
        if not batch.num_rows:
            continue
        term = batch.column("term").to_numpy()
        vectors = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        sums, term = np.add.reduceat(vectors, first, axis=0), term[first]
        if last == term[0]:
            sums[0] += total
        elif last is not None:
            yield _rows_of(np.array([last]), total[None, :])
        last, total = term[-1], sums[-1]
        if len(term) > 1:
            yield _rows_of(term[:-1], sums[:-1])
    if last is not None:
        yield _rows_of(np.array([last]), total[None, :])


def item_vectors(terms: Terms):
    """(row, term, value) of the wanted passages; those without a weighty term have
    none."""
    n = max(1, len(terms.weight))
    row = np.repeat(np.arange(len(terms.rows)), [len(x) for x in terms.rows])
    term = np.concatenate([*terms.rows, np.zeros(0, np.int64)]).astype(np.int64)
    weighty = terms.weight[term] > 0 if len(term) else np.zeros(0, bool)
    key, tf = np.unique(row[weighty] * n + term[weighty], return_counts=True)
    row, term = key // n, key % n
    value = (1 + np.log(tf)) * terms.weight[term]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(terms.rows)))
    return row, term, value / norm[row]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x)[0]


def latent_basis(numbered: DataFrame, terms: Terms, rank: int = RANK) -> np.ndarray:
    """(terms, rank): the leading right singular vectors of passages and items."""
    context = numbered.sparkSession.sparkContext
    n = len(terms.weight)
    width = min(n, rank + OVERSAMPLING)
    basis = _orthonormal(np.random.Generator(np.random.PCG64(5)).standard_normal((n, width)))
    row, term, value = item_vectors(terms)
    rows, at = np.unique(row, return_inverse=True)
    for last in (False, True):
        shared = context.broadcast((terms, basis.astype(np.float32)))
        parts = numbered.mapInArrow(partial(_gram, shared=shared), "term long, v array<float>")
        dealt = parts.repartition("term").sortWithinPartitions("term")
        # at most ITEMS * WHOLE terms
        summed = dealt.mapInArrow(_summed, "term long, v array<float>").toArrow().combine_chunks()
        product = np.zeros((n + 1, basis.shape[1]))
        if summed.num_rows:
            product[summed.column("term").to_numpy()] = summed.column("v").chunk(0).flatten().to_numpy().reshape(summed.num_rows, -1)
        product, passages = product[:n], max(1.0, product[n, 0])
        # some items at a time, as the driver holds little
        for first in range(0, len(rows), ITEMS_AT_ONCE):
            mine = slice(*np.searchsorted(at, [first, first + ITEMS_AT_ONCE]))
            row = at[mine] - first
            own = _times(row, term[mine], value[mine], min(ITEMS_AT_ONCE, len(rows) - first), basis)
            np.add.at(product, term[mine], own[row] * value[mine, None] * (passages / max(1, len(rows))))
        shared.destroy()
        if not last:
            basis = _orthonormal(product)
    # basis' A'A basis: its eigenvectors turn the basis into singular vectors
    values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
    return basis @ turn[:, np.argsort(-values)[:rank]]


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence; one bit for each item word."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    rest = full
    for word in text[text >= 0].tolist():
        here = rest & places.get(word, 0)
        rest = ((rest + here) | (rest - here)) & full
    return len(item) - rest.bit_count()


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    terms, basis, latent, wanted, items, ids, answers = shared.value
    for batch in T.slices(batches, "numbers", SLICE):
        number, first = _stored_numbers(batch.column("numbers"))
        doc, begin, row, term, value = _vectors(_local(number, terms), first, terms.weight)
        if not len(doc):
            continue
        projected = _times(row, term, value, len(doc), basis)
        # the rows have length 1, and what the basis leaves out is not alike
        passage, which = np.nonzero(projected @ latent.T >= COSINE)
        best: dict[tuple[int, int], tuple[float, bool, int]] = {}
        for p, k in zip(passage.tolist(), which.tolist(), strict=True):
            found = wanted[k]
            item, key = items[found.item], (int(doc[p]), found.item)
            if best.get(key, (0.0,))[0] == 1.0:
                continue
            # where the item begins if this is the passage, and where it ends
            at = int(begin[p]) - found.offset
            spare = AROUND + len(item) // STRETCH
            lo, hi = at - len(found.words) - spare, at + PASSAGE + len(item) + spare
            lo, hi = max(0, lo) + first[doc[p]], min(max(0, hi) + first[doc[p]], first[doc[p] + 1])
            region = number[lo:hi]
            share = lcs(item, region) / len(item)
            if share < LCS_WITH_ANSWER:
                continue
            answer = answers[found.item]
            answered = len(answer) > 0 and lcs(answer, region) == len(answer)
            if share >= LCS_ALONE or answered:
                best[key] = max(best.get(key, (0.0, False, 0)), (share, answered, -int(begin[p])))
        if best:
            numbers = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    numbers.take(pa.array([k[0] for k in best])),
                    pa.array([ids[k[1]] for k in best], pa.int64()),
                    pa.array([k[1] for k in best], pa.int32()),
                    pa.array([-v[2] for v in best.values()], pa.int32()),
                    pa.array([v[0] for v in best.values()], pa.float64()),
                    pa.array([v[1] for v in best.values()], pa.bool_()),
                ],
                names=["doc_id", "item_id", "item", "word", "lcs", "answered"],
            )


def _weighty(frequency: np.ndarray, docs: int, items: list[np.ndarray]) -> np.ndarray:
    """Words that are not common, and the rarest of each item."""
    weighs = frequency <= max(FEW, COMMON * docs)
    for item in items:
        own = np.unique(item)
        own = own[frequency[own] > 0]  # others cannot match
        weighs[own[np.argsort(frequency[own], kind="stable")[:RAREST]]] = True
    return weighs


def _block_leaks(numbered: DataFrame, wanted: list[Wanted], items: list[np.ndarray], ids: list[int], answers: list[np.ndarray], frequency: np.ndarray, docs: int) -> DataFrame:
    """The documents that hold an item, found by one of the ``wanted`` passages."""
    context = numbered.sparkSession.sparkContext
    words, at = np.unique(np.concatenate([w.words for w in wanted]), return_inverse=True)
    local = np.full(len(frequency), -1, np.int32)
    local[words] = np.arange(len(words))
    rows = np.split(at, np.cumsum([len(w.words) for w in wanted])[:-1])
    weighs = _weighty(frequency, docs, [w.words for w in wanted])[words]
    terms = Terms(local, np.where(weighs, np.log((1 + docs) / (1 + frequency[words])) + 1, 0.0), rows)
    basis = latent_basis(numbered, terms)
    row, term, value = item_vectors(terms)
    found, at = np.unique(row, return_inverse=True)
    latent = np.zeros((len(wanted), basis.shape[1]))
    latent[found] = _times(at, term, value, len(found), basis)
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    # the directions hold a part of an item only, and the same part of a copy's
    # passage; divided by its square, a copy has cosine 1 at any rank
    latent = np.divide(latent, length**2, out=np.zeros_like(latent), where=length > 1e-6)
    shared = context.broadcast((terms, basis.astype(np.float32), latent.astype(np.float32), wanted, items, ids, answers))
    schema = "doc_id long, item_id long, item int, word int, lcs double, answered boolean"
    written = stage_table(numbered.mapInArrow(partial(_search, shared=shared), schema))
    shared.destroy()
    return written


def _leaks_of(base: DataFrame, ids: list[int], texts: list[str], answers: list[str | None], block: int) -> DataFrame | None:
    context = base.sparkSession.sparkContext
    vocabulary = vocabulary_of([*texts, *[a or "" for a in answers]])
    items, given = vocabulary.items[: len(texts)], vocabulary.items[len(texts) :]
    wanted = wanted_passages(items)
    if not wanted:
        return None
    vocabulary.items = []
    shared = context.broadcast(vocabulary)
    counted = base.mapInArrow(partial(_frequencies, shared=shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # one row for each word of the items
    shared.destroy()
    frequency, docs = np.zeros(len(vocabulary.hashes) + 1), 0
    frequency[found.column("term").to_numpy()] = found.column("n").to_numpy()
    frequency, docs = frequency[:-1], max(1, int(frequency[-1]))  # the documents are under -1
    # as weights, so that documents are chosen as their passages are later
    weighs = _weighty(frequency, docs, [w.words for w in wanted]).astype(np.float64)
    shared = context.broadcast((vocabulary, weighs))
    numbered = stage_table(base.mapInArrow(partial(_able, shared=shared), "doc_id long, numbers binary"))
    shared.destroy()
    answer_words = [a if len(a) else item[-ANSWER_WORDS:] for a, item in zip(given, items, strict=True)]
    parts = None
    for at in range(0, len(wanted), block):
        part = _block_leaks(numbered, wanted[at : at + block], items, ids, answer_words, frequency, docs)
        parts = part if parts is None else parts.union(part)
    # several passages of a long item may show it
    best = F.max(F.struct("lcs", "answered", (-F.col("word")).alias("minus"))).alias("best")
    found = parts.groupBy("doc_id", "item_id", "item").agg(best)
    return found.select("doc_id", "item_id", (-F.col("best.minus")).alias("word"), F.col("best.lcs").alias("lcs"), F.col("best.answered").alias("answered"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    answer_col: str | None = None,
    block: int = ITEMS,
) -> DataFrame:
    """(doc_id, item_id, word, lcs, answered): the documents that hold an item,
    with the first word of the best passage and the share of the item in it.

    ``answer_col`` names the answers of the benchmark; without one, an item's
    last ``ANSWER_WORDS`` words are its answer. Words are lower-cased for A-Z.
    Items may have any length, and texts too: a task holds one text at a time.
    Items without words or id, and documents without words, match nothing.
    Repeated items are found each; rows that share a document id, or have none, are
    one document, with the best of their passages. Empty tables give no rows.
    ``block`` passages of items share an SVD.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).filter("length(text) > 0")
    answer = benchmark[answer_col].cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(
        benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text"), answer.alias("answer")
    ).filter("item_id IS NOT NULL AND length(text) > 0")
    waiting, words, found = [], 0, None

    def looked_for() -> DataFrame | None:
        part = _leaks_of(base, [r["item_id"] for r in waiting], [r["text"] for r in waiting], [r["answer"] for r in waiting], block)
        return found if part is None else part if found is None else found.union(part)

    # the items pass the driver one partition, and WORDS words, at a time
    for r in items.toLocalIterator():
        if waiting and words + len(r["text"]) // 2 > WORDS:
            found = looked_for()
            waiting, words = [], 0
        waiting.append(r)
        words += len(r["text"]) // 2 + 1  # a word and a blank have two characters at least
    if waiting:
        found = looked_for()
    if found is None:
        schema = "doc_id long, item_id long, word int, lcs double, answered boolean"
        return docs.sparkSession.createDataFrame([], schema)
    return found
