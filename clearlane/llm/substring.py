"""Removal of passages that an earlier document already has, by relative
Lempel-Ziv parsing.

The reference of a document is all documents with a smaller id. Its index is
cut into blocks by hash, and every document is factored against every block:

1. Phrases. Every window of ``window`` words is assigned the smallest hash of
   the ``anchor`` words long sequences in it. Consecutive windows with the same
   anchor form one phrase (about one for ``(window - anchor) / 2`` words), so
   equal passages are cut in the same way wherever they stand.
2. Index. Each phrase is stored with the earliest document that has it. The
   index is a grouped table, combined before it is shuffled, so that a passage
   that a third of all documents share is one row a task.
3. Greedy factors. A phrase that an earlier document has is taken whole. Such
   phrases, joined end to end, are the long factors.
4. Factor boundaries. Where an anchor is shared but the phrase around it is
   new, the common part ends inside the phrase. Only there, each window is
   looked up on its own among the windows of the other phrases of that anchor.

Hashes have 128 bits (anchor and phrase, or two window hashes). Shared anchors
lead back to the rows by joins on the anchor, which Spark splits when skewed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane.llm import tokens as T
from clearlane.operators.staging import stage_table

WINDOW = 50
ANCHOR = 11
KEY = ["doc_id", "part"]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``values[i : i + width]`` for each i that has so many."""
    low, reach = values, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _phrases(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text"):
        w = T.words(batch.column("text"))
        if w.n < window:
            continue
        g = w.hashes()
        keys = T.Rolling(g, T.BASES[1])
        at = np.arange(w.n - anchor + 1)
        low = _sliding_min(T.mix(keys.of(at, at + anchor)), window - anchor + 1)
        valid = w.left()[: len(low)] >= window
        doc = w.document()[: len(low)]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        # the stretch between the last window of a document and the next
        # document's first word is invalid, so runs never reach across it
        edge = np.flatnonzero(new & valid)
        if not len(edge):
            continue
        last = np.append(np.flatnonzero(new)[1:], len(low))
        stop = last[np.searchsorted(np.flatnonzero(new), edge)]
        stop = np.minimum(stop, w.first[1:][doc[edge]] - window + 1)
        phrase = T.mix(T.Rolling(g, T.BASES[2]).of(edge, stop + window - 1) + (stop - edge).astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(T.signed(low[edge])),
                pa.array(T.signed(phrase)),
                *[batch.column(c).take(pa.array(doc[edge])) for c in KEY],
                pa.array((edge - w.first[doc[edge]]).astype(np.int32)),
                pa.array((stop - edge).astype(np.int32)),
            ],
            names=["anchor", "phrase", "doc_id", "part", "at", "n"],
        )


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i] + 0 .. n[i] - 1`` for all i, one after another."""
    total = int(n.sum())
    before = np.cumsum(n) - n
    return np.repeat(first - before, n) + np.arange(total)


def _boundary_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text"):
        w = T.words(batch.column("text"))
        spans = pc.fill_null(batch.column("open"), pa.scalar([], batch.column("open").type))
        sizes = np.diff(spans.offsets.to_numpy())
        flat = spans.flatten()
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        first = flat.field("at").to_numpy(zero_copy_only=False) + w.first[owner]
        at = _spread(first, n)
        if not len(at):
            continue
        owner = np.repeat(owner, n)
        g = w.hashes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(T.signed(T.Rolling(g, T.BASES[1]).of(at, at + window))),
                pa.array(T.signed(T.Rolling(g, T.BASES[2]).of(at, at + window))),
                *[batch.column(c).take(pa.array(owner)) for c in KEY],
                pa.array((at - w.first[owner]).astype(np.int32)),
            ],
            names=["w1", "w2", "doc_id", "part", "at"],
        )


def removed_mask(n_words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words the spans (first word, number of words) cover."""
    edges = np.zeros(n_words + 1, np.int32)
    for first, n in spans:
        edges[first] += 1
        edges[first + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text", 1 << 22):
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            all_words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            kept = all_words
            found = spans.as_py()
            if found:
                mask = removed_mask(len(all_words), [(s["first"], s["n"]) for s in found])
                kept = [x for x, gone in zip(all_words, mask.tolist(), strict=True) if not gone]
            joined = b" ".join(kept)
            n_words.append(len(all_words))
            n_removed.append(len(all_words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept_texts.append(joined.decode("utf-8", "replace"))
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        if with_text:
            columns.append(pa.array(kept_texts, pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``part`` tells rows apart that share an id but not the text."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.hash(docs[text_col]).alias("part"), docs[text_col].alias("text")
    )


def duplicate_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """Per document with repeated passages, ``spans``: arrays of (first word,
    number of words), which may overlap. Together they cover exactly the words
    of every window that starts in a document with a smaller id.

    Rows without an id are nobody's reference and have no spans. Rows that
    share an id do not repeat each other; ``part``, a hash of the text, tells
    them apart.
    """
    return _spans(_base(docs, id_col, text_col), window, anchor)


def _spans(base: DataFrame, window: int, anchor: int) -> DataFrame:
    phrases = base.filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1)).mapInArrow(
        partial(_phrases, window=window, anchor=anchor), "anchor long, phrase long, doc_id long, part int, at int, n int"
    )
    index = phrases.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("uses"))
    shared = (
        index.groupBy("anchor")
        .agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("forms"))
        .filter("uses > 1")
        .select("anchor", "forms")
    )
    known = index.filter("uses > 1").select("anchor", "phrase", "earliest")
    factors = (
        phrases.join(shared, "anchor")
        .join(known, ["anchor", "phrase"], "left")
        .withColumn("taken", F.coalesce(F.col("earliest") < F.col("doc_id"), F.lit(False)))
        .filter("taken OR forms > 1")
    )
    whole = F.struct(F.col("at").alias("first"), (F.col("n") + (window - 1)).alias("n"))
    # a row that stands twice in the table has each of its pieces once
    per_doc = stage_table(
        factors.groupBy(*KEY).agg(
            F.collect_set(F.when(F.col("taken"), whole)).alias("taken"),
            F.collect_set(F.when(~F.col("taken"), F.struct("at", "n"))).alias("open"),
        )
    )
    # both passes over the texts read the same shuffle, so neither filters it
    boundary = (
        base.join(per_doc.select(*KEY, "open").hint("shuffle_hash"), KEY, "left")
        .select(*KEY, "text", "open")
        .mapInArrow(partial(_boundary_windows, window=window), "w1 long, w2 long, doc_id long, part int, at int")
    )
    earliest = (
        boundary.groupBy("w1", "w2")
        .agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
        .filter("earliest < latest")
    )
    found = (
        boundary.join(earliest, ["w1", "w2"])
        .filter("earliest < doc_id")
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct(F.col("at").alias("first"), F.lit(window).alias("n"))).alias("spans"))
    )
    taken = per_doc.filter(F.size("taken") > 0).select(*KEY, F.col("taken").alias("spans"))
    both = taken.join(found.withColumnRenamed("spans", "more"), KEY, "full")
    none = F.array().cast("array<struct<first:int,n:int>>")
    return both.select(*KEY, F.concat(F.coalesce("spans", none), F.coalesce("more", none)).alias("spans"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 of the
    kept words joined by one space, and the kept text itself.

    A null or empty text has no words and the hash of the empty string. Texts
    shorter than ``window`` words are kept whole. A row without an id keeps all
    words. Other columns of the input are ignored.
    """
    base = _base(docs, id_col, text_col)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return (
        base.join(_spans(base, window, ANCHOR).hint("shuffle_hash"), KEY, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(partial(_cut, names=names, with_text=with_text), schema)
    )
