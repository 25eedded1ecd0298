"""Language of a text by its words first, then by ever shorter n-grams.

Words are runs of letters, lower-cased. A word that some language knows scores by
the logarithm of its relative frequency there; a language that does not know it
gets a fixed penalty. A word that no language knows is looked at through its
character n-grams, the longest first: the first length of which any gram is known
gives the mean over the word's grams. A text has the mean over its words.

What is stored is the gain over the penalty, in whole millionths, so that only known
(word, language) pairs have rows and sums do not depend on their order. The tables
of words and grams grow with the corpus and stay distributed. Scoring takes the
most frequent words, a table of bounded size, to the tasks; all others are joined
as one row for each document and word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane.llm import tokens as T
from clearlane.operators.ranking import sequence_number
from clearlane.operators.staging import stage, stage_table

UNKNOWN = "und"
LONGEST = 5  # letters of the longest n-grams, borders of words included
# a longer run of letters is cut into words of this length
WORD = 64
SLICE_BYTES = 4 << 20
# words that are sent to all tasks, and languages each of them may have
HEAD_WORDS = 1 << 17
HEAD_LANGUAGES = 32
UNIT = 1_000_000  # parts of a nat
LETTERS = r"[\pL\pM]"


def bag(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the number of each word, and the words."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    while True:
        split = pc.split_pattern_regex(lower, pattern=f"[^{LETTERS[1:-1]}]+")
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        flat = split.flatten()
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        filled = pc.not_equal(flat, "")
        known = flat.filter(filled).dictionary_encode()
        lengths = pc.utf8_length(known.dictionary)
        if not len(lengths) or pc.max(lengths).as_py() <= WORD:
            return doc[filled.to_numpy(zero_copy_only=False)], known.indices.to_numpy(zero_copy_only=False), known.dictionary
        lower = pc.replace_substring_regex(lower, pattern=f"({LETTERS}{{{WORD}}})", replacement=r"\1 ")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each slice; lang is null for texts not learned from."""
    for batch in T.slices(batches, "text", SLICE_BYTES):
        doc, code, words = bag(batch.column("text"))
        langs, of = np.unique(["" if x is None else "=" + x for x in batch.column("lang").to_pylist()], return_inverse=True)
        keys, ns = np.unique(of[doc] * np.int64(len(words)) + code, return_counts=True)
        lang, word = keys // max(1, len(words)), keys % max(1, len(words))
        names = pa.array([x[1:] if x else None for x in langs.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(lang)), words.cast(pa.string()).take(pa.array(word)), pa.array(ns.astype(np.int64))], names=["lang", "word", "n"]
        )


def _gain(n: Column, total: Column, penalty: float) -> Column:
    """What a language wins over the penalty, in whole parts; one at least."""
    return F.greatest(F.round((F.lit(penalty) + F.log(n / total)) * UNIT).cast("long"), F.lit(1))


def _grams(word: Column, n: int) -> Column:
    """The n-grams of a word with a blank at each end."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    places = F.sequence(F.lit(1), F.length(padded) - (n - 1))
    return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.substring(padded, i, F.lit(n))))


class Model:
    """What is learned from texts of known language.

    ``langs`` (g, lang, total) numbers the languages, those with most words first.
    ``gains`` (word, n, gains array<struct<g, gain>>) has every word of the corpus
    that some language knows, itself or by a gram."""

    def __init__(self, rows: DataFrame):
        """``rows`` (text, lang); texts with a null language are only looked up."""
        counted = rows.filter("length(text) > 0").mapInArrow(_word_counts, "lang string, word string, n long")
        counts = stage_table(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
        learned = counts.filter("lang IS NOT NULL")
        totals = stage(learned.groupBy("lang").agg(F.sum("n").alias("total"), (-F.sum("n")).alias("minus")))
        numbered = sequence_number(totals, ["minus", "lang"], "g")
        self.langs = stage(numbered.select((F.col("g") - 1).cast("int").alias("g"), "lang", "total"))
        self.n_langs, most = self.langs.agg(F.count(F.lit(1)), F.max("total")).first()
        if not self.n_langs:
            return
        self.penalty = float(np.log(most)) + 1.0
        known = learned.join(self.langs, "lang").select("word", "g", "n", _gain(F.col("n"), F.col("total"), self.penalty).alias("gain"))
        # all words, with what they occur; those learned have gains
        every = counts.groupBy("word").agg(F.sum("n").alias("n"), F.count("lang").alias("langs"))
        every = stage_table(every)
        entries = known.groupBy("word").agg(F.collect_list(F.struct("g", "gain")).alias("gains"))
        found = entries.join(every.select("word", "n"), "word").select("word", "n", "gains")
        rest = every.filter("langs = 0").select("word", "n")
        self.gains = stage_table(found.union(self._by_grams(rest, known.select("word", "g", "n"))))

    def _by_grams(self, rest: DataFrame, known: DataFrame) -> DataFrame:
        """(word, n, gains) of words that no language knows."""
        rest, out = stage_table(rest), None
        for size in range(LONGEST, 0, -1):
            if rest.isEmpty():
                break
            own = rest.select("word", "n", F.explode(_grams(F.col("word"), size)).alias("gram"))
            # grams of all learned words in a language: no need to list them
            lengths = F.greatest(F.length("word") + 2 - (size - 1), F.lit(0))
            total = known.groupBy("g").agg(F.sum(lengths * F.col("n")).alias("grams"))
            wanted = own.select("gram").distinct()
            counted = known.select("g", "n", F.explode(_grams(F.col("word"), size)).alias("gram")).groupBy("gram", "g").agg(F.sum("n").alias("c"))
            gains = counted.join(wanted, "gram", "left_semi").join(total, "g").select("gram", "g", _gain(F.col("c"), F.col("grams"), self.penalty).alias("gain"))
            mean = F.greatest((F.sum("gain") / (F.length("word") + 2 - (size - 1))).cast("long"), F.lit(1))
            part = (
                own.join(gains, "gram")
                .groupBy("word", "n", "g")
                .agg(mean.alias("gain"))
                .groupBy("word", "n")
                .agg(F.collect_list(F.struct("g", "gain")).alias("gains"))
            )
            part = stage_table(part)
            out = part if out is None else out.union(part)
            if size > 1:
                rest = stage_table(rest.join(part.select("word"), "word", "left_anti"))
        return rest.select("word", "n", F.lit(None).cast("array<struct<g:int,gain:bigint>>").alias("gains")).limit(0) if out is None else out

    def head(self) -> pa.Table:
        """(word, gains) of the most frequent words, at most ``HEAD_WORDS``."""
        few = self.gains.filter(F.size("gains") <= HEAD_LANGUAGES)
        step = F.floor(F.log2("n") * 8)
        steps = few.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect()  # some hundred at most
        least, words = float("inf"), 0
        for row in steps:
            words += row["n"]
            if words > HEAD_WORDS:
                break
            least = row["step"]
        return few.filter(step >= F.lit(least)).select("word", "gains").toArrow()


def _scored(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, held_out, letters, n_words, gains, tail): the sums of the
    frequent words, and the other words with their counts."""
    words, first, lang, gain = head.value
    known = pa.array(words, pa.string())
    row = TaskContext.get().partitionId() << 40
    for batch in T.slices(batches, "text", SLICE_BYTES):
        n = batch.num_rows
        doc, code, found = bag(batch.column("text"))
        pairs, times = np.unique(doc * np.int64(max(1, len(found))) + code, return_counts=True)
        doc, code = pairs // max(1, len(found)), pairs % max(1, len(found))
        place = pc.fill_null(pc.index_in(found.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        hit = place >= 0
        size = np.where(hit, first[np.maximum(place, 0) + 1] - first[np.maximum(place, 0)], 0) if len(first) > 1 else np.zeros(len(code), np.int64)
        of = np.repeat(np.arange(len(code)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[np.maximum(place, 0)][of]
        keys, inverse = np.unique(doc[of] * np.int64(1 << 31) + lang[at], return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, gain[at] * times[of])
        gains = pa.StructArray.from_arrays([pa.array((keys & ((1 << 31) - 1)).astype(np.int32)), pa.array(sums)], names=["g", "gain"])
        tail = pa.StructArray.from_arrays([found.cast(pa.string()).take(pa.array(code[~hit])), pa.array(times[~hit].astype(np.int64))], names=["word", "times"])
        bounds = lambda docs: pa.array(np.searchsorted(docs, np.arange(n + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + n)),
                batch.column("doc_id"),
                batch.column("held_out"),
                pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\pL"), False),
                pa.array(np.bincount(doc, weights=times, minlength=n).astype(np.int64)),
                pa.ListArray.from_arrays(bounds(keys >> 31), gains),
                pa.ListArray.from_arrays(bounds(doc[~hit]), tail),
            ],
            names=["row", "doc_id", "held_out", "letters", "n_words", "gains", "tail"],
        )
        row += n


_ROWS = "row long, doc_id long, held_out boolean, letters boolean, n_words long, gains array<struct<g:int,gain:long>>, tail array<struct<word:string,times:long>>"


def predict(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, n_words.

    Texts for which ``learn`` (a condition on the id) holds and whose language is
    not null are learned from; ``held_out`` says that the condition is false.
    ``score`` is the share of the predicted language when the mean scores of all
    learned languages are made probabilities. A null text, and one without a letter,
    is ``und`` with score 0. A text of which nothing is known goes to the language
    with most words, with an equal share for all. Equal scores go to the language
    with more words, then to the name that comes first. If nothing can be learned,
    all texts are ``und``. Rows without an id are not learned from and not held out.
    Equal texts have equal results; repeated rows are learned from as often as they
    occur. Further columns are not read; an empty table gives no rows.
    """
    known = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    learn = F.coalesce(learn, F.lit(False))
    model = Model(known.select("text", F.when(learn, F.col("lang")).alias("lang")))
    held_out = (~learn & F.col("doc_id").isNotNull()).alias("held_out")
    if not model.n_langs:
        return known.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("n_words"))
    head = model.head()
    lists = head.column("gains").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    entries = lists.flatten()
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    parts = (head.column("word").to_pylist(), first, entries.field("g").to_numpy(zero_copy_only=False).astype(np.int64), entries.field("gain").to_numpy(zero_copy_only=False))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(parts)  # HEAD_WORDS words of at most HEAD_LANGUAGES languages
    rows = stage_table(known.select("doc_id", "text", held_out).mapInArrow(partial(_scored, head=sent), _ROWS))
    sent.destroy()
    rare = (
        rows.select("row", F.explode("tail").alias("x"))
        .select("row", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
        .join(model.gains.select("word", "gains"), "word")
        .select("row", F.explode("gains").alias("y"), "times")
        .select("row", F.col("y.g").alias("g"), (F.col("y.gain") * F.col("times")).alias("gain"))
    )
    sums = rows.select("row", F.explode("gains").alias("y")).select("row", "y.g", "y.gain").union(rare).groupBy("row", "g").agg(F.sum("gain").alias("gain"))
    # at most a value for each language
    best = sums.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("minus"), "g"))).alias("order"))
    judged = rows.select("row", "doc_id", "held_out", "letters", "n_words").join(best, "row", "left")
    top = F.coalesce(F.get("order", F.lit(0))["g"], F.lit(0))
    nats = lambda x: x / (F.lit(float(UNIT)) * F.col("n_words"))
    lead = F.get("order", F.lit(0))["minus"]
    shares = F.aggregate("order", F.lit(0.0), lambda s, x: s + F.exp(nats(lead - x["minus"])))
    shares = shares + (F.lit(model.n_langs) - F.size("order")) * F.exp(nats(lead))
    score = F.when(F.col("order").isNull(), F.lit(1.0 / model.n_langs)).otherwise(1.0 / shares)
    named = judged.withColumn("g", top).join(model.langs.select("g", "lang"), "g")
    return named.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letters"), score).otherwise(0.0).alias("score"),
        "n_words",
    )
