"""Quality by perplexity under interpolated modified Kneser-Ney models.

Two models judge a document, one of words (``word_grams``) and one of
characters, and either can reject it. The word model grows with the corpus.

The model of characters is bounded. Bytes fall into ``SYMBOLS`` classes (white space,
each lower-case letter, capitals, digits, full stop and comma, other signs, and
characters beyond ASCII), and a text is a sequence of classes that starts with a
border. With ``ORDER`` symbols an n-gram is a number below
``SYMBOLS ** ORDER``.

* Training reads every trusted document. Tasks count the n-grams of a batch and
  a grouping by (language, n-gram) adds the counts up; it is spread over the
  shuffle by n-gram. Context totals, continuation counts, discounts and the
  probabilities of seen n-grams are joins of such count tables.
* The finished table has at most ``SYMBOLS ** ORDER`` (1.05 million) rows for
  a model, whatever the size of the corpus. Only because of that bound it is
  broadcast, for ``LANGUAGES`` - 1 languages and all together at once: scoring is
  then one pass over the documents of these languages without a shuffle of
  texts, and further languages take further passes over theirs.
* A document is rejected if its perplexity is outside the quantiles of the
  trusted documents of its language. A model knows its own training text too
  well, so for the upper limit the trusted texts are halved by a hash of the text,
  and each half is scored by a model of the other one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearlane.llm import tokens as T
from clearlane.llm import word_grams
from clearlane.operators.staging import release, stage_table, staged

ORDER = 4
SYMBOLS = 32
LANGUAGES = 16
# trusted documents of a language that may lie below and above its limits
LOW, HIGH = 0.0005, 0.995
# allowance in nats for each symbol: for every document, and over the root of its
# length
SLACK = 0.03
SLACK_ROOT = 3.0
# the same for each word; the halves' models differ more
WORD_SLACK = 0.25
WORD_SLACK_ROOT = 9.0
OTHER = "*"  # the model of all languages together

BORDER, CAPITAL, DIGIT, STOP, SIGN, BEYOND = 0, 27, 28, 29, 30, 31
DROPPED = 255
COUNT_AT_ONCE = 4_000_000


def _classes() -> np.ndarray:
    table = np.full(256, SIGN, np.uint8)
    table[97:123] = np.arange(1, 27)
    table[65:91] = CAPITAL
    table[48:58] = DIGIT
    table[[ord("."), ord(",")]] = STOP
    table[T.SEPARATOR] = BORDER
    table[128:192] = BEYOND
    table[192:] = DROPPED  # the first byte of a longer character
    return table


CLASS = _classes()


def symbol_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, and the offsets of the texts."""
    data, offsets = T.text_bytes(column)
    symbols = CLASS[data]
    dropped = np.flatnonzero(symbols == DROPPED)
    if len(dropped):
        symbols, offsets = np.delete(symbols, dropped), offsets - np.searchsorted(dropped, offsets)
    code = symbols.astype(np.int32)
    for back in range(1, ORDER):
        code[back:] += symbols[:-back] * np.int32(SYMBOLS**back)
    # before a text there are borders, not the symbols of the text before
    for at in range(ORDER - 1):
        early = offsets[:-1][np.diff(offsets) > at] + at
        code[early] %= SYMBOLS ** (at + 1)
    return code, offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, half, code, n) of a task; a row for each n-gram it has."""
    totals: dict[tuple, np.ndarray] = {}
    waiting: dict[tuple, list[np.ndarray]] = {}

    def add(key: tuple) -> None:
        counted = np.bincount(np.concatenate(waiting.pop(key)), minlength=SYMBOLS**ORDER)
        totals[key] = totals[key] + counted if key in totals else counted

    def counted_rows() -> Iterator[pa.RecordBatch]:
        for key in list(waiting):
            add(key)
        for (lang, half), counted in totals.items():
            seen = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(seen), pa.string()),
                    pa.array([half] * len(seen), pa.int32()),
                    pa.array(seen, pa.int64()),
                    pa.array(counted[seen], pa.int64()),
                ],
                names=["lang", "half", "code", "n"],
            )
        totals.clear()

    for batch in T.slices(batches, "text"):
        code, offsets = symbol_codes(batch.column("text"))
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True))
        pieces: dict[tuple, list[np.ndarray]] = {}
        for key, start, end in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            pieces.setdefault(key, []).append(code[start:end])
        for key, own in pieces.items():
            parts = waiting.setdefault(key, [])
            parts.append(np.concatenate(own))  # a copy, which does not hold the batch
            if sum(map(len, parts)) > COUNT_AT_ONCE:
                add(key)
        # however many languages there are, a task holds a few tables
        if len({*totals, *waiting}) > 2 * LANGUAGES:
            yield from counted_rows()
    yield from counted_rows()


def _half(text: str = "text") -> Column:
    return word_grams.half_of(word_grams.text_id(text))


def _names(lang: str | None) -> tuple[str, str, str]:
    """Names of a language's model, and of those of its halves; without a language,
    of all together. The sign in front keeps any language apart from ``OTHER``."""
    base = OTHER if lang is None else "=" + lang
    return base + "|", base + "|0", base + "|1"


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, code, n) over the trusted documents (text, lang), for each language
    and for ``OTHER``, all together. ``lang`` is the name of a model: ``=en|`` counts
    all of the language, ``=en|0`` and ``=en|1`` one half."""
    counted = trusted.select("text", "lang", _half().alias("half")).mapInArrow(
        _count, "lang string, half int, code long, n long"
    )
    halves = counted.groupBy("lang", "half", "code").agg(F.sum("n").alias("n"))
    base = F.explode(F.array(word_grams.base_of(F.col("lang")), F.lit(OTHER))).alias("base")
    every = halves.select(base, "half", "code", "n").filter("base IS NOT NULL")
    whole, of_half = F.concat("base", F.lit("|")), word_grams.half_model(F.col("base"), F.col("half"))
    each = every.select(F.explode(F.array(whole, of_half)).alias("lang"), "code", "n")
    return each.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _levels(counts: DataFrame) -> DataFrame:
    """(k, lang, code, n) of every order k, from those of the highest."""
    rows = None
    for k in range(ORDER, 0, -1):
        own = counts.select(F.lit(k).alias("k"), "lang", "code", "n")
        rows = own if rows is None else rows.union(own)
        # how many different symbols come before an n-gram of the lower order
        counts = counts.groupBy("lang", F.pmod("code", F.lit(SYMBOLS ** (k - 1))).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return rows


def model_rows(counts: DataFrame) -> DataFrame:
    """(k, lang, code, share, rest) of the seen n-grams of every order k: the
    discounted relative frequency, and the weight that the n-gram's context leaves to
    the lower order. All orders go through the same few shuffles."""
    counts = stage_table(_levels(counts), keep_shuffles=False)
    of = lambda k: F.count(F.when(F.col("n") == k, 1)).cast("double")
    kinds = counts.groupBy("k", "lang").agg(*[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def discount(k: int):
        upper, lower = F.col(f"n{k + 1}"), F.col(f"n{k}")
        value = F.when((lower > 0) & (upper > 0), k - (k + 1) * y * upper / lower).otherwise(0.5 * k)
        return F.least(F.greatest(value, F.lit(0.05)), F.lit(k - 0.05))

    cuts = kinds.select("k", "lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    context = F.floor(F.col("code") / SYMBOLS).alias("context")
    # a row for each order of each model
    rows = counts.join(F.broadcast(cuts), ["k", "lang"]).select("k", "lang", "code", context, "n", cut.alias("cut"))
    same = Window.partitionBy("k", "lang", "context")  # SYMBOLS rows at most
    total = F.sum("n").over(same)
    share = (F.col("n") - F.col("cut")) / total
    return rows.select("k", "lang", "code", share.alias("share"), (F.sum("cut").over(same) / total).alias("rest"))


def dense_table(rows: pa.Table) -> np.ndarray:
    """Minus the log probability of every n-gram of one model. Unseen n-grams have
    the lower order's probability times the context's rest."""
    k, code = rows["k"].to_numpy(), rows["code"].to_numpy()
    share, rest = rows["share"].to_numpy(), rows["rest"].to_numpy()
    lower = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        own = k == order
        left = np.ones(SYMBOLS ** (order - 1))
        left[code[own] // SYMBOLS] = rest[own]
        if order == 1:
            table = left[0] * lower
        else:
            # n-gram w1..wk has the lower order n-gram w2..wk
            table = (left.reshape(SYMBOLS, -1)[:, :, None] * lower.reshape(1, -1, SYMBOLS)).reshape(-1)
        table[code[own]] += share[own]
        lower = table
    return -np.log(lower).astype(np.float32).astype(np.float16)


def dense_model(rows: pa.Table) -> dict[str, np.ndarray]:
    """The table of each model."""
    names = sorted({*rows["lang"].to_pylist()})
    return {name: dense_table(rows.filter(pc.equal(rows["lang"], name))) for name in names}


def _dense_models(counts: DataFrame, names: list[str]) -> dict[str, Broadcast]:
    """The table of each model of ``names``. The driver holds one of them at a time."""
    kept, context = staged(), counts.sparkSession.sparkContext
    rows = stage_table(model_rows(counts.filter(F.col("lang").isin(names))), keep_shuffles=False)
    models = {name: context.broadcast(dense_table(rows.filter(F.col("lang") == name).drop("lang").toArrow())) for name in names}
    release(keep=kept)
    return models


def _score(batches: Iterator[pa.RecordBatch], models: dict[str, Broadcast]) -> Iterator[pa.RecordBatch]:
    """Mean loss of each document under its language's model, and under that of
    the half of the trusted documents that it is not in."""
    tables = {name: model.value for name, model in models.items()}
    pooled = _names(None)
    for batch in T.slices(batches, "text"):
        code, offsets = symbol_codes(batch.column("text"))
        n = np.diff(offsets)
        docs = np.flatnonzero(n)
        mine = [_names(x) for x in batch.column("lang").to_pylist()]
        mine = [x if x[0] in tables else pooled for x in mine]
        langs = [x[0] for x in mine]
        others = [x[2 - h] for x, h in zip(mine, batch.column("half").to_pylist(), strict=True)]
        means = []
        for names in (langs, others):
            total = np.zeros(len(n))
            if len(docs):
                own = [tables.get(x, tables[pooled[0]]) for x in names]
                loss = [table[code[start:end]] for table, start, end in zip(own, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                total[docs] = np.add.reduceat(np.concatenate(loss).astype(np.float64), offsets[docs])
            means.append(pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0)))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("doc_id", "text_id", "lang")],
                pa.array(langs, pa.string()),
                batch.column("half"),
                pa.array(n.astype(np.int64)),
                *means,
            ],
            names=["doc_id", "text_id", "lang", "model", "half", "n_symbols", "nats", "held_out"],
        )


def _scored(rows: DataFrame, counts: DataFrame, known: set[str]) -> DataFrame:
    """The losses of all rows, ``LANGUAGES`` - 1 languages at once, which bounds
    what the driver and a broadcast hold. Rows of languages without a model go
    with the first of these blocks."""
    langs = sorted(x[1:-1] for x in known if x[0] == "=" and x[-1] == "|")
    step = LANGUAGES - 1
    found = None
    for at in range(0, max(1, len(langs)), step):
        block = langs[at : at + step]
        names = [name for x in (*block, None) for name in _names(x) if name in known]
        models = _dense_models(counts, names)
        others = langs[step:]
        own = F.col("lang").isin(block) if at else (F.col("lang").isNull() | ~F.col("lang").isin(others)) if others else F.lit(True)
        part = stage_table(
            rows.filter(own).mapInArrow(
                partial(_score, models=models),
                "doc_id long, text_id long, lang string, model string, half int, n_symbols long, nats double, held_out double",
            )
        )
        for model in models.values():
            model.destroy()  # the scores are written
        found = part if found is None else found.union(part)
    return found


def _word_judgement(base: DataFrame, trusted: DataFrame, scored: DataFrame, reference: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(text_id, lang, word_base, n_words, word_nats) of the different texts, and
    (word_base, word_lo, word_hi), the quantiles of the trusted documents. ``scored`` has
    the rows of ``base`` without their texts, ``reference`` those of ``trusted``."""
    columns = ("text_id", "lang", "half")
    whole = word_grams.two_halves(trusted)
    rows = word_grams.with_model(scored.select(*columns), whole)
    reference = word_grams.with_model(reference.select(*columns), whole)
    texts = word_grams.with_model(base.select(*columns, "text"), whole).select("text_id", "text", "base", "half")
    given = word_grams.with_model(trusted.select(*columns, "text"), whole).select("text_id", "text", "base", "half")
    # a language without its own models is not learned by itself
    learned = given.filter(F.col("base") != word_grams.OTHER)
    # limits of all languages together are those of all trusted texts there
    other = F.lit(word_grams.OTHER)
    some = not texts.filter(F.col("base") == other).isEmpty()
    if some:
        pooled = reference.withColumn("base", other).withColumn("model", word_grams.half_model(other, 1 - F.col("half")))
        reference = reference.filter(F.col("base") != other).union(pooled)
        every = given.withColumn("base", other)
        texts, learned = texts.union(every), learned.union(every)
    scores = stage_table(word_grams.word_scores(texts, learned), keep_shuffles=False)
    judged = rows.select("text_id", "lang", "model", F.col("base").alias("word_base")).distinct().join(scores, ["text_id", "model"])
    # the mean of a short document varies more; its allowance is taken off
    # before the quantiles, and given back to the judged document
    own = F.lit(WORD_SLACK_ROOT) / F.sqrt(F.col("n_words") + 1)
    limits = (
        reference.select("text_id", "model", F.col("base").alias("word_base"))
        .join(scores, ["text_id", "model"])
        .groupBy("word_base")
        .agg(
            F.percentile_approx(F.col("word_nats") + own, low, 100_000).alias("word_lo"),
            F.percentile_approx(F.col("word_nats") - own, high, 100_000).alias("word_hi"),
        )
    )
    return judged.drop("model"), limits


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    low: float = LOW,
    high: float = HIGH,
) -> DataFrame:
    """One row per input row: doc_id, lang, n_symbols, perplexity, lowest,
    highest, kept, n_words, word_perplexity, word_lowest, word_highest.

    ``labels`` has doc_id and quality; documents with quality 1 are trusted. The
    limits of a language are the quantiles ``low`` and ``high`` of the trusted
    documents' mean loss, with a margin that shrinks with the length of the
    judged document; ``kept`` needs both the characters and the words inside
    their limits. Languages without trusted text, and a null one, use the
    model and limits of all languages together. A null or empty text has nothing
    to predict, perplexity 1, and is kept. Without any trusted document nothing
    is rejected: perplexity and limits are null. Equal texts of one language are
    judged alike, however many there are. A document whose id is repeated in the
    table is judged row by row; labels are used once for each id. A task holds one
    text at a time, however long it is. An empty table gives no rows.
    """
    base = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")
    )
    # made before any join, so that texts are shuffled only where they are read
    base = base.withColumn("text_id", word_grams.text_id()).withColumn("half", _half())
    trusted_ids = labels.filter(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("doc_id")).distinct()
    # the ids grow with the corpus: a shuffle at every size, never a broadcast
    trusted = base.join(trusted_ids.hint("shuffle_hash"), "doc_id", "left_semi").filter("length(text) > 0")
    counts = stage_table(ngram_counts(trusted), keep_shuffles=False)
    known = {r["lang"] for r in counts.select("lang").distinct().collect()}  # a name for each model
    if not known:
        nothing = F.lit(None).cast("double")
        n = F.lit(None).cast("long")
        return base.select("doc_id", "lang", n.alias("n_symbols"), nothing.alias("perplexity"), nothing.alias("lowest"), nothing.alias("highest"), F.lit(True).alias("kept"), n.alias("n_words"), nothing.alias("word_perplexity"), nothing.alias("word_lowest"), nothing.alias("word_highest"))
    scored = _scored(base, counts, known)
    reference = scored.join(trusted_ids, "doc_id", "left_semi").filter("n_symbols > 0")
    own = F.lit(SLACK_ROOT) / F.sqrt(F.col("n_symbols") + 1)
    every = reference.select(
        F.explode(F.array_distinct(F.array("model", F.lit(_names(None)[0])))).alias("model"),
        (F.col("nats") + own).alias("above"),
        (F.col("held_out") - own).alias("below"),
    )
    limits = every.groupBy("model").agg(
        F.percentile_approx("above", low, 100_000).alias("lo"), F.percentile_approx("below", high, 100_000).alias("hi")
    )
    by_words, word_limits = _word_judgement(base, trusted, scored, reference, low, high)
    by_words = by_words.withColumn("lang", F.coalesce("lang", F.lit("")))
    slack = own + F.lit(SLACK)
    word_slack = F.lit(WORD_SLACK_ROOT) / F.sqrt(F.col("n_words") + 1) + F.lit(WORD_SLACK)
    scored = scored.withColumn("key", F.coalesce("lang", F.lit(""))).join(by_words.withColumnRenamed("lang", "key"), ["text_id", "key"], "left")
    scored = scored.join(F.broadcast(word_limits), "word_base", "left")  # one row for each language
    # one row for each language
    judged = scored.join(F.broadcast(limits), "model", "left")
    fits = (F.col("n_symbols") == 0) | F.col("nats").between(F.col("lo") - slack, F.col("hi") + slack)
    word_fits = F.col("word_nats").between(F.col("word_lo") - word_slack, F.col("word_hi") + word_slack)
    return judged.select(
        "doc_id",
        "lang",
        "n_symbols",
        F.exp("nats").alias("perplexity"),
        F.exp(F.col("lo") - slack).alias("lowest"),
        F.exp(F.col("hi") + slack).alias("highest"),
        (F.coalesce(fits, F.lit(True)) & F.coalesce(word_fits, F.lit(True))).alias("kept"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.exp("word_nats").alias("word_perplexity"),
        F.exp(F.col("word_lo") - word_slack).alias("word_lowest"),
        F.exp(F.col("word_hi") + word_slack).alias("word_highest"),
    )
