import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearlane.llm import kneser_ney as kn
from tests.llm.cases import ODD, documents

SMALL = "/root/testdata/sf0.01"


def symbols(text):
    return [int(c) for c in kn.CLASS[list(text.encode())] if c != kn.DROPPED]


def plain_model(texts):
    """Interpolated modified Kneser-Ney by recursion over dictionaries."""
    counts = {kn.ORDER: Counter()}
    for t in texts:
        s = [kn.BORDER] * (kn.ORDER - 1) + symbols(t)
        counts[kn.ORDER].update(tuple(s[i : i + kn.ORDER]) for i in range(len(s) - kn.ORDER + 1))
    for k in range(kn.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals, left = {}, {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cut = [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] and n[j + 1] else 0.5 * j, 0.05), j - 0.05) for j in (1, 2, 3)]
        cuts[k] = cut
        totals[k], left[k] = defaultdict(int), defaultdict(float)
        for g, x in c.items():
            totals[k][g[:-1]] += x
            left[k][g[:-1]] += cut[min(x, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / kn.SYMBOLS
        below = p(g[1:]) if k > 1 else 1 / kn.SYMBOLS
        total = totals[k].get(g[:-1], 0)
        if not total:
            return below
        x = counts[k].get(g, 0)
        share = (x - cuts[k][min(x, 3) - 1]) / total if x else 0.0
        return share + left[k][g[:-1]] / total * below

    return p


TEXTS = ["the cat sat on the mat, and the dog.", "The dog sat 12 times on a log!", "café and the über cat", "a b c a b c a b c", "dogs and cats"]


def test_same_model_as_plain_recursion(spark):
    trusted = documents(spark, TEXTS).select("doc_id", "text", "lang")
    model = kn.dense_model(kn.model_rows(kn.ngram_counts(trusted)).toArrow())
    assert set(model) == {f"{x}|{h}" for x in ("=en", kn.OTHER) for h in ("", "0", "1")}
    assert np.allclose(model["=en|"], model["*|"])
    p = plain_model(TEXTS)
    rng = random.Random(1)
    codes = [rng.randrange(kn.SYMBOLS**kn.ORDER) for _ in range(300)]
    codes += kn.symbol_codes(pa.array(TEXTS))[0].tolist()
    for code in codes:
        g = tuple(code // kn.SYMBOLS**i % kn.SYMBOLS for i in range(kn.ORDER - 1, -1, -1))
        assert math.isclose(model["=en|"][code], -math.log(p(g)), rel_tol=1e-3)
    sums = np.exp(-model["=en|"].astype(float)).reshape(-1, kn.SYMBOLS).sum(axis=1)
    assert np.allclose(sums, 1, atol=5e-3)


def test_perplexity_of_documents(spark):
    texts = [*TEXTS, *ODD, "XX!!", None]
    langs = ["en"] * len(TEXTS) + ["en", None, "xx", "en", "xx", None, "en", "en", None]
    labels = spark.createDataFrame([(i, 1, "l") for i in range(len(TEXTS))] + [(0, 1, "l"), (None, 1, "l"), (99, 0, "l")], "doc_id long, quality int, lang string")
    p = plain_model(TEXTS)
    rows = kn.judge_quality(documents(spark, texts, langs=langs), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = symbols(texts[r.doc_id] or "")
        padded = [kn.BORDER] * (kn.ORDER - 1) + s
        loss = [-math.log(p(tuple(padded[i : i + kn.ORDER]))) for i in range(len(s))]
        assert r.n_symbols == len(s)
        assert math.isclose(r.perplexity, math.exp(sum(loss) / len(s)) if s else 1.0, rel_tol=1e-2)
        fits = r.word_perplexity is None or r.word_lowest is None or r.word_lowest <= r.word_perplexity <= r.word_highest
        assert r.kept == ((not s or r.lowest <= r.perplexity <= r.highest) and fits)


def test_no_labels_repeats_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, ["a", None, "a", "a"], [1, None, 1, 2])
    assert all(r.kept and r.perplexity is None for r in kn.judge_quality(docs, labels).collect())
    some = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    assert len(kn.judge_quality(docs, some).collect()) == 4
    assert kn.judge_quality(docs.limit(0), some).collect() == []


def test_every_language_has_its_own_model(spark):
    """The smallest language does not depend on how many others there are."""
    texts, langs = [], []
    for number in range(kn.LANGUAGES + 1):
        texts += [f"{t} {'abcdefghijklmnopqrstuvwxyz'[number] * 5}" for t in TEXTS]
        langs += [f"l{number:02d}"] * len(TEXTS)
    texts += TEXTS[:4]
    langs += ["small"] * 4
    ids = range(len(texts))
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    docs = documents(spark, texts, langs=langs)
    columns = ("doc_id", "perplexity", "lowest", "highest", "word_perplexity")
    every = {r.doc_id: r for r in kn.judge_quality(docs, labels).select(*columns).collect()}
    alone = kn.judge_quality(docs.filter("lang = 'small'"), labels).select(*columns).collect()
    assert len(every) == len(texts) and len(alone) == 4
    for r in alone:
        assert np.allclose(r[:4], every[r.doc_id][:4], rtol=1e-3)


def test_names_of_languages_do_not_mix(spark):
    """A language may be called like a model of another one."""
    names = ["*", "en 0", "en|0", "=en", "*|", "en"]
    texts, langs = [], []
    for number, name in enumerate(names):
        texts += [f"{t} {chr(97 + number) * 4}" for t in TEXTS]
        langs += [name] * len(TEXTS)
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    columns = ("doc_id", "perplexity", "lowest", "highest", "n_words")
    docs = documents(spark, texts, langs=langs)
    every = {r.doc_id: r for r in kn.judge_quality(docs, labels).select(*columns).collect()}
    for name in names[:3]:
        plain = docs.filter(docs["lang"] == name).withColumn("lang", F.lit("plain"))
        for r in kn.judge_quality(plain, labels).select(*columns).collect():
            assert np.allclose(r, every[r.doc_id], rtol=1e-3)


@pytest.fixture(scope="module")
def held_out(spark):
    """Half of the labels train, the others judge."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = kn.judge_quality(docs, labels.filter("doc_id % 2 = 0"))
    return judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()


def test_held_out_documents(held_out):
    good = [r.kept for r in held_out if r.quality == 1]
    bad = [r.kept for r in held_out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_the_driver_gets_one_model_at_a_time(spark, monkeypatch):
    """The rows of all models together were collected at once before."""
    docs = documents(spark, TEXTS * 4, langs=["en", "fr"] * 10)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    collected, plain = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda frame: collected.append(plain(frame)) or collected[-1])
    rows = kn.judge_quality(docs, labels).collect()
    monkeypatch.undo()
    most = sum(min(kn.SYMBOLS**k, sum(map(len, TEXTS))) for k in range(1, kn.ORDER + 1))
    assert len(rows) == 20 and len(collected) > 3
    assert all("lang" not in t.column_names and t.num_rows <= most for t in collected)


def test_orders_of_the_characters_share_their_shuffles(spark):
    """Every order had joins of its own before."""
    counts = kn.ngram_counts(documents(spark, TEXTS).select("doc_id", "text", "lang"))
    plan = kn.model_rows(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4


def test_limits_are_found_without_the_texts(spark, tmp_path):
    """Texts were read and shuffled again for the limits and for the names of models."""
    path = str(tmp_path / "documents")
    documents(spark, TEXTS * 4).write.parquet(path)
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    judged = kn.judge_quality(spark.read.parquet(path), labels)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and path not in plan and "text#" not in plan.replace("text_id#", "")


def test_symbols_of_each_text_begin_at_a_border():
    rng = random.Random(5)
    texts = ["".join(rng.choices("aZ9 .é漢\n", k=rng.randrange(0, 7))) for _ in range(200)] + [None]
    code, offsets = kn.symbol_codes(pa.array(texts))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        s = [kn.BORDER] * (kn.ORDER - 1) + symbols(text or "")
        want = [sum(x * kn.SYMBOLS**i for i, x in enumerate(reversed(s[j : j + kn.ORDER]))) for j in range(len(s) - kn.ORDER + 1)]
        assert code[a:b].tolist() == want
