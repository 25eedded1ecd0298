import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from clearlane.llm import language
from clearlane.llm.queries import QUERIES
from tests.llm.cases import ODD, documents

def learn():
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def split(text):
    out = []
    for run in regex.findall(r"[\pL\pM]+", (text or "").lower()):
        out += [run[i : i + language.WORD] for i in range(0, len(run), language.WORD)]
    return out


def brute(rows):
    """rows: (id, text, lang). (id, held out, language, score) of each."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and not held_out(i) and lang is not None:
            words[lang].update(split(text))
    words = {g: c for g, c in words.items() if c}
    if not words:
        return [(i, held_out(i), "und", 0.0) for i, _, _ in rows]
    totals = {g: sum(c.values()) for g, c in words.items()}
    order = sorted(words, key=lambda g: (-totals[g], g))
    penalty = math.log(max(totals.values())) + 1
    for g, c in words.items():
        for w, n in c.items():
            padded = f" {w} "
            for size in range(1, language.LONGEST + 1):
                for at in range(len(padded) - size + 1):
                    grams[g, size][padded[at : at + size]] += n

    def gain(n, total):
        return max(1, math.floor((penalty + math.log(n / total)) * language.UNIT + 0.5))

    def of(word):
        known = {g: gain(c[word], totals[g]) for g, c in words.items() if word in c}
        if known:
            return known
        padded = f" {word} "
        for size in range(language.LONGEST, 0, -1):
            parts = [padded[at : at + size] for at in range(len(padded) - size + 1)]
            found = {g: sum(gain(grams[g, size][p], sum(grams[g, size].values())) for p in parts if p in grams[g, size]) for g in words}
            found = {g: max(1, x // len(parts)) for g, x in found.items() if any(p in grams[g, size] for p in parts)}
            if found:
                return found
        return {}

    out = []
    for i, text, _ in rows:
        ws = split(text)
        if not regex.search(r"\pL", text or ""):
            out.append((i, held_out(i), "und", 0.0))
            continue
        sums = Counter({g: 0 for g in words})
        for w in ws:
            sums.update(of(w))
        best = min(order, key=lambda g: (-sums[g], order.index(g)))
        share = 1 / sum(math.exp((sums[g] - sums[best]) / language.UNIT / len(ws)) for g in words)
        out.append((i, held_out(i), best, share))
    return out


def result(df):
    return sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in df.collect()), key=str)


def same(got, expected):
    expected = sorted(expected, key=str)
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in expected], abs=1e-6)


def corpus(seed, n=80):
    rng = random.Random(seed)
    stems = {"en": ["the", "of", "ing", "tion", "ly"], "de": ["der", "ung", "keit", "\u00fcber"], "fr": ["le", "ment", "\u00e9t\u00e9", "eau"], "xx": ["qq", "zz"]}
    texts, langs = [], []
    for _ in range(n):
        lang = rng.choice(list(stems))
        ws = ["".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 12))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(w.title() if rng.random() < 0.2 else w for w in ws))
        langs.append(rng.choice([lang, lang, lang, None]))
    return texts, langs


@pytest.mark.parametrize("seed,head", [(1, 1 << 17), (2, 5), (3, 0)])
def test_same_as_plain_version(spark, monkeypatch, seed, head):
    """Whether words are looked up in the tasks or by the join changes nothing."""
    monkeypatch.setattr(language, "HEAD_WORDS", head)
    texts, langs = corpus(seed)
    texts += [*ODD, "123 --- \u2014 4", "zzqqab unseen", "x" * 200, "\u4e2d\u6587 \u0416"]
    langs += ["en"] * (len(texts) - len(langs))
    ids = [*range(len(texts) - 2), None, None]
    got = result(language.predict(documents(spark, texts, ids, langs), learn()))
    same(got, brute(list(zip(ids, texts, langs, strict=True))))


def test_repeats_no_language_and_empty_table(spark):
    df = documents(spark, ["ab cd", "ab cd", None, "ef"], [1, 1, 2, 5], [None, None, "en", None])
    same(result(language.predict(df, learn())), [(1, False, "und", 0.0)] * 2 + [(2, held_out(2), "und", 0.0), (5, held_out(5), "und", 0.0)])
    assert result(language.predict(df.limit(0), learn())) == []
    rows = [(i, t, g) for i, t, g in [(1, "ab cd", "en"), (1, "ab cd", "en"), (3, "ab ab ef", "de"), (8, "ab cd", None), (8, "zz", "en")]]
    df = documents(spark, [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows])
    same(result(language.predict(df, learn())), brute(rows))


def test_language_is_no_input_of_a_prediction(spark):
    texts, langs = corpus(4)
    changed = ["nonsense" if held_out(i) else g for i, g in enumerate(langs)]
    a = result(language.predict(documents(spark, texts, langs=langs), learn()))
    b = result(language.predict(documents(spark, texts, langs=changed), learn()))
    assert a == b


def test_very_long_text(spark):
    texts = ["der die das " * 5, "the of and " * 5, "the of and " * 300_000, "a" * 1_000_000]
    got = result(language.predict(documents(spark, texts, [1, 3, 5, 8], ["de", "en", None, None]), learn()))
    assert [x[2] for x in got][2] == "en"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r.lang_pred for r in QUERIES["op12_language_id"](spark, folder).filter("held_out").collect()}
    rows = duckdb.sql(f"SELECT doc_id, lang, text FROM '{folder}/documents.parquet' WHERE lang IS NOT NULL").fetchall()
    right = [got[i] == lang for i, lang, text in rows if i in got and len(split(text)) >= 5]
    assert len(right) > 100 and sum(right) / len(right) >= 0.98
