import hashlib
import random

import pytest

from clearlane.llm import substring
from tests.llm.cases import ODD, documents, prose, words


def brute(rows, window):
    """(doc_id, n_words, n_removed, sha) of every row; ids may repeat."""
    earliest = {}
    split = [(i, words(t)) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for a in range(len(ws) - window + 1):
                k = tuple(ws[a : a + window])
                earliest[k] = min(earliest.get(k, i), i)
    gone = {}
    for i, ws in split:
        for a in range(len(ws) - window + 1):
            if i is not None and earliest[tuple(ws[a : a + window])] < i:
                gone.setdefault(i, set()).update(range(a, a + window))
    out = []
    for i, ws in split:
        kept = [w for p, w in enumerate(ws) if p not in gone.get(i, ())]
        out.append((i, len(ws), len(ws) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


def passages(seed):
    """Documents that share, cut and repeat passages around the window length."""
    rng = random.Random(seed)
    pool = [prose((seed, i), rng.choice([40, 49, 50, 51, 60, 90, 150])) for i in range(6)]
    texts = []
    for d in range(40):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool) if rng.random() < 0.7 else prose((seed, d, rng.random()), rng.randrange(5, 80))
            a = rng.randrange(0, 20) if rng.random() < 0.5 else 0
            ws += p[a : len(p) - (rng.randrange(0, 20) if rng.random() < 0.5 else 0)]
        texts.append(rng.choice([" ", "  ", "\n"]).join(ws))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    texts = passages(seed) + ["the " * 300, "the " * 120 + "end", "a b " * 90, "b a " * 70]
    random.Random(seed).shuffle(texts)
    df = documents(spark, texts)
    assert result(substring.remove_repeats(df)) == brute(list(enumerate(texts)), 50)


def test_short_windows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    df = documents(spark, texts)
    spans = substring.duplicate_spans(df, window=8, anchor=3)
    gone = {}
    for r in spans.collect():
        for s in r.spans:
            gone.setdefault(r.doc_id, set()).update(range(s.first, s.first + s.n))
    expected = {i: n for i, _, n, _ in brute(list(enumerate(texts)), 8) if n}
    assert {i: len(s) for i, s in gone.items() if s} == expected


def test_nulls_repeated_rows_and_ids(spark):
    long = " ".join(prose(9, 70))
    texts = [*ODD, long, long, long + " more", None, long, long]
    ids = [*range(len(ODD)), 20, 20, 20, None, None, 30]
    got = result(substring.remove_repeats(documents(spark, texts, ids)))
    assert got == brute(list(zip(ids, texts, strict=True)), 50)
    assert [r.n_removed for r in substring.remove_repeats(documents(spark, texts, ids)).filter("doc_id = 30").collect()] == [70]


def test_empty_table_and_one_very_long_text(spark):
    df = documents(spark, ["x"])
    assert substring.remove_repeats(df.limit(0)).collect() == []
    ws = prose(3, 120_000)
    texts = [" ".join(ws[50_000:50_060]), " ".join(ws)]
    assert [x[2] for x in result(substring.remove_repeats(documents(spark, texts)))] == [0, 60]
