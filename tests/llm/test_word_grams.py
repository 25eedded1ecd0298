import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from clearlane.llm import kneser_ney as kn
from clearlane.llm import word_grams as wg
from tests.llm.cases import documents, words


def plain_model(texts):
    """Interpolated modified Kneser-Ney over words by recursion."""
    counts = {wg.ORDER: Counter()}
    for t in texts:
        s = [""] * (wg.ORDER - 1) + words(t)
        counts[wg.ORDER].update(tuple(s[i : i + wg.ORDER]) for i in range(len(s) - wg.ORDER + 1))
    for k in range(wg.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals, left = {}, {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        cuts[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] and n[j + 1] else 0.5 * j, 0.05), j - 0.05) for j in (1, 2, 3)]
        totals[k], left[k] = defaultdict(int), defaultdict(float)
        for g, x in c.items():
            totals[k][g[:-1]] += x
            left[k][g[:-1]] += cuts[k][min(x, 3) - 1]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        total = totals[k].get(g[:-1], 0)
        if not total:
            return below
        x = counts[k].get(g, 0)
        return (x - cuts[k][min(x, 3) - 1] if x else 0.0) / total + left[k][g[:-1]] / total * below

    return p


def corpus():
    rng = random.Random(3)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(250)]
    phrases = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(300)]
    return rng, [" ".join(rng.choices(phrases, k=60)) for _ in range(80)]


def test_scores_of_the_other_half(spark):
    _, texts = corpus()
    texts = [*texts[:30], "two new words", "a", "a a a a"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    halves = {r.doc_id: r.h for r in docs.select("doc_id", kn._half().alias("h")).collect()}
    models = [plain_model([t for i, t in enumerate(texts[:30]) if halves[i] == h]) for h in (0, 1)]
    for r in kn.judge_quality(docs, labels).collect():
        p, s = models[1 - halves[r.doc_id]], [""] * (wg.ORDER - 1) + words(texts[r.doc_id])
        loss = [-math.log(p(tuple(s[i : i + wg.ORDER]))) for i in range(len(s) - wg.ORDER + 1)]
        assert r.n_words == len(loss)
        assert math.isclose(r.word_perplexity, math.exp(sum(loss) / len(loss)), rel_tol=1e-6)


def test_junk_that_shows_between_words_only(spark):
    rng, texts = corpus()
    shuffled = []
    for t in texts[:10]:
        ws = t.split()
        rng.shuffle(ws)
        shuffled.append(" ".join(ws))
    good, bad = range(60, 80), range(80, 90)
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in kn.judge_quality(documents(spark, [*texts, *shuffled]), labels).collect()}
    assert sum(rows[i].kept for i in good) >= 19
    assert sum(rows[i].lowest <= rows[i].perplexity <= rows[i].highest for i in bad) >= 5
    assert not any(rows[i].kept for i in bad)


def test_copies_of_a_text_change_nothing(spark):
    """Equal texts have one score, and are counted once, under whatever ids."""
    _, texts = corpus()
    short = ["one two three four five", "six seven eight nine ten"]
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    columns = ("n_words", "perplexity", "word_perplexity", "word_lowest", "word_highest", "kept")
    once = documents(spark, [*texts[:40], *short])
    many = documents(spark, [*texts[:40], *short, *[short[0]] * 400, *texts[35:40] * 3])
    a = {r.doc_id: r for r in kn.judge_quality(once, labels).select("doc_id", *columns).collect()}
    b = {r.doc_id: r for r in kn.judge_quality(many, labels).select("doc_id", *columns).collect()}
    assert len(a) == 42 and len(b) == 457
    same = {i: i for i in range(42)} | {42 + i: 40 for i in range(400)} | {442 + i: 35 + i % 5 for i in range(15)}
    for i, j in same.items():
        assert b[i].n_words == a[j].n_words and b[i].kept == a[j].kept
        assert all(math.isclose(b[i][c], a[j][c], rel_tol=1e-9) for c in columns[1:5])
    assert a[40].n_words == 5


def test_a_language_with_one_half_is_judged_with_all_languages(spark):
    _, texts = corpus()
    halves = [r.h for r in documents(spark, texts[:60]).select("doc_id", kn._half().alias("h")).orderBy("doc_id").collect()]
    langs = ["xx" if h == 0 and i < 20 else "en" for i, h in enumerate(halves)]
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in kn.judge_quality(documents(spark, texts[:60], langs=langs), labels).collect()}
    pooled = {r.doc_id: r for r in kn.judge_quality(documents(spark, texts[:60], langs=["en"] * 60), labels).collect()}
    for i, lang in enumerate(langs):
        if lang == "xx":
            assert math.isclose(rows[i].word_perplexity, pooled[i].word_perplexity, rel_tol=1e-9)
            assert math.isclose(rows[i].word_highest, pooled[i].word_highest, rel_tol=1e-9)


def test_many_parts_are_one_model(spark, monkeypatch):
    """The n-grams may be dealt to any number of parts."""
    _, texts = corpus()
    docs = documents(spark, [*texts[:40], "two new words", None, "a a a a", texts[3]], langs=["en", "fr"] * 22)
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    columns = ("n_words", "word_perplexity", "word_lowest", "word_highest")
    one = {r.doc_id: r for r in kn.judge_quality(docs, labels).select("doc_id", *columns).collect()}
    monkeypatch.setattr(wg, "PART_BYTES", 1000)
    many = {r.doc_id: r for r in kn.judge_quality(docs, labels).select("doc_id", *columns).collect()}
    assert sum(len(t.encode()) for t in texts[:40]) > 20_000 and len(one) == len(many) == 44
    for i, r in one.items():
        assert many[i].n_words == r.n_words
        assert all((many[i][c] is None) == (r[c] is None) for c in columns)
        assert all(math.isclose(many[i][c], r[c], rel_tol=1e-9) for c in columns if r[c] is not None)


def test_n_grams_travel_in_few_bytes():
    """Not as a row with three hashes of 8 bytes, the text, the model and the count."""
    rng = np.random.default_rng(1)
    words = np.arange(30_001, dtype=np.uint32) * 7
    seq = rng.integers(1, 30_001, 100_000).astype(np.uint32)
    row = {"slice": 1, "base": "=en", "trained": False, "texts": b"", "lengths": wg._pack(np.full(1000, 100)), "words": wg._pack_sorted(words), "seq": wg._pack(seq)}
    for pairs, most in ((False, 8), (True, 6)):
        blocks = [x for b in wg._deal_grams(iter([pa.RecordBatch.from_pylist([row])]), 4, pairs) for x in b.to_pylist()]
        assert {x["part"] for x in blocks} == set(range(4))
        assert sum(len(y) for x in blocks for y in x["data"]) < most * len(seq)
    keys = [wg._unpack_sorted(x["data"][0], np.uint64) for x in blocks]
    _, _, w1, w2 = wg._grams(row)
    assert sorted(np.concatenate(keys).tolist()) == np.unique(wg._pair(words[w1], words[w2])).tolist()


def test_slices_with_very_many_words():
    """The order does not depend on whether an n-gram fits 64 bits."""
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 40, 5000) for _ in range(3))
    few, many = np.arange(41, dtype=np.uint32), np.arange(2_200_000, dtype=np.uint32)
    for x, y in zip(wg._different(few, a, b, c, 5), wg._different(many, a, b, c, 5), strict=True):
        assert np.array_equal(x, y)


def test_numbers_are_packed_as_they_are():
    for values in ([], [0], [255, 256, 1 << 40], [-1, 5, -(1 << 62)], [1 << 16]):
        x = np.array(values, np.int64)
        assert wg._unpack(wg._pack(x), np.int64).tolist() == values
    x = np.array([3, 3, (1 << 64) - 1], np.uint64)
    assert np.array_equal(wg._unpack_sorted(wg._pack_sorted(x), np.uint64), x)


def test_a_slice_without_known_words_asks_for_nothing():
    row = {"slice": 1, "base": "=en", "trained": False, "texts": b"", "lengths": wg._pack(np.array([3])), "words": wg._pack_sorted(np.zeros(1, np.uint32)), "seq": wg._pack(np.ones(3, np.int64))}
    blocks = {pairs: list(wg._deal_grams(iter([pa.RecordBatch.from_pylist([row])]), 4, pairs)) for pairs in (False, True)}
    assert blocks[True] == []  # the first word still has the context of two borders
    assert [x["data"] for b in blocks[False] for x in b.to_pylist()] == [[wg._pack_sorted(np.zeros(1, np.uint64)), wg._pack(np.array([wg.UNKNOWN]))]]


def test_n_grams_are_counted_as_they_are_told_apart():
    rng = np.random.default_rng(4)
    words, (a, b, c) = np.arange(41, dtype=np.uint32), (rng.integers(0, 40, 5000) for _ in range(3))
    for other in (c, None):
        *columns, which = wg._different(words, a, b, other, 5)
        *counted, n = wg._counted(words, a, b, other, 5)
        assert np.array_equal(n, np.bincount(which))
        assert all(x is y is None or np.array_equal(x, y) for x, y in zip(columns, counted, strict=True))


def test_many_answers_go_in_one_batch():
    """A batch for each answer cost more than small answers themselves."""
    keys = [wg._pack_sorted(np.arange(i, i + 50, dtype=np.uint64)) for i in range(40)]
    blocks = [{"base": "=en", "part": 0, "judged": i > 0, "slice": i, "data": [x, b"" if i else wg._pack(np.arange(50)), b""]} for i, x in enumerate(keys)]
    batches = list(wg._answer_pairs(iter([pa.RecordBatch.from_pylist(blocks)]), 3))
    answers = [x for b in batches for x in b.to_pylist() if x["kind"] == wg.PAIRS]
    assert len(answers) == 39 and len(batches) == 1
    assert [int(wg._unpack(x["data"][0], np.int64).sum()) for x in answers] == [max(0, 50 - i) for i in range(1, 40)]
