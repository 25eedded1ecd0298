import random

import numpy as np

from clearlane.llm import decontaminate
from tests.llm.cases import ODD, documents, lowered, prose


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(texts, items):
    """Every item against every whole document."""
    found = set()
    for d, t in enumerate(texts):
        ws = lowered(t)
        for i, item in enumerate(items):
            own = lowered(item)
            if not own:
                continue
            share = plain_lcs(own, ws) / len(own)
            answer = own[-decontaminate.ANSWER_WORDS :]
            if share >= 0.7 or share >= 0.5 and plain_lcs(answer, ws) == len(answer):
                found.add((d, i))
    return found


def corpus(seed):
    rng = random.Random(seed)
    items = [" ".join(prose((seed, i), rng.randrange(12, 56), 900)) for i in range(25)]
    texts = []
    for d in range(120):
        ws = prose((seed, "d", d), rng.randrange(20, 200), 900)
        if d % 3 == 0:
            item = rng.choice(items).split()
            if d % 2:  # a paraphrase: words dropped, changed and put in
                item = [w if rng.random() > 0.15 else f"w{rng.randrange(900)}" for w in item if rng.random() > 0.1]
            at = rng.randrange(len(ws))
            ws[at:at] = [w.upper() for w in item] if d % 4 == 0 else item
        texts.append(" ".join(ws))
    return items, texts


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "q") for i, t in enumerate(items)], "item_id long, text string, word string")


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_finds_what_brute_force_finds(spark):
    items, texts = corpus(1)
    expected = brute(texts, items)
    got = pairs(decontaminate.leaks(documents(spark, texts), items_frame(spark, items)))
    assert len(expected) >= 35 and got <= expected
    assert len(got) >= 0.97 * len(expected)


def test_blocks_of_items_give_the_same(spark):
    items, texts = corpus(2)
    docs, bench = documents(spark, texts), items_frame(spark, items)
    one = pairs(decontaminate.leaks(docs, bench))
    many = pairs(decontaminate.leaks(docs, bench, block=10))
    assert len(one ^ many) <= 0.05 * len(one)


def test_full_block_of_items(spark):
    """More items than directions, one reworded copy of each."""
    rng = random.Random(4)
    items = [prose((4, i), rng.randrange(15, 60), 6000) for i in range(2 * decontaminate.RANK)]
    texts, expected = [], set()
    for i, item in enumerate(items):
        body, answer = item[: -decontaminate.ANSWER_WORDS], item[-decontaminate.ANSWER_WORDS :]
        copy = [w if rng.random() > 0.2 else f"w{rng.randrange(6000)}" for w in body if rng.random() > 0.2] + answer
        if plain_lcs(item, copy) >= 0.5 * len(item):
            expected.add((i, i))
        ws = prose((4, "d", i), 60, 6000)
        texts.append(" ".join(ws[:30] + copy + ws[30:]))
    texts += [" ".join(prose((4, "b", i), 150, 6000)) for i in range(1000)]
    got = pairs(decontaminate.leaks(documents(spark, texts), items_frame(spark, [" ".join(x) for x in items])))
    assert len(expected) >= 450
    assert len(got & expected) >= 0.97 * len(expected)


def test_lcs_by_bits():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 70)), rng.integers(-1, 5, rng.integers(0, 90))
        assert decontaminate.lcs(a, b) == plain_lcs(a.tolist(), b.tolist())


def test_answers_nulls_repeats_and_empty_tables(spark):
    item = " ".join(prose(7, 20))
    bench = spark.createDataFrame(
        [(1, item, "forty two"), (1, item, "forty two"), (2, None, None), (None, "w1 w2", None), (3, "", "x")],
        "item_id long, text string, answer string",
    )
    texts = [*ODD, item, item, None, "start " + item + " end"]
    ids = [*range(len(ODD)), 20, 20, None, None]
    got = decontaminate.leaks(documents(spark, texts, ids), bench, answer_col="answer").collect()
    assert {(r.doc_id, r.item_id, round(r.lcs, 3), r.answered) for r in got} == {(20, 1, 1.0, False), (None, 1, 1.0, False)}
    half = " ".join(item.split()[:11])
    docs = documents(spark, [half + " forty two", half, *[" ".join(prose((8, i), 30)) for i in range(20)]])
    assert pairs(decontaminate.leaks(docs, bench, answer_col="answer")) == {(0, 1)}
    assert decontaminate.leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.leaks(docs, bench.limit(0).select("item_id", "text")).collect() == []


def test_items_of_any_length(spark):
    """Copies and reworded copies of long items, in long documents."""
    rng = random.Random(6)
    items = [prose((6, i), n, 5000) for i, n in enumerate([60, 64, 65, 100, 150, 200, 250, 500, 1200])]
    texts, expected = [], set()
    for i, item in enumerate(items):
        for kind in ("copy", "reworded"):
            body = item if kind == "copy" else [w if rng.random() > 0.12 else f"w{rng.randrange(5000)}" for w in item if rng.random() > 0.08]
            ws = prose((6, "d", i, kind), 300, 5000)
            at = rng.randrange(300)
            expected.add((len(texts), i))
            texts.append(" ".join(ws[:at] + body + ws[at:]))
    # a part of an item that is less than what counts
    texts.append(" ".join(items[-1][:400]))
    texts += [" ".join(prose((6, "b", i), 200, 5000)) for i in range(100)]
    frame = items_frame(spark, [" ".join(x) for x in items])
    got = decontaminate.leaks(documents(spark, texts), frame)
    assert pairs(got) == expected
    whole = {(r.doc_id, r.item_id) for r in got.collect() if r.lcs == 1.0}
    assert {(2 * i, i) for i in range(len(items))} <= whole
    assert pairs(decontaminate.leaks(documents(spark, texts), frame, block=16)) == expected


def test_items_in_several_parts(spark, monkeypatch):
    items, texts = corpus(3)
    docs, bench = documents(spark, texts), items_frame(spark, items)
    one = pairs(decontaminate.leaks(docs, bench))
    monkeypatch.setattr(decontaminate, "WORDS", 200)
    many = pairs(decontaminate.leaks(docs, bench))
    assert len(one ^ many) <= 0.05 * len(one)


def test_item_inside_a_very_long_text(spark):
    item = prose(8, 80)
    texts = ["the of " * 200_000 + " ".join(item) + " the of" * 200_000, "the of", " ".join(prose(9, 50))]
    got = decontaminate.leaks(documents(spark, texts), items_frame(spark, [" ".join(item)])).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in got] == [(0, 0, 1.0)] and abs(got[0].word - 400_000) < 100
