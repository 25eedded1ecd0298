import random

import pyarrow as pa
import pytest

from clearlane.llm import minhash
from tests.llm.cases import ODD, documents, lowered, prose


def shingles(text):
    ws = lowered(text)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, s in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted([(i, len(s), root(i) if i is not None else None) for i, s in sets], key=str)


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in rows], key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for family in range(12):
        base = prose(family, rng.choice([30, 80, 200, 400]))
        for _ in range(rng.choice([1, 3, 12])):
            ws = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):  # similarities on both sides of the threshold
                ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                ws = [w.upper() for w in ws]
            texts.append(" ".join(ws))
            base = ws if rng.random() < 0.3 else base  # chains
    rng.shuffle(texts)
    df = documents(spark, texts)
    assert result(minhash.near_duplicates(df)) == brute(list(enumerate(texts)))


def test_odd_texts_nulls_and_repeats(spark):
    texts = [*ODD, *ODD, "A B C D E", None, "one"]
    ids = [*range(2 * len(ODD)), 50, None, None]
    df = documents(spark, [*texts, texts[6], texts[6]], [*ids, 6, 60])
    rows = list(zip([*ids, 6, 60], [*texts, texts[6], texts[6]], strict=True))
    assert result(minhash.near_duplicates(df)) == brute(rows)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_pruning_keeps_what_reaches_the_threshold():
    least = minhash.least_matches()
    assert [n for n, _ in least] == [20, 40, 60, 80, 100]
    assert all(0 < m < 0.85 * n for n, m in least)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "x long, y long")
    got = {r.doc_id: r.component_id for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def edited(base, rng, edits):
    ws = list(base)
    for at in rng.sample(range(len(ws)), edits):
        ws[at] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


@pytest.mark.parametrize("percent,rows", [(85, 5), (80, 4)])
def test_large_group_on_both_sides_of_the_threshold(spark, percent, rows):
    """Every text has its own edits of one base that is not there itself."""
    rng = random.Random(percent)
    base = prose("group", 150)
    texts = [edited(base, rng, 2 + i % 2) for i in range(220)]
    df = documents(spark, texts)
    expected = brute(list(enumerate(texts)), percent)
    assert len({c for _, _, c in expected}) > 20
    assert result(minhash.near_duplicates(df, percent=percent, rows=rows)) == expected


def test_far_pairs_of_a_group_are_not_made(spark):
    """The join of a bucket gives the pairs whose parities allow a link."""
    rng = random.Random(2)
    base = prose("group", 150)
    texts = [edited(base, rng, 2) for i in range(150)]
    made = []
    whole = minhash._crossing
    try:
        minhash._crossing = lambda *a: made.append(whole(*a)) or made[-1]
        minhash.near_duplicates(documents(spark, texts)).collect()
    finally:
        minhash._crossing = whole
    sets = [shingles(t) for t in texts]
    near = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert made[0].count() <= near < 150 * 149 / 2 / 4


def test_parity_bounds_the_difference():
    rng = random.Random(3)
    base = prose("p", 300)
    texts = pa.array([edited(base, rng, k % 9) for k in range(30)] + [None, "", "a b c d e f"])
    column = pa.RecordBatch.from_arrays([pa.array(range(33)), texts], names=["doc_id", "text"])
    parity = [x["parity"] for b in minhash._parities(iter([column]), 5) for x in b.to_pylist()]
    sets = [shingles(t.as_py()) for t in texts]
    for a, p in zip(sets, parity, strict=True):
        for b, q in zip(sets, parity, strict=True):
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q, strict=True))
            assert apart <= len(a ^ b) and apart % 2 == len(a ^ b) % 2
            assert len(a ^ b) > 150 or apart >= len(a ^ b) * 0.7
