import random

from clearlane.llm import mixing
from tests.llm.cases import ODD, documents, words


def targets(rows):
    """By repeated filling: who is above its limit is full, the rest share again."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        rest = sum(weight[s] for s in size if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / rest for s in size}
        above = {s for s in size if s not in full and target[s] > 3 * size[s] * (1 + 1e-12)}
        if not above:
            return size, target
        full |= above


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(sources)) for i in range(n)]


def frame(spark, rows):
    return documents(spark, [r[1] for r in rows], [r[0] for r in rows], sources=[r[2] for r in rows])


def test_targets_and_taken(spark):
    rows = rows_of(1, 900, ["b", "a", "a", "a", "\u00e9", None, "tiny", "zz"]) + [(5000, "x", "small"), (5001, None, "void")]
    size, target = targets(rows)
    df = frame(spark, rows)
    out = mixing.mix_sources(df, block=16).collect()
    source = {i: s for i, _, s in rows}
    assert len(out) == len(rows)
    taken = {s: 0 for s in size}
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (len(words(rows[r.doc_id][1] if r.doc_id < 900 else dict((a, b) for a, b, _ in rows)[r.doc_id])), size[s])
        assert abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 300 for s in size)  # one document
    again = mixing.mix_sources(df.repartition(7), block=16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_copies_are_right_on_average(spark):
    """Over many seeds, every document is taken target / source size times."""
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(24)]
    df = frame(spark, rows).select("doc_id", "text", "source").cache()
    times, runs = [0] * 24, 12
    seed = mixing.SEED
    try:
        for k in range(runs):
            mixing.SEED = 100 + k
            for r in mixing.mix_sources(df, weights=(1, 1), block=4).collect():
                times[r.doc_id] += r.copies
    finally:
        mixing.SEED = seed
    size, _ = targets(rows)
    share = {s: sum(size.values()) / 2 / size[s] for s in size}
    for s in "ab":
        mean = sum(times[i] for i in range(24) if rows[i][2] == s) / 12 / runs
        assert abs(mean - share[s]) < 0.15


def test_nulls_repeats_and_no_words(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(3, "a b c", "s"), (3, "a b c", "s"), (None, "d e", "s"), (None, None, "s")]
    out = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.taken == r.size * r.copies for r in out)
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", "b")])).collect())
    assert mixing.mix_sources(frame(spark, rows).limit(0)).collect() == []


def test_rows_are_repeated(spark):
    rows = rows_of(3, 60, ["a", "b", None]) + [(None, "x y z", "a")]
    df = frame(spark, rows)
    mixed = mixing.mix_sources(df)
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    out = mixing.repeat_rows(df, mixed)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
