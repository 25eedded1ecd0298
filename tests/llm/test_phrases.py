import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clearlane.llm import phrases
from clearlane.operators import staging
from tests.llm.cases import ODD, UPPER, documents
from tests.test_staging import row_groups


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
        words = re.findall("[^ \t]+", piece)
        if words:
            yield words


def brute(rows, least, longest, top):
    """rows: (text, lang). One tuple for each collocation."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if 2 <= len(p) and a >= least}
        inside = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    part = p[i : i + m]
                    inside[part] = max(inside.get(part, 0), a)
        found = []
        for p, a in candidates.items():
            if inside.get(p, 0) >= a:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    known = ["of the", "New York City", "in spite of the fact", "the the the", "\u00e9t\u00e9 \u00c9T\u00c9", "x y"]
    vocabulary = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(known) if rng.random() < 0.4 else rng.choice(vocabulary))
            if rng.random() < 0.1:
                parts.append(rng.choice([",", ".", " ; ", "\n", "?!", "\x0b"]))
        texts.append(rng.choice([" ", "\t", "  "]).join(parts))
    return texts, [rng.choice(["en", "de", None, "und", "x"]) for _ in texts]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_brute_force(spark, seed):
    texts, langs = corpus(seed)
    texts, langs = texts + ODD, langs + ["en"] * len(ODD)
    df = documents(spark, texts, langs=langs)
    expected = brute(list(zip(texts, langs, strict=True)), 4, 5, 50)
    assert any(len(r[2].split(" ")) == 5 for r in expected)
    assert result(phrases.collocations(df, least=4, top=50)) == expected
    assert result(phrases.collocations(df, least=3, longest=3, top=None)) == brute(list(zip(texts, langs, strict=True)), 3, 3, 10**9)


def test_small_slices_tiles_and_steps_give_the_same(spark, monkeypatch):
    """Many slices, a tree of several steps, both ways to count a tile."""
    rng = random.Random(5)
    left, right = np.array([rng.randrange(3000) for _ in range(20_000)]), np.array([rng.randrange(3000) for _ in range(20_000)])
    sparse = phrases.count_pairs(left, right)
    monkeypatch.setattr(phrases, "DENSE", 1)
    dense = phrases.count_pairs(left, right)
    assert all((a == b).all() for a, b in zip(sparse, dense, strict=True)) and dense[2].sum() == 20_000
    cells = [np.unique(np.array([rng.randrange(5000) for _ in range(900)], np.int32)) for _ in range(3)]
    counted = [np.arange(1, len(c) + 1) for c in cells]
    by_address = phrases._added(cells, counted)
    monkeypatch.setattr(phrases, "DENSE", 1 << 30)
    assert all((a == b).all() for a, b in zip(phrases._added(cells, counted), by_address, strict=True))
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "FAN", 2)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 3)
    texts, langs = corpus(9, 40)
    df = documents(spark, texts, langs=langs).repartition(13)
    assert result(phrases.collocations(df, least=4)) == brute(list(zip(texts, langs, strict=True)), 4, 5, 2000)


def test_packing_gives_the_numbers_back():
    rng = np.random.default_rng(1)
    for kind in (np.int32, np.int64):
        for n in (0, 1, 1000):
            values = rng.integers(-5, 1 << 30, n).astype(kind)
            assert (phrases.unpack(phrases.pack(values), kind) == values).all()
            assert (phrases.unpack_sorted(phrases.pack_sorted(np.sort(values)), kind) == np.sort(values)).all()


def test_pieces_and_slices():
    import pyarrow as pa

    texts = ["A b, c.d", None, "", " ; ", "e", "f\u00a0g h\ti"]
    seq, words = phrases.encode(pa.array(texts))
    names = [words[int(x)].as_py() if x >= 0 else "|" for x in seq]
    assert names == ["a", "b", "|", "c", "|", "d", "|", "e", "|", "f\u00a0g", "h", "i", "|"]


def test_empty_table_nothing_frequent_and_a_very_long_text(spark):
    df = documents(spark, ["a b a b", None])
    assert result(phrases.collocations(df.limit(0))) == []
    assert result(phrases.collocations(df)) == []
    long = " ".join(["the cat sat"] * 400_000)
    got = result(phrases.collocations(documents(spark, [long, "the cat"]), least=100))
    # every phrase of three or four words is inside one of five that is less frequent
    assert got == brute([(long, "en"), ("the cat", "en")], 100, 5, 2000)


def test_hot_row_in_many_copies(spark):
    texts = ["alpha beta gamma"] * 300 + ["beta gamma"] * 50
    got = result(phrases.collocations(documents(spark, texts, ids=[1] * 350)))
    assert got == brute([(t, "en") for t in texts], 100, 5, 2000)


class Task:
    """Stands for the context of a task."""

    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 0


def numpy_peak(run):
    """MB of numpy arrays held at once."""
    tracemalloc.start()
    try:
        got = run()
        return got, tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_a_slice_takes_a_bounded_multiple_of_its_words(monkeypatch):
    """Texts are not kept until their slice is full, and pairs are counted and
    looked up without wide arrays of all places."""
    monkeypatch.setattr(phrases, "TaskContext", Task)
    rng = np.random.default_rng(3)
    names = np.array([f"word{i}" for i in range(20_000)])
    texts = [" ".join(names[np.minimum(rng.zipf(1.3, 2000), 20_000) - 1]) + "." for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 300)], names=["text", "lang"])
    mb = batch.nbytes / (1 << 20)
    assert 3 < mb < 4  # one slice
    (cut,), peak = numpy_peak(lambda: list(phrases._slices(iter([batch]))))
    words = cut["words"][0].values.to_pylist()
    seq = phrases.unpack(cut["seq"][0].as_py(), np.int32)
    assert [" ".join(words[i] for i in x) for x in np.split(seq, np.flatnonzero(seq < 0) + 1) for x in [x[x >= 0]] if len(x)] == [t[:-1] for t in texts]
    assert dict(zip(words, cut["counts"][0].values.to_pylist(), strict=True)) == Counter(w for t in texts for w in t[:-1].split(" "))
    assert peak < 8 * mb
    rank = np.argsort(np.argsort(-np.bincount(seq[seq >= 0]), kind="stable")).astype(np.int32)
    runs = phrases._sequence(1, np.append(rank, np.int32(-1))[seq])
    blocks, peak = numpy_peak(lambda: list(phrases._blocks(iter([runs]))))
    assert peak < 13 * mb
    tiles, ns = blocks[0]["tile"].to_pylist(), [phrases.unpack(x.as_py(), np.int64) for x in blocks[0]["ns"]]
    assert sum(n.sum() for n in ns) == 300 * 1999 and max(len(n) for n in ns) > 1000
    keys = np.concatenate([np.int64(t) << 20 | phrases.unpack_sorted(c.as_py(), np.int32) for t, c in zip(tiles, blocks[0]["cells"], strict=True)])
    known = np.concatenate(ns) >= 3
    ids = np.arange(known.sum(), dtype=np.int32)
    found = [[{"keys": phrases.pack_sorted(keys[known]), "ids": phrases.pack(ids)}]]
    asked = pa.RecordBatch.from_arrays([runs["slice"], runs["seq"], pa.array(found)], names=["slice", "seq", "found"])
    (longer,), peak = numpy_peak(lambda: list(phrases._recode_pairs(iter([asked]))))
    assert peak < 8 * mb
    got = phrases.unpack(longer["seq"][0].as_py(), np.int32)
    paired = Counter(got[got >= 0].tolist())
    counted = np.concatenate(ns)[known]
    assert paired and all(n <= counted[i] for i, n in paired.items())


def test_batches_between_spark_and_python_are_short(spark, monkeypatch):
    seen = []
    inside = phrases.phrase_counts
    monkeypatch.setattr(phrases, "phrase_counts", lambda *x: seen.append(spark.conf.get(phrases.BATCH_LIMIT)) or inside(*x))
    df = documents(spark, ["alpha beta"] * 100)
    assert [r[2] for r in result(phrases.collocations(df))] == ["alpha beta"]
    assert seen == [str(phrases.BATCH_BYTES)] and spark.conf.get(phrases.BATCH_LIMIT, None) is None
    spark.conf.set(phrases.BATCH_LIMIT, "1m")
    try:
        phrases.collocations(df)
        assert seen[1:] == ["1m"] and spark.conf.get(phrases.BATCH_LIMIT) == "1m"
    finally:
        spark.conf.unset(phrases.BATCH_LIMIT)


def test_slices_are_stored_a_few_at_a_time(spark, monkeypatch):
    """Rows of slices are some MB long; a task that writes or reads them holds a few."""
    monkeypatch.setitem(staging.LONG_ROWS, "parquet.block.size", 1 << 20)
    word = "concat('w', CAST((id * 7919 + i * i * 31) % 5000 AS STRING))"
    docs = spark.range(0, 1500, 1, 1).selectExpr(f"array_join(transform(sequence(1, 2000), i -> {word}), ' ') AS text", "'en' AS lang")
    before = staging.staged()
    tables, total = phrases.phrase_counts(docs, "text", "lang", 400, 3)
    assert total.first()["total"] == 1500 * 2000
    assert tables[0].agg({"n": "sum"}).first()[0] <= 1500 * 2000
    found = 0
    for path in set(staging.staged()) - set(before):
        if "seq" in spark.read.parquet(path).columns:
            groups = row_groups(path.removeprefix("file:"))
            assert max(map(max, groups)) <= 2
            found = max(found, *map(len, groups))
    assert found > 1
