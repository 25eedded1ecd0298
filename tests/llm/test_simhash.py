import hashlib
import random

import xxhash

from clearlane.llm import simhash
from tests.llm.cases import ODD, documents, prose, words


def fingerprint(text):
    """Spark's hash of two strings is the hash of the second, seeded by that of the first."""
    ws = words(text)
    votes = [0] * 64
    for a, b in zip(ws, [*ws[1:], None], strict=False):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def brute(rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        like = lambda x, y: 1 - (x ^ y).bit_count() / 64
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c)))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(prose(i, rng.randrange(0, 60), 50)) for i in range(40)] + ODD
    ids = rng.sample(range(-100, 10_000), len(texts))
    assert result(simhash.fingerprint_documents(documents(spark, texts, ids))) == brute(list(zip(ids, texts, strict=True)))


def test_null_and_repeated_ids(spark):
    texts = ["a b c d", "a b c d", "x y", None, "q r s t u", "a b c d", "z " * 9, "m n o"]
    ids = [1, 1, 1, 2, None, 3, None, 3]
    got = result(simhash.fingerprint_documents(documents(spark, texts, ids)))
    assert got == brute(list(zip(ids, texts, strict=True)))


def test_one_row_no_row_only_null_ids(spark):
    one = documents(spark, ["a b c d e f g h"], [5])
    assert result(simhash.fingerprint_documents(one)) == brute([(5, "a b c d e f g h")])
    assert result(simhash.fingerprint_documents(one.limit(0))) == []
    assert result(simhash.fingerprint_documents(documents(spark, ["a b", "c d e f"], [None, None]))) == brute([(None, "a b"), (None, "c d e f")])


def test_near_fingerprints(spark):
    rng = random.Random(2)
    values = []
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(4):
            w = v
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                w ^= 1 << bit
            values.append(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "bits long")
    got = {(r.x, r.y): r.distance for r in simhash.near_fingerprints(df).collect()}
    distinct = sorted(set(signed))
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b): distance(a, b) for a in distinct for b in distinct if a < b and distance(a, b) <= 3}
    assert simhash.near_fingerprints(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = simhash.fingerprint_documents(documents(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
