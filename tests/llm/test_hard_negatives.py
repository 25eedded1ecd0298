import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearlane.llm import hard_negatives as H

def anchors():
    return F.col("vec_id") % 5 == 0


def brute(rows, every=5):
    """(anchor, positive, rank, negative, positive score, negative score)."""
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, v, label in sorted({(i, tuple(v), label) for i, v, label in good if i % every == 0}):
        def score(w):
            return sum(a * b for a, b in zip(v, w, strict=True))

        same = sorted((-score(w), j) for j, w, other in good if other == label and j != i and len(w) == len(v))
        rest = sorted((-score(w), j) for j, w, other in good if other != label and len(w) == len(v))
        for p, j in same[:5]:
            fits = [(-n, k) for n, k in rest if 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, j, rank, k, -p, n) for rank, (n, k) in enumerate(fits[:3], 1)]
    return sorted(out)


def frame(spark, rows):
    rows = [(i, v, label, "x", "y") for i, v, label in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, slot string, score string").repartition(3)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dim, labels=3, shift=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] * 0.5 + rng.normal(size=dim) + shift
        out.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], label))
    return out


@pytest.mark.parametrize("seed,dim,shift", [(1, 16, 0.0), (2, 64, 0.6), (3, 5, 0.3)])
def test_same_as_brute_force(spark, seed, dim, shift):
    rows = vectors(seed, 220, dim, shift=shift)
    rows += [(1000 + k, rows[k][1], (rows[k][2] + k) % 3) for k in range(30)]  # equal scores
    expected = brute(rows)
    assert expected
    assert result(H.mine(frame(spark, rows), anchors())) == expected


def test_blocks_chunks_and_levels_change_nothing(spark, monkeypatch):
    rows = vectors(7, 150, 24, shift=0.4)
    monkeypatch.setattr(H, "BLOCK", 7)
    monkeypatch.setattr(H, "FEW", 0.9)
    assert result(H.mine(frame(spark, rows), anchors())) == brute(rows)


def test_bounds_hold_and_leave_out_rows():
    rng = np.random.default_rng(4)
    for scale in (1, 30_000):
        x = (rng.normal(size=(80, 32)) * 256 * scale + rng.normal(size=(80, 1)) * 300 * scale).clip(-(1 << 23), 1 << 23).astype(np.int32)
        block = H.Block(np.arange(80), np.zeros(80, object), x, H.summaries(x))
        true = x.astype(object) @ x.T.astype(object)
        assert (H.exact(x, x) == true.astype(np.int64)).all()
        limit = np.full(80, int(np.quantile(true.astype(float), 0.95)), np.int64)
        a, r, score = H.open_scores(block, block, np.ones((80, 80), bool), limit, np.full(80, np.iinfo(np.int64).max))
        found = set(zip(a.tolist(), r.tolist(), strict=True))
        assert {(int(i), int(j)) for i, j in zip(*np.nonzero(true >= limit[0]), strict=True)} <= found
        assert len(found) < 80 * 80 * 0.5
        assert all(true[i, j] == s for i, j, s in zip(a, r, score, strict=True))


def test_nulls_odd_values_repeats_and_lengths(spark):
    rng = random.Random(3)
    base = vectors(11, 60, 8, labels=2, shift=0.5)
    odd = [
        (100, None, 1), (105, base[0][1], None), (None, base[0][1], 1), (110, [None] * 8, 1), (115, [float("nan")] * 8, 0),
        (120, [float("inf")] + [0.0] * 7, 0), (125, [], 0), (126, [], 0), (127, [], 1), (130, [0.5, 0.5], 0), (131, [0.6, 0.5], 0), (132, [0.4, 0.4], 1),
        (135, [0.0] * 8, 0), (5, base[5][1], base[5][2]), (5, base[5][1], base[5][2]), (10, base[6][1], 1 - base[10][2]),
    ]
    rows = base + odd + [base[7]] * 4
    rng.shuffle(rows)
    expected = brute(rows)
    assert {125, 130} <= {r[0] for r in expected}
    assert result(H.mine(frame(spark, rows), anchors())) == expected


def test_too_large_components_take_no_part(spark):
    rows = vectors(12, 40, 8, labels=2, shift=0.5)
    assert result(H.mine(frame(spark, [*rows, (200, [1e30] * 8, 0), (202, [40_000.0] * 8, 1)]), anchors())) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    rows = vectors(1, 10, 8)
    assert result(H.mine(frame(spark, rows).limit(0), anchors())) == []
    assert result(H.mine(frame(spark, rows), F.col("vec_id") < 0)) == []
    assert result(H.mine(frame(spark, [(0, [1.0] * 8, 1)]), anchors())) == []


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = vectors(6, 120, 16, labels=3, shift=0.5)
    rows += [(500 + k, rows[3][1], rows[3][2]) for k in range(60)]
    assert result(H.mine(frame(spark, rows), anchors())) == brute(rows)
