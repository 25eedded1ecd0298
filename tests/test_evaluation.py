import random

import numpy as np
import pandas as pd
import pytest

from clearlane.operators import evaluation, ranking
from tests.fixtures import by, decisions, lines, predictions


def test_preparation(spark):
    out = by(
        evaluation.prepare_predictions(
            predictions(
                spark,
                {"referral_ident": "1", "ref_to_status": None, "status_type_human": None},
                {"referral_ident": "2", "ref_to_status": "PPL EMPLOYED", "ref_to_specialty": "SLEEP MEDICINE"},
                {"referral_ident": "3", "ref_to_status": "SOMETHING", "status_type_human": "CANCEL"},
            )
        ),
        "referral_ident",
    )
    assert [(out[i]["is_ppl"], out[i]["is_approved"]) for i in "123"] == [(0, 0), (1, 1), (None, 0)]
    assert out["1"]["ref_to_status"] == "EPL CONTRACTED"
    assert out["2"]["ref_to_specialty"] == "PULMONARY DISEASE"


@pytest.mark.parametrize("kind", ["spread", "ties", "hot value", "few"])
def test_deciles_equal_quantile_cut(spark, kind):
    rng = random.Random(3)
    values = {
        "spread": [rng.random() for _ in range(4001)],
        "ties": [float(rng.randint(0, 400)) for _ in range(5000)],
        "hot value": [rng.random() for _ in range(1000)] + [2.0] * 50,
        "few": [float(i) for i in range(11)],
    }[kind]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").repartition(7)
    got = by(ranking.quantile_bin(frame, "x", 10, "bin"), "i")
    want = pd.qcut(pd.Series(values), 10, labels=False)
    assert [got[i]["bin"] for i in range(len(values))] == list(want)


def test_value_that_fills_a_third_merges_edges(spark):
    values = [1.0] * 500 + [float(i) for i in range(2, 1002)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, x double")
    got = by(ranking.quantile_bin(frame, "x", 10, "bin"), "i")
    assert got[-1]["bin"] is None
    assert {got[i]["bin"] for i in range(500)} == {0}
    edges = pd.Series(values).quantile([p / 10 for p in range(1, 10)])
    assert all(got[i]["bin"] == sum(v > e for e in edges) for i, v in enumerate(values))


def test_no_value_at_all(spark):
    frame = spark.createDataFrame([(1, None)], "i int, x double")
    assert ranking.quantile_bin(frame, "x", 10, "bin").first()["bin"] is None


def test_running_total_and_numbers(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 9)) for k in rng.sample(range(10_000), 3000)]
    out = by(ranking.running_total(spark.createDataFrame(rows, "k int, w bigint"), ["k"], "w", "t"), "k")
    total = 0
    for k, w in sorted(rows):
        total += w
        assert out[k]["t"] == total
    numbered = by(ranking.sequence_number(spark.createDataFrame(rows, "k int, w bigint"), ["k"], "nr"), "k")
    assert [numbered[k]["nr"] for k, _ in sorted(rows)] == list(range(1, 3001))


def _sheet(spark):
    return decisions(
        spark,
        {"avg_cost": 10.0, "decision": 1}, {"cpt_code": "2", "avg_cost": None, "decision": 0, "reason": "RNL"},
        {"is_ppl": 0, "avg_cost": 99.0, "decision": 0},
    )


def test_referral_cost(spark):
    frame = lines(
        spark, {}, {}, {"cpt_code": "2"}, {"auth_number": "A2", "cpt_code": "2"}, {"auth_number": None},
        {"auth_number": "A3", "status_name": "APPROVED - RETRO REVIEW"},
    )
    out = by(evaluation.referral_cost(frame, _sheet(spark)), "auth_number")
    assert {k: v["avg_cost"] for k, v in out.items()} == {"A1": 20.0, "A2": 0.0, "A3": 10.0}


def test_missing_specialty_matches_missing_specialty(spark):
    sheet = decisions(spark, {"specialty": None, "avg_cost": 7.0})
    out = evaluation.referral_cost(lines(spark, {"specialty": None}), sheet).first()
    assert out["avg_cost"] == 7.0


def _evaluated(spark):
    rows = [
        {"referral_ident": "A1", "status_type_human": "DENIED"}, {"referral_ident": "A2", "status_type_human": None},
        {"referral_ident": "A9", "status_type_human": "DENIED"}, {"referral_ident": "A9", "status_type_human": "CANCEL"},
        {"referral_ident": "A1"}, {"referral_ident": None, "status_type_human": "DENIED"},
    ]
    rows = [{**r, "confidence": 0.1 * i} for i, r in enumerate(rows)]
    prepared = evaluation.confidence_decile(evaluation.prepare_predictions(predictions(spark, *rows)))
    matched = evaluation.with_decisions(prepared, _sheet(spark))
    costs = evaluation.referral_cost(lines(spark, {}, {"auth_number": "A2", "cpt_code": "2"}), _sheet(spark))
    return matched, costs


def test_default_cost_is_for_unmatched_referrals_only(spark):
    matched, costs = _evaluated(spark)
    out = by(evaluation.false_positive_dollars(matched, costs), "referral_ident", "status_type_human")
    assert out[("A1", "DENIED")]["false_positive_dollars"] == 10.0
    assert out[("A2", None)]["false_positive_dollars"] == 0.0
    assert out[("A9", "DENIED")]["false_positive_dollars"] == 150.0
    assert out[(None, "DENIED")]["false_positive_dollars"] == 150.0
    assert out[("A1", "APPROVED")]["false_positive_dollars"] == 0.0


def test_reports_agree_with_the_candidates(spark):
    matched, costs = _evaluated(spark)
    cells = evaluation.evaluation_cells(matched, costs)
    report = by(evaluation.decile_report(cells), "decile")
    assert report["All"]["candidates"] == 6
    assert report["All"]["false_positive_dollars"] == 460.0
    assert report["All"]["dollars_not_cancelled"] == 310.0  # a missing status is not cancelled
    statuses = by(evaluation.decile_status(cells, decile=9), "status_type_human")
    assert statuses == {
        "DENIED": {"status_type_human": "DENIED", "n": 0}, "All": {"status_type_human": "All", "n": 0}
    }


def test_decision_reason_pairs_keep_empty_cells(spark):
    rows = [(9, "DENIED", 0, 1, "DBA", 2), (9, "APPROVED", 1, 0, "RNL", 3), (9, "APPROVED", 1, None, None, 5), (8, "x", 1, 1, "RNL", 7)]
    cells = spark.createDataFrame(
        [(*r, r[5], 0.0) for r in rows],
        "decile int, status_type_human string, is_approved int, decision int, reason string, candidates bigint, "
        "referrals bigint, false_positive_dollars double",
    )
    out = {k: v["n"] for k, v in by(evaluation.decision_reason_crosstab(cells), "decision", "reason", "is_approved").items()}
    assert out == {
        ("1", "DBA", "0"): 2, ("1", "DBA", "1"): None, ("1", "DBA", "All"): 2,
        ("0", "RNL", "0"): None, ("0", "RNL", "1"): 3, ("0", "RNL", "All"): 3,
        ("0", "DBA", "0"): None, ("0", "DBA", "1"): None, ("0", "DBA", "All"): None,
        ("1", "RNL", "0"): None, ("1", "RNL", "1"): None, ("1", "RNL", "All"): None,
        ("All", "All", "0"): 2, ("All", "All", "1"): 3, ("All", "All", "All"): 5,
    }


def test_nan_is_no_confidence(spark):
    values = [float(i) for i in range(18)] + [float("nan")] * 2 + [None]
    frame = spark.createDataFrame([(v,) for v in values], "c double")
    assert ranking.quantile_edges(frame, "c", 10) == pytest.approx(list(np.quantile(range(18), np.arange(1, 10) / 10)))
    got = {r.c: r.d for r in ranking.quantile_bin(frame, "c", 10, "d").collect() if r.c == r.c}
    assert got[None] is None and got[0.0] == 0 and got[17.0] == 9
    assert all(r.d is None for r in ranking.quantile_bin(frame, "c", 10, "d").filter("isnan(c)").collect())


@pytest.mark.parametrize("kind", ["even", "ties", "few"])
def test_edges_are_exact_on_many_rows(spark, kind):
    rng = np.random.default_rng(3)
    values = {"even": rng.random(60_000), "ties": np.round(rng.normal(size=60_000), 1), "few": rng.random(3)}[kind]
    frame = spark.createDataFrame([(float(v),) for v in values], "c double").repartition(5)
    assert ranking.quantile_edges(frame, "c", 10) == pytest.approx(list(np.quantile(values, np.arange(1, 10) / 10)), abs=1e-12)


def test_merged_month_sketches_give_the_same_edges(spark):
    rng = random.Random(8)
    rows = [(f"2019-{1 + i % 5:02d}", rng.choice([rng.random(), float(rng.randint(0, 3)), None, float("nan")])) for i in range(6000)]
    frame = spark.createDataFrame(rows, "month string, x double").repartition(9)
    sketch = ranking.merged_sketch(ranking.quantile_sketches(frame, "x", "month"))
    values = [v for _, v in rows if v is not None and v == v]
    want = [float(e) for e in np.quantile(values, [p / 10 for p in range(1, 10)])]
    assert ranking.quantile_edges(frame, "x", 10, sketch) == pytest.approx(want, abs=1e-12)
    assert ranking.quantile_edges(frame, "x", 10) == ranking.quantile_edges(frame, "x", 10, sketch)
    nothing = frame.filter("x > 100")
    assert ranking.quantile_edges(nothing, "x", 10, ranking.merged_sketch(ranking.quantile_sketches(nothing, "x", "month"))) == []


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """Sketches are right with high probability only; the counts show a miss."""
    rng = random.Random(9)
    values = [rng.random() for _ in range(5000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    monkeypatch.setattr(ranking, "SKETCH", 8)
    monkeypatch.setattr(ranking, "ROOM", 1e-6)
    assert ranking.quantile_edges(frame, "x", 10) == pytest.approx([float(e) for e in np.quantile(values, [p / 10 for p in range(1, 10)])], abs=1e-12)


def test_a_sketch_of_other_values_is_an_error(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    sketch = ranking.merged_sketch(ranking.quantile_sketches(frame.filter("x < 40"), "x"))
    with pytest.raises(ValueError, match="not one of these values"):
        ranking.quantile_edges(frame, "x", 10, sketch)


def test_edges_take_two_passes_over_the_rows(spark, monkeypatch):
    frame = spark.createDataFrame([(float(i % 700),) for i in range(5000)], "x double")
    passes, whole = [], ranking._values
    monkeypatch.setattr(ranking, "_values", lambda *a: passes.append(1) or whole(*a))
    ranking.quantile_edges(frame, "x", 10)
    assert len(passes) == 2
    sketch = ranking.merged_sketch(ranking.quantile_sketches(frame, "x"))
    passes.clear()
    ranking.quantile_edges(frame, "x", 10, sketch)
    assert len(passes) == 1
