import random
from datetime import date

import pytest

from clearlane import constants as K
from clearlane.operators import overrides as O
from tests.fixtures import by, decisions, groups

NO_SHEETS = ("sheet", "sheet_1", "sheet_2", "sheet_3", "sheet_4", "master")


def _started(spark, *rows):
    return O.start_decisions(groups(spark, *rows))


def _sheets(spark, *rows):
    sheet = decisions(spark, *rows) if rows else decisions(spark, {"cpt_code": "none"})
    noted = sheet.withColumnRenamed("reason", "notes")
    return {n: (sheet if n == "master" else noted) for n in NO_SHEETS}


def _outcome(row):
    return row["final_decision"], row["overrule_rsn"], row["dec_source"]


def test_list_sizes():
    assert len(set(K.DERMATOLOGY_CODES)) == len(K.DERMATOLOGY_CODES) == 59
    assert len(set(K.CODES_TO_PEND)) == len(K.CODES_TO_PEND) == 110
    assert len(K.TRANSFUSION_CODES) == 22
    assert len(K.SOFT_PEND_SPECIALTIES) == 44
    assert len(K.HARD_PEND_SPECIALTIES) == 33
    assert len(K.HARD_PEND_SPECIALTIES_A) == 34
    assert set(K.HARD_PEND_SPECIALTIES_A) < set(K.SOFT_PEND_SPECIALTIES)


@pytest.mark.parametrize(("units", "decision"), [(30, 0), (31, 1)])
def test_low_volume_includes_thirty(spark, units, decision):
    row = O.override_low_volume(_started(spark, {"units": units})).first()
    assert row["final_decision"] == decision
    assert row["overrule_rsn"] == ("low volume" if units == 30 else None)


def test_agreeing_decision_changes_nothing(spark):
    sheet = decisions(spark, {"decision": 1, "reason": "Override Pend"})
    assert _outcome(O.overlay_decisions(_started(spark, {}), sheet).first()) == (1, None, "DBA")


def test_differing_decision_overwrites(spark):
    sheet = decisions(spark, {"decision": 0, "reason": "Upcoding"})
    assert _outcome(O.overlay_decisions(_started(spark, {}), sheet).first()) == (0, "Upcoding", "clinical")


def test_empty_decision_changes_nothing(spark):
    sheet = decisions(spark, {"decision": None, "reason": "Upcoding"})
    assert _outcome(O.overlay_decisions(_started(spark, {}), sheet).first()) == (1, None, "DBA")


def test_repeated_decision_key_keeps_the_latest_and_is_reported(spark):
    sheet = decisions(
        spark,
        {"decision": 1, "decision_date": date(2019, 1, 1)},
        {"decision": 0, "decision_date": date(2019, 3, 1), "reason": "late"},
        {"decision": 1, "decision_date": None},
    )
    out = O.overlay_decisions(_started(spark, {}), sheet).collect()
    assert len(out) == 1 and _outcome(out[0]) == (0, "late", "clinical")
    assert O.duplicate_decisions(sheet).first()["copies"] == 3


def test_podiatry_code_is_added_then_removed_then_pended(spark):
    start = _started(spark, {"specialty": "PODIATRY", "cpt_code": "11055", "fin_aa_rec": 0})
    added = O.apply_plan(start, O.PLAN_A[:5], {})
    assert _outcome(added.first()) == (1, "from PRL", "clinical")
    removed = O.apply_plan(start, O.PLAN_A[:6], {})
    assert _outcome(removed.first()) == (0, "from PRL", "clinical")
    pended = O.apply_plan(start, O.PLAN_A[:7], {})
    assert _outcome(pended.first()) == (0, "Soft Pend Specialty", "clinical")


@pytest.mark.parametrize(
    ("plan", "expected"), [(O.PLAN_A, 0), (O.PLAN_B, 1), (O.PLAN_C, 0), (O.PLAN_M, 0)]
)
@pytest.mark.parametrize("row", [{"is_ppl": 0}, {"units": 5}], ids=["out of network", "low volume"])
def test_only_plan_b_lets_a_sheet_undo_a_rule(spark, plan, expected, row):
    sheets = _sheets(spark, {"is_ppl": row.get("is_ppl", 1), "decision": 1, "reason": "x"})
    out = O.apply_plan(_started(spark, row), plan, sheets)
    assert out.first()["final_decision"] == expected


def test_plan_b_applies_code_lists_in_network_only(spark):
    rows = [{"cpt_code": "86900", "is_ppl": p, "fin_aa_rec": 0} for p in (0, 1)]
    start = _started(spark, *rows)
    b = by(O.apply_plan(start, O.PLAN_B[:6], {}), "is_ppl")
    assert [b[p]["final_decision"] for p in (0, 1)] == [0, 1]
    a = by(O.apply_plan(start, O.PLAN_A[:6], {}), "is_ppl")
    assert [a[p]["final_decision"] for p in (0, 1)] == [1, 1]


@pytest.mark.parametrize(
    ("plan", "low", "hard", "network"),
    [
        (O.PLAN_A, "Rule", "clinical", "clinical"),
        (O.PLAN_B, "rule", "rule", "rule"),
        (O.PLAN_C, "rule", "rule", "rule"),
        (O.PLAN_M, "rule", "rule", "rule"),
    ],
)
def test_sources_by_plan(spark, plan, low, hard, network):
    rows = [{"units": 1, "cpt_code": "a"}, {"specialty": "PSYCHIATRY", "cpt_code": "b"}, {"is_ppl": 0, "cpt_code": "c"}]
    out = by(O.apply_plan(_started(spark, *rows), plan, _sheets(spark)), "cpt_code")
    assert [out[c]["dec_source"] for c in "abc"] == [low, hard, network]


def test_result_does_not_depend_on_row_order(spark):
    rng = random.Random(7)
    codes = ["11055", "99203", "86900", "J3301", "x"]
    specs = ["DERMATOLOGY", "PODIATRY", "PSYCHIATRY", "CARDIOLOGY"]
    rows = [
        {"specialty": s, "cpt_code": c, "is_ppl": p, "units": rng.choice([5, 100]), "fin_aa_rec": rng.choice([0, 1])}
        for s in specs for c in codes for p in (0, 1)
    ]
    sheets = _sheets(spark, *[{"specialty": s, "cpt_code": "x", "decision": 1, "reason": s} for s in specs])
    first = by(O.apply_plan(_started(spark, *rows), O.PLAN_M, sheets), "specialty", "cpt_code", "is_ppl")
    rng.shuffle(rows)
    again = by(O.apply_plan(_started(spark, *rows), O.PLAN_M, sheets), "specialty", "cpt_code", "is_ppl")
    assert first == again


def test_a_plan_meets_its_rules_in_one_join(spark):
    sheets = _sheets(spark, {"decision": 0, "reason": "Upcoding"})
    for plan in (O.PLAN_A, O.PLAN_B, O.PLAN_C, O.PLAN_M):
        text = O.apply_plan(_started(spark, {}), plan, sheets)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Join ") == 1 and text.count("Window [") == 1


def test_fold_equals_the_steps_one_by_one(spark):
    rng = random.Random(11)
    specialties, codes = ["PODIATRY", "DERMATOLOGY", "CARDIOLOGY", "PHARMACY", None], ["11055", "10060", "99203", None]
    rows, seen = [], set()
    for _ in range(400):
        key = rng.choice(specialties), rng.choice(codes), rng.choice([0, 1, None])
        if key in seen:
            continue
        seen.add(key)
        rows.append({"specialty": key[0], "cpt_code": key[1], "is_ppl": key[2], "units": rng.choice([5, 30, 31, 900]), "fin_aa_rec": rng.choice([0, 1])})
    noted = [
        {"specialty": s, "cpt_code": c, "is_ppl": p, "decision": rng.choice([0, 1, None]), "reason": f"r{rng.randrange(4)}", "decision_date": date(2019, 1, rng.randrange(1, 5))}
        for s in specialties for c in codes for p in (0, 1) for _ in range(2)
    ]
    sheets = _sheets(spark, *noted)
    start = _started(spark, *rows)
    for plan in (O.PLAN_A, O.PLAN_B, O.PLAN_C, O.PLAN_M, ()):
        want = start
        for step in plan:
            match step:
                case O.Codes():
                    want = O.override_codes(want, step.codes, step.specialties, step.decision, is_ppl=step.is_ppl)
                case O.Specialties():
                    want = O.override_specialties(want, step.specialties, step.reason, step.source)
                case O.Sheet():
                    want = O.overlay_decisions(want, sheets[step.name], step.reason)
                case O.LowVolume():
                    want = O.override_low_volume(want, source=step.source)
                case O.OutOfNetwork():
                    want = O.override_out_of_network(want, step.source)
        got = O.apply_plan(start, plan, sheets)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
