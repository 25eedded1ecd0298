import pytest

from clearlane import constants as K
from clearlane.operators import cleaning
from tests.fixtures import by, decisions, lines


def test_missing_network_mark_is_out_of_network(spark):
    rows = by(
        cleaning.clean_referrals(
            lines(spark, {"auth_number": "1", "ppl": None}, {"auth_number": "2"}, {"auth_number": "3", "ppl": "N"})
        ),
        "auth_number",
    )
    assert [rows[a]["is_ppl"] for a in "123"] == [0, 1, 0]


@pytest.mark.parametrize(
    ("lob", "expected"),
    [(None, None), ("OTHER", "RADIOLOGYOTHER"), ("SENIOR", "RADIOLOGY_senior"), ("MEDI-CAL", "RADIOLOGY_not_sen")],
)
def test_radiology_is_split_by_line_of_business(spark, lob, expected):
    out = cleaning.split_specialties(lines(spark, {"specialty": "RADIOLOGY", "lob": lob})).first()
    assert out["specialty"] == expected


def test_other_specialties_keep_their_name(spark):
    assert cleaning.split_specialties(lines(spark, {"lob": None})).first()["specialty"] == "CARDIOLOGY"


@pytest.mark.parametrize(
    ("rules", "suffix"), [(cleaning.RULES_A, "_s"), (cleaning.RULES_M, "_b"), (cleaning.RULES_C, "_not_sen")]
)
def test_suffix_differs_by_generation(spark, rules, suffix):
    row = cleaning.split_specialties(lines(spark, {"specialty": "RADIOLOGY", "lob": "MEDI-CAL"}), rules).first()
    assert row["specialty"] == "RADIOLOGY" + suffix


def test_retro_lines_leave_and_missing_status_stays(spark):
    names = [*K.RETRO_STATUSES, None, "APPROVED - CM"]
    out = cleaning.clean_referrals(lines(spark, *[{"status_name": n} for n in names])).collect()
    assert {r["status_name"] for r in out} == {None, "APPROVED - CM"}


def test_denied_and_approved_flags(spark):
    names = [*K.DENIED_STATUSES, "DENIED - MODIFIED", None, "APPROVED - AUTO"]
    out = by(cleaning.clean_referrals(lines(spark, *[{"status_name": n} for n in names])), "status_name")
    assert len(K.DENIED_STATUSES) == 10
    assert all(out[n]["is_den"] == 1 for n in K.DENIED_STATUSES)
    assert out["DENIED - MODIFIED"]["is_den"] == 0 and out[None]["is_den"] == 0
    assert out["APPROVED - AUTO"]["is_autoapp"] == 1 and out[None]["is_autoapp"] == 0


def test_volume_is_lines_unless_source_units_are_kept(spark):
    frame = lines(spark, {"units": 7.0})
    assert cleaning.clean_referrals(frame).first()["units"] == 1.0
    assert cleaning.clean_referrals(frame, cleaning.RULES_A).first()["units"] == 7.0


def test_referral_number_required_for_new_lines_only(spark):
    frame = lines(spark, {"auth_number": None}, {})
    assert cleaning.clean_referrals(frame, cleaning.RULES_A_NEW).count() == 1
    assert cleaning.clean_referrals(frame, cleaning.RULES_A).count() == 2


def test_first_line_is_the_earliest_with_stable_ties(spark):
    from datetime import datetime

    frame = lines(
        spark,
        {"auth_number": "1", "date_received": datetime(2019, 2, 1), "cpt_code": "1"},
        {"auth_number": "1", "date_received": datetime(2019, 1, 1), "cpt_code": "3"},
        {"auth_number": "1", "date_received": datetime(2019, 1, 1), "cpt_code": "2"},
        {"auth_number": None},
    )
    assert [r["cpt_code"] for r in cleaning.first_line_per_referral(frame).collect()] == ["2"]
    plan = cleaning.first_line_per_referral(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # reduced before the shuffle


def test_region_ignores_case(spark):
    assert cleaning.in_region(lines(spark, {}), "SOUTH BAY").count() == 1


def test_notes_are_normalised(spark):
    frame = decisions(spark, *[{"reason": r} for r in ("drug?", "UPCODING", "other", None)])
    out = cleaning.normalise_notes(frame, "reason").collect()
    assert {r["reason"] for r in out} == {"UD", "upcode", "other", None}


def test_union_of_specialties_with_extra(spark):
    a = lines(spark, {"specialty": "X"}, {"specialty": "X"}, {"specialty": None})
    b = lines(spark, {"specialty": "Y"}, {"specialty": "X"})
    out = [r[0] for r in cleaning.all_specialties(a, b, extra=("Z",)).collect()]
    assert len(out) == 4 and set(out) == {None, "X", "Y", "Z"}
