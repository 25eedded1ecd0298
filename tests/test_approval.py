import pytest
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.operators import approval, cleaning, crosstab, overrides, summary
from tests.fixtures import by, groups, lines

DENIED = {"status_name": "DENIED - MD"}
AUTO = {"status_name": "APPROVED - AUTO"}


def _decided(spark, *rows):
    return overrides.start_decisions(groups(spark, *rows))


def _clean(spark, *rows):
    return cleaning.clean_referrals(lines(spark, *rows))


def _scored(spark, *rows, decided=({},)):
    return approval.score_lines(_clean(spark, *rows), _decided(spark, *decided))


@pytest.mark.parametrize(
    ("row", "expected"),
    [({}, 1), ({"ref_type": None}, 1), ({"ref_type": "EMERGENCY ROOM"}, 0), ({"ppl": "N"}, 0), ({"cpt_code": "1"}, 0),
     ({"specialty": None}, 0)],
)
def test_line_status(spark, row, expected):
    assert _scored(spark, row).first()["auto_approvable"] == expected
    allowed = approval.allow_list(_decided(spark, {}))
    assert approval.assign_status(_clean(spark, row), allowed).first()["auto_approvable"] == expected


def test_allow_list_is_distinct_and_in_network(spark):
    decided = _decided(spark, {}, {}, {"is_ppl": 0, "cpt_code": "2"}, {"fin_aa_rec": 0, "cpt_code": "3"})
    assert [tuple(r) for r in approval.allow_list(decided).collect()] == [("CARDIOLOGY", "99203")]
    assert [tuple(r) for r in approval.allow_list(decided, is_ppl=0).collect()] == [("CARDIOLOGY", "2")]


def test_specialty_without_codes_counts_zero(spark):
    allowed = approval.allow_list(_decided(spark, {}))
    specialties = spark.createDataFrame([("CARDIOLOGY",), ("X",), (None,)], "specialty string")
    out = by(approval.allow_list_counts(allowed, specialties), "specialty")
    assert {k: v["num_codes"] for k, v in out.items()} == {"CARDIOLOGY": 1, "X": 0}


def test_one_line_to_pend_pends_the_referral(spark):
    scored = _scored(spark, {}, {}, {"cpt_code": "1"}, {"auth_number": "A2"}, {"auth_number": None})
    out = by(approval.referral_decision(scored), "auth_number")
    assert {k: v["aa_yn"] for k, v in out.items()} == {"A1": 0, "A2": 1}
    attached = approval.attach_referral_decision(scored).collect()
    assert sorted((r["auth_number"] or "", r["aa_yn"]) for r in attached) == [
        ("", None), ("A1", 0), ("A1", 0), ("A1", 0), ("A2", 1),
    ]


def test_predicted_rate_with_haircut(spark):
    scored = _scored(spark, {}, {"auth_number": "A2", "cpt_code": "1"})
    out = approval.predicted_rate(approval.referral_decision(scored), K.RATE_HAIRCUT).first()[0]
    assert out == pytest.approx(0.46)


def test_false_positives_need_a_whole_approvable_referral(spark):
    scored = _scored(
        spark, DENIED, {"auth_number": "A2", **DENIED}, {"auth_number": "A2", "cpt_code": "1"}, {"auth_number": "A3"},
        {"auth_number": None, **DENIED},
    )
    assert [r["auth_number"] for r in approval.false_positives(scored).collect()] == ["A1"]


def test_last_rows_and_lookup(spark):
    frame = _clean(spark, *[{"auth_number": f"A{i:02d}"} for i in range(20)])
    last = approval.last_rows(frame, ["auth_number"], 3).collect()
    assert [r["auth_number"] for r in last] == ["A19", "A18", "A17"]
    assert approval.referral_lookup(frame, "CARDIOLOGY", "99203", "A05").count() == 1


def test_summary_matches_the_line_level_reports(spark):
    rows = [
        {}, {"auth_number": "A1", **DENIED}, {"auth_number": "A2", **AUTO}, {"auth_number": "A3", "cpt_code": "1", **AUTO},
        {"auth_number": "A4", "ref_type": None, **DENIED}, {"auth_number": None, **DENIED},
        {"auth_number": "A5", "specialty": "AAA FIRST", "cpt_code": "9"},
        {"auth_number": "A6", "specialty": "NO TYPE", "ref_type": None},
        {"auth_number": "A7", "specialty": None},
    ]
    decided = _decided(spark, {}, {"cpt_code": "1", "fin_aa_rec": 0, "roi": 2.0}, {"specialty": "AAA FIRST", "cpt_code": "9", "avg_hcp_cost": None, "roi": 100.0, "fin_aa_rec": 0})
    clean = _clean(spark, *rows)
    report = by(summary.specialty_summary(clean, decided, 4.0), "specialty")
    scored = approval.score_lines(clean, decided)
    rollup = summary.referral_rollup(scored)
    rates = by(summary.specialty_rates(rollup), "specialty")
    false = by(summary.denied_now_approved(rollup), "specialty")
    dollars = by(summary.specialty_financials(summary.scored_line_financials(clean, decided, 4.0)), "specialty")
    # every specialty with a complete referral, also the alphabetically first
    assert set(report) == {"AAA FIRST", "CARDIOLOGY"} == set(rates)
    for name, row in report.items():
        for part in (rates, false, dollars):
            for column, value in part[name].items():
                assert row[column] == pytest.approx(value), column
        assert row["net_benefit"] == pytest.approx(
            row["cost_to_review_bene"] - row["cost_to_review_loss"] - row["dollars_denied_now_app"]
        )
    assert report["CARDIOLOGY"]["ref_vol"] == 3
    # two denied lines, one of a referral without type: dollars count both
    assert report["CARDIOLOGY"]["dollars_denied_now_app"] == 20.0
    assert report["AAA FIRST"]["dollars_denied_now_app"] == 0.0
    assert report["AAA FIRST"]["num_codes"] == 0


def test_code_detail_leaves_out_codes_without_name(spark):
    decided = _decided(spark, {}, {"cpt_code": "1"}).withColumns(
        {c: F.lit(None).cast("double") for c in ("auto_rate", "denial_rate", "cost_to_review", "sum_cost_denied")}
    )
    rates = summary.projected_code_rate(_scored(spark, {}, {"cpt_code": "1"}))
    names = spark.createDataFrame([("visit", "99203")], "name string, cpt_code string")
    out = summary.code_detail(decided, rates, names).collect()
    assert [(r["cpt_code"], r["cpt_desc"], r["new_rate"]) for r in out] == [("99203", "visit", 0.0)]


def test_projected_rate_ignores_lines_without_referral(spark):
    scored = _scored(spark, {}, {"auth_number": "A2"}, {"auth_number": "A2", "cpt_code": "x"}, {"auth_number": None})
    out = by(summary.projected_code_rate(scored), "cpt_code")
    assert out["99203"]["new_rate"] == 0.5 and out["x"]["new_rate"] == 0.0


def _cells(df, *keys):
    return {k: v["n"] for k, v in by(df, *keys).items()}


def test_crosstab_totals_leave_out_missing_keys(spark):
    frame = spark.createDataFrame(
        [(0, 0, "a"), (0, 1, "b"), (1, None, "c"), (1, 0, "d"), (1, 0, None)],
        "is_autoapp int, is_den int, auth_number string",
    )
    out = _cells(crosstab.auto_by_denied(frame), "is_autoapp", "is_den")
    assert out == {("0", "0"): 1, ("0", "1"): 1, ("1", "0"): 1, ("All", "All"): 3}


def test_crosstab_margins_add_up(spark):
    rows = [{"auth_number": f"A{i}", "urgent": ["R", "U", None][i % 3], "cpt_code": ["99203", "1"][i % 2]} for i in range(30)]
    scored = _scored(spark, *rows, {"auth_number": None})
    out = _cells(crosstab.lines_by_priority(scored), "aa_yn", "urgent")
    inner = {k: v for k, v in out.items() if "All" not in k}
    assert sum(inner.values()) == out[("All", "All")] == 20
    for margin in ("0", "1"):
        assert sum(v for k, v in inner.items() if k[0] == margin) == out[(margin, "All")]
    lines_total = _cells(crosstab.lines_by_decision(scored), "aa_yn", "is_den")[("All", "All")]
    assert lines_total == 30  # the line without referral has no decision
    old = _cells(crosstab.old_by_new(scored), "is_autoapp", "is_den", "aa_yn")
    assert old[("All", "All", "All")] == 30 and old[("0", "0", "All")] == 30


def test_frequency_is_sorted_and_drops_missing(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in crosstab.frequency(frame, "x").collect()] == [("b", 2), ("a", 1)]
