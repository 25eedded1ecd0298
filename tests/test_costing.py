import pytest

from clearlane.operators import cleaning, costing
from clearlane.plans.decisions import analyse
from tests.fixtures import by, claims, lines

AUTO = {"status_name": "APPROVED - AUTO"}
DENIED = {"status_name": "DENIED - MD"}


def _analysed(spark, rows, costs, **options):
    return analyse(cleaning.clean_referrals(lines(spark, *rows)), claims(spark, *costs), **options)


def test_cost_falls_back_to_unweighted_mean_of_the_code(spark):
    out = _analysed(spark, [{}], [("A", "99203", 100, 10.0), ("B", "99203", 1, 30.0)])
    assert out.table.first()["avg_hcp_cost"] == 20.0


def test_own_cost_wins(spark):
    out = _analysed(spark, [{}], [("CARDIOLOGY", "99203", 5, 7.0), ("B", "99203", 1, 30.0)])
    assert out.table.first()["avg_hcp_cost"] == 7.0


def test_unknown_cost_is_never_recommended(spark):
    row = _analysed(spark, [{}], [("A", "other", 1, 1.0)]).table.first()
    assert (row["avg_hcp_cost"], row["roi"], row["fin_aa_rec"]) == (None, 100.0, 0)


def test_never_reviewed_is_recommended(spark):
    rows = [AUTO, {"cpt_code": "2"}]
    row = by(_analysed(spark, rows, [("CARDIOLOGY", "99203", 1, 5.0)]).table, "cpt_code")["99203"]
    assert (row["cost_to_review"], row["units_man"], row["roi"], row["fin_aa_rec"]) == (None, 0, 0.01, 1)


def test_unknown_cost_wins_over_never_reviewed(spark):
    row = by(_analysed(spark, [AUTO, {"cpt_code": "2"}], []).table, "cpt_code")["99203"]
    assert (row["roi"], row["fin_aa_rec"]) == (100.0, 0)


def test_return_of_exactly_one_is_not_recommended(spark):
    out = _analysed(spark, [DENIED], [("CARDIOLOGY", "99203", 1, 50.0)], department_cost=50.0)
    row = out.table.first()
    assert (row["roi"], row["fin_aa_rec"], out.unit_cost) == (1.0, 0, 50.0)


def test_review_cost_adds_up_to_the_department(spark):
    rows = [{}, {"cpt_code": "2"}, {"cpt_code": "2"}, AUTO, {"ppl": "N"}]
    table = _analysed(spark, rows, [], department_cost=1000.0).table
    assert sum(r["cost_to_review"] for r in table.collect()) == pytest.approx(1000.0)


def test_lines_without_specialty_count_for_the_unit_cost_only(spark):
    rows = [{}, {"specialty": None}]
    out = _analysed(spark, rows, [], department_cost=10.0)
    assert out.unit_cost == 5.0 and out.table.count() == 1


def test_unit_cost_can_be_given(spark):
    assert _analysed(spark, [{}], [], unit_cost=2.53).table.first()["cost_to_review"] == 2.53


def test_no_manual_line_at_all(spark):
    out = _analysed(spark, [AUTO], [("CARDIOLOGY", "99203", 1, 5.0)])
    assert out.unit_cost is None and out.table.first()["roi"] == 0.01


def test_manual_volume_has_only_reviewed_groups(spark):
    clean = cleaning.clean_referrals(lines(spark, {}, AUTO, {"cpt_code": "2", **AUTO}))
    assert by(costing.manual_volume(clean), "cpt_code")["99203"]["units_man"] == 1
    assert costing.manual_volume(clean).count() == 1
