import time
from datetime import date, datetime

import pytest

from clearlane.operators import cleaning, period
from tests.fixtures import by, claims, decisions, lines

START, END = datetime(2019, 1, 1), datetime(2019, 1, 11)
MIDDLE = datetime(2019, 1, 6)


def _clean(spark, *rows):
    return cleaning.clean_referrals(lines(spark, *rows))


def test_midpoint_belongs_to_the_later_half(spark):
    dates = [START, MIDDLE, datetime(2019, 1, 5, 23, 59), END, None]
    out = by(period.period_split(_clean(spark, *[{"date_received": d} for d in dates])), "date_received")
    assert [out[d]["post"] for d in dates] == [0, 1, 0, 1, 0]


def test_year_share_counts_whole_days(spark):
    frame = _clean(spark, {"date_received": datetime(2019, 1, 1, 12)}, {"date_received": datetime(2019, 1, 11, 6)})
    row = period.period_bounds(frame).first()
    assert row["year_share"] == pytest.approx(9 / 365)
    assert row["mid_date"] == datetime(2019, 1, 6, 9)


def _compared(spark, rows, sheet=(), names=(("visit", "99203"),), costs=(("CARDIOLOGY", "99203", 1, 10.0),)):
    sheet = decisions(spark, *sheet) if sheet else decisions(spark, {"cpt_code": "none"}).limit(0)
    return period.period_compare(
        _clean(spark, *rows), claims(spark, *costs),
        spark.createDataFrame(list(names), "name string, cpt_code string"), sheet, 3650.0,
    )


def test_group_in_one_half_only(spark):
    rows = [{"date_received": START}, {"date_received": END, "cpt_code": "2"}]
    out = by(_compared(spark, rows, names=[("a", "99203"), ("b", "2")]), "cpt_code")
    early, late = out["99203"], out["2"]
    assert (early["units"], early["units_pre"], early["vol_increase"], early["avg_hcp_cost"]) == (None, 1, None, None)
    assert (early["roi"], early["fin_aa_rec"]) == (None, None) and early["roi_pre"] is not None
    assert (late["units"], late["units_pre"], late["den_rate_increase"]) == (1, None, None)


def test_changes_between_halves(spark):
    rows = [
        {"date_received": START}, {"date_received": START, "status_name": "APPROVED - AUTO"},
        {"date_received": END, "status_name": "DENIED - MD"}, {"date_received": END}, {"date_received": END},
    ]
    row = _compared(spark, rows).first()
    assert (row["units"], row["units_pre"]) == (3, 2)
    assert row["vol_increase"] == pytest.approx(0.5)
    assert row["aa_rate_increase"] == pytest.approx(-0.5)
    # denial rates come from manual lines: 1 of 3 against 0 of 1
    assert row["is_den"] == pytest.approx(1 / 3) and row["is_den_pre"] == 0.0
    # 3650 a year, 10 days, 4 manual lines: 25 a line
    assert row["roi"] == pytest.approx(10.0 / 75.0)


def test_decision_without_volume_stays_and_sorts_last(spark):
    out = period.by_volume(_compared(spark, [{"date_received": START}, {"date_received": END}], [{"cpt_code": "zzz", "decision": 0}])).collect()
    assert [r["cpt_code"] for r in out] == ["99203", "zzz"]
    assert out[1]["units"] is None and out[1]["name"] is None


def test_group_without_name_is_left_out(spark):
    rows = [{"date_received": START, "cpt_code": "x"}, {"date_received": END}]
    assert [r["cpt_code"] for r in _compared(spark, rows).collect()] == ["99203"]


def test_decision_kept_once_per_key(spark):
    sheet = [{"decision_date": date(2019, 1, d), "reason": str(d)} for d in (1, 5, 3)]
    out = _compared(spark, [{"date_received": START}, {"date_received": END}], sheet).collect()
    assert [r["reason"] for r in out] == ["5"]


def test_reason_categories(spark):
    reasons = [None, "Needs Review", "Sub-Spec Addition", "Upcoding", "RNL", "Override Pend"]
    frame = decisions(spark, *[{"reason": r, "cpt_code": str(i)} for i, r in enumerate(reasons)])
    out = by(period.reason_category(frame), "cpt_code")
    assert [out[str(i)]["reason_cat"] for i in range(6)] == ["AA", "0", "0", "M", "do not AA", "AA"]


def test_halves_side_by_side_equal_grouped_halves(spark):
    rows = [{"date_received": d, "cpt_code": c, "status_name": s} for d in (START, END) for c in "ab"
            for s in ("APPROVED - AUTO", "DENIED - MD", "PENDING - CM")]
    grouped = by(period.period_summary(_clean(spark, *rows), 3650.0), "post", "cpt_code")
    wide = by(period.half_profiles(period.period_split(_clean(spark, *rows))), "cpt_code")
    for code in "ab":
        for post, suffix in ((1, ""), (0, "_pre")):
            for column in ("units", "is_autoapp", "units_man", "is_den"):
                assert grouped[(post, code)][column] == pytest.approx(wide[code][column + suffix])
    assert sum(r["cost_to_review"] for r in grouped.values()) == pytest.approx(3650.0 * 10 / 365)


def test_midpoint_does_not_depend_on_the_machines_time_zone(spark, monkeypatch):
    frame = lines(spark, *[{"date_received": datetime(2018, 1, day, hour)} for day, hour in ((1, 0), (1, 12), (1, 18), (2, 0))])
    monkeypatch.setenv("TZ", "America/Los_Angeles")
    time.tzset()
    try:
        rows = period.period_split(frame).select("date_received", "post").collect()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert sorted((r.date_received.day, r.date_received.hour, r.post) for r in rows) == [(1, 0, 0), (1, 12, 1), (1, 18, 1), (2, 0, 1)]
