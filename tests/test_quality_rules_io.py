from datetime import datetime

import pytest

from clearlane import constants as K
from clearlane import schemas
from clearlane.operators import cleaning, quality, rules
from clearlane.sources import readers, sinks
from tests.fixtures import by, decisions, lines


@pytest.mark.parametrize(("days", "passed"), [(365, True), (360, False), (370, False)])
def test_span_bounds_are_exclusive(spark, days, passed):
    first = datetime(2018, 1, 1)
    last = datetime.fromordinal(first.toordinal() + days)
    frame = lines(spark, {"date_received": first}, {"date_received": last})
    out = by(quality.date_checks(frame, "2019-03-01"), "check")
    assert out["span_days"]["passed"] is passed and out["span_days"]["value"] == days


def test_freshness_and_quarterly_limits(spark):
    frame = lines(spark, {"date_received": datetime(2019, 1, 1)})
    assert by(quality.date_checks(frame, "2019-03-31"), "check")["freshness_days"]["passed"]
    assert not by(quality.date_checks(frame, "2019-04-01"), "check")["freshness_days"]["passed"]
    late = quality.date_checks(frame, "2019-01-21", K.FRESH_DAYS_QUARTERLY, K.SPAN_DAYS_QUARTERLY)
    assert not by(late, "check")["freshness_days"]["passed"]


def test_empty_extract_fails_the_checks(spark):
    out = quality.date_checks(lines(spark, {}).limit(0), "2019-01-01").collect()
    assert [r["passed"] for r in out] == [False, False]


def test_reasons_and_duplicates(spark):
    sheet = decisions(spark, {"reason": None}, {"reason": "RNL"}, {"reason": "typo"}, {"reason": "typo", "cpt_code": "2"})
    assert [r["reason"] for r in quality.unexpected_reasons(sheet).collect()] == ["typo"]
    assert quality.reason_check(sheet).first()["passed"] is False
    assert quality.duplicate_check(sheet).first()["value"] == 1.0
    clean = decisions(spark, {"reason": "RNL"})
    assert quality.reason_check(clean).first()["passed"] is True


@pytest.mark.parametrize(("cost", "passed"), [(95.0, False), (95.1, True), (104.9, True), (105.0, False), (None, False)])
def test_review_cost_tolerance(spark, cost, passed):
    frame = spark.createDataFrame([(cost, 1.0, 5)], "cost_to_review double, roi double, units_man bigint")
    assert by(quality.cost_checks(frame, 100.0), "check")["review_cost"]["passed"] is passed


def _rules(spark, pairs, **options):
    allowed = spark.createDataFrame(pairs, "specialty string, cpt_code string")
    return rules.rule_table(allowed, "someone", "2019-06-14", **options)


def test_rules_by_line_of_business(spark):
    pairs = [("RADIOLOGY_senior", "2"), ("RADIOLOGY_senior", "1"), ("RADIOLOGY_not_sen", "1"), ("HAND CLINIC", "1")]
    out = by(_rules(spark, pairs, extra={}), "rule_code")
    senior, other = out["RADIOLOGY_senior_PPL"], out["RADIOLOGY_not_sen_PPL"]
    assert senior["lob_list"] == "SENIOR" and other["lob_list"] == "All"
    assert senior["refto_spc_list"] == other["refto_spc_list"] == K.UMBRELLA_SPECIALTIES["RADIOLOGY"]
    assert senior["px_list"] == ["1", "2"]
    assert out["HANDCLINIC_PPL"]["refto_spc_list"] == "HAND CLINIC"
    assert sorted(r["rule_key"] for r in out.values()) == [1, 2, 3]
    assert senior["rule_desc"].startswith("auto-approve RADIOLOGY_senior referrals")


def test_only_specialties_with_codes_and_the_extra_ones(spark):
    out = by(_rules(spark, [("CARDIOLOGY", "1"), (K.EXTRA_SPECIALTY, "old")]), "rule_desc")
    assert len(out) == 3
    extra = next(r for r in out.values() if r["refto_spc_list"] == K.EXTRA_SPECIALTY)
    assert extra["px_list"] == list(K.EXTRA_SPECIALTY_CODES)
    assert {r["term_date"] for r in out.values()} == {None}


def test_rules_without_region_column(spark):
    assert "region_list" not in _rules(spark, [("A", "1")], with_region=False).columns


def test_delimited_round_trip_keeps_leading_zeros(spark, tmp_path):
    frame = lines(spark, {"cpt_code": "00812", "ppl": None})
    path = str(tmp_path / "lines")
    assert sinks.write_delimited(frame, path) is True
    again = readers.read_delimited(spark, path, schemas.REFERRAL_LINE, sep="|")
    assert again.collect() == frame.collect()


def test_saved_index_column_is_dropped(spark, tmp_path):
    path = tmp_path / "saved.csv"
    path.write_text("|cpt_code|name\n0|00812|abc\n", encoding="utf-8")
    frame = readers.read_delimited(
        spark, str(path), schemas._struct("cpt_code string, name string"), sep="|", saved_index=True
    )
    assert [tuple(r) for r in frame.collect()] == [("00812", "abc")]


def test_existing_target_is_left_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.write_table(spark.range(3), path) is True
    assert sinks.write_table(spark.range(9), path) is False
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="exist"):
        sinks.write_table(spark.range(9), path, fail_if_exists=True)


def test_report_uses_business_names_and_two_decimals(spark, tmp_path):
    frame = spark.createDataFrame([("A", "1", 1, 0.126)], "specialty string, cpt_code string, is_ppl int, new_rate double")
    path = str(tmp_path / "rates")
    assert sinks.write_report(frame, path, K.CODE_RATE_HEADER)
    read = spark.read.option("header", True).csv(path)
    assert read.columns == ["Specialty", "CPT Code", "PPL?", "new rate"]
    assert read.first()["new rate"] == "0.13"


def test_list_cells_become_text(spark, tmp_path):
    path = str(tmp_path / "rules")
    assert sinks.write_delimited(_rules(spark, [("A", "1"), ("A", "2")], extra={}), path)
    assert spark.read.option("header", True).option("sep", "|").csv(path).first()["px_list"] == "1,2"


def test_sql_file_runs_on_given_tables(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT cpt_code\n FROM lines\n WHERE specialty = :wanted", encoding="utf-8")
    frame = lines(spark, {}, {"specialty": "X", "cpt_code": "7"})
    out = readers.run_sql_file(spark, str(path), {"lines": frame}, wanted="X")
    assert [r[0] for r in out.collect()] == ["7"]


def test_dates_given_as_text(spark):
    frame = spark.createDataFrame([("2019-05-01 10:00:00", None)], "date_received string, date_decision string")
    assert cleaning.parse_dates(frame).first()["date_received"] == datetime(2019, 5, 1, 10)


def test_delimited_text_is_read_by_name(spark, tmp_path):
    (tmp_path / "f.txt").write_text("Unnamed: 0|name|units|cpt_code\n0|x ray|2.5|0071\n1|visit||99213\n")
    schema = schemas._struct("cpt_code string, name string, units double")
    rows = readers.read_delimited(spark, str(tmp_path / "f.txt"), schema, sep="|", saved_index=True).collect()
    assert sorted(map(tuple, rows)) == [("0071", "x ray", 2.5), ("99213", "visit", None)]


def test_bad_cells_and_missing_columns_are_errors(spark, tmp_path):
    (tmp_path / "f.csv").write_text("cpt_code,units\n1,abc\n")
    with pytest.raises(Exception, match="column units, not double: abc"):
        readers.read_delimited(spark, str(tmp_path / "f.csv"), schemas._struct("cpt_code string, units double")).collect()
    with pytest.raises(ValueError, match="no column name"):
        readers.read_delimited(spark, str(tmp_path / "f.csv"), schemas._struct("name string"))


def test_sql_file_leaves_no_view(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM probe_lines WHERE id >= :least")
    assert readers.run_sql_file(spark, str(tmp_path / "q.sql"), {"probe_lines": spark.range(9)}, least=4).first().n == 5
    assert not spark.catalog.tableExists("probe_lines")
