from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clearlane.sources import warehouse


def _claim_tables(spark, facts):
    def table(rows, columns):
        return spark.createDataFrame(rows, columns)

    return {
        "fact_claim": table(
            facts,
            "vendor_sk int, date_service_from_sk int, patient_sk int, site_market_hierarchy_sk int, "
            "place_of_service_sk int, specialty_sk int, procedure_code_sk int, fund_type_sk int, "
            "hcp_cost double, capitation_flag int",
        ),
        "dim_vendor": table([(1,)], "vendor_sk int"),
        "dim_date": table(
            [(1, datetime(2018, 10, 14)), (2, datetime(2018, 10, 15)), (3, datetime(2019, 10, 15)), (4, datetime(2019, 10, 15, 1))],
            "date_sk int, date_bk timestamp_ntz",
        ),
        "dim_patient": table([(1,)], "patient_sk int"),
        "bridge_site_market_hierarchy": table([(1, 1), (2, 2), (3, 1), (3, 3)], "site_market_hierarchy_sk int, market_sk int"),
        "dim_market": table(
            [(1, "SOUTHERN CALIFORNIA"), (2, "ELSEWHERE"), (3, "SOUTHERN CALIFORNIA")], "market_sk int, super_region_name string"
        ),
        "dim_place_of_service": table([(1,)], "place_of_service_sk int"),
        "dim_specialty": table([(1, "CARDIOLOGY")], "specialty_sk int, specialty_long_name string"),
        "dim_procedure_code": table([(1, "00812")], "procedure_code_sk int, procedure_code string"),
        "dim_fund_type": table([(1, "PROFESSIONAL"), (2, "OTHER")], "fund_type_sk int, fund_type_name string"),
    }


def _fact(vendor=1, day=2, patient=1, site=1, place=1, specialty=1, code=1, fund=1, cost=10.0, cap=0):
    return (vendor, day, patient, site, place, specialty, code, fund, cost, cap)


@pytest.mark.parametrize(
    ("fact", "kept"),
    [
        ({}, 1), ({"day": 1}, 0), ({"day": 3}, 1), ({"day": 4}, 0), ({"vendor": 2}, 0), ({"patient": 2}, 0),
        ({"site": 2}, 0), ({"site": 3}, 2), ({"place": 2}, 0), ({"specialty": 2}, 0), ({"code": 2}, 0),
        ({"fund": 2}, 0), ({"cost": 0.0}, 0), ({"cost": None}, 0), ({"cap": 1}, 0), ({"cap": None}, 0),
    ],
)
def test_eligible_claims(spark, fact, kept):
    assert warehouse.eligible_claims(_claim_tables(spark, [_fact(**fact)])).count() == kept


def test_cost_statistics(spark):
    facts = [_fact(cost=c) for c in (1.0, 2.0, 6.0)]
    row = warehouse.claims_cost_stats(_claim_tables(spark, facts)).first()
    assert (row["cpt_code"], row["cnt_hcp_cost"], row["avg_hcp_cost"]) == ("00812", 3, 3.0)
    assert row["sd_hcp_cost"] == pytest.approx(7**0.5)
    assert warehouse.claims_cost_stats(_claim_tables(spark, facts[:1])).first()["sd_hcp_cost"] is None


def _referral_tables(spark):
    def table(rows, columns):
        return spark.createDataFrame(rows, columns)

    day = datetime(2019, 1, 1)
    header = (
        "referral_key int, hcp_connect_auth_number string, ref_type_key int, ppl string, dt_received timestamp_ntz, "
        "decision_dt timestamp_ntz, referring_prov_key int, specialty_ref_to_provider_key int, elig_key int, "
        "priority_key int, referral_status_key int, patient_plan_key int"
    )
    return {
        "referral_hdr": table(
            [
                (1, "A1", 1, "Y", day, day, 1, 1, 1, 1, 1, 1),
                (2, "A2", 1, "Y", day, day, 1, 1, 2, 1, 1, 1),  # community outside the list
                (3, "A3", 1, "Y", datetime(2020, 1, 1), day, 1, 1, 1, 1, 1, 1),  # outside the window
                (4, "A4", 1, "Y", day, day, 9, 1, 1, 1, 1, 1),  # unknown referring provider
                (5, "A5", 1, "Y", day, day, 1, 1, 1, 9, 1, 1),  # unknown priority
            ],
            header,
        ),
        "referral_det": table(
            [(1, "x", 2.0), (1, "unnamed", 1.0), (2, "x", 1.0), (3, "x", 1.0), (4, "x", 1.0), (5, "x", 1.0)],
            "referral_key int, px_code string, units double",
        ),
        "lu_referring_provider": table([(1,), (1,)], "record_number int"),
        "lu_specialty": table([(1, "CARDIOLOGY")], "record_number int, billing_area string"),
        "lu_eligibility": table([(1, 1), (2, 2)], "elig_key int, hcp_site_key int"),
        "lu_site": table([(1, "South Bay"), (2, "Elsewhere")], "record_number int, budget_community string"),
        "lu_priority": table([(1, "ROUTINE")], "record_number int, name string"),
        "lu_referral_status": table([(1, "APPROVED", "APPROVED - AUTO")], "record_number int, status_type string, name string"),
        "lu_referral_type": table([(1, None)], "ref_type int, referral_type_name string"),
        "lu_benefit_plan": table([(1, "SENIOR")], "patient_plan_key int, product_category_name string"),
        "lu_px_cpt": table([("x", "b" * 40), ("x", "a" * 40)], "procedure_code string, name string"),
    }


def test_referral_lines(spark):
    tables = _referral_tables(spark)
    rows = warehouse.referral_lines(tables).collect()
    assert [(r["auth_number"], r["cpt_code"], r["urgent"], r["ref_type"], r["lob"]) for r in rows] == [
        ("A1", "x", "ROUTINE", None, "SENIOR")
    ]
    without = warehouse.referral_lines(tables, with_priority=False)
    assert sorted(r["auth_number"] for r in without.collect()) == ["A1", "A5"]
    assert "urgent" not in without.columns
    assert warehouse.referral_lines(tables, keep_name_fanout=True).count() == 2


def test_repeated_names_are_counted_not_written_out(spark):
    tables = _referral_tables(spark)
    names = spark.range(10_000).select(F.lit("x").alias("procedure_code"), F.lit(None).cast("string").alias("name"))
    codes = spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), 'a'), ('y', 'b') t(procedure_code, name)")
    tables["lu_px_cpt"] = names.union(codes)
    counted = warehouse.referral_lines(tables, keep_name_fanout=True, copies="k").collect()
    assert [(r["auth_number"], r["cpt_code"], r["k"]) for r in counted] == [("A1", "x", 10_000)]
    plain = warehouse.referral_lines(tables, keep_name_fanout=True)
    assert plain.count() == 10_000 and "k" not in plain.columns
    assert "k" not in warehouse.referral_lines(tables, copies="k").columns


def test_referral_headers(spark):
    rows = warehouse.referral_headers(_referral_tables(spark)).collect()
    assert sorted(r["auth_number"] for r in rows) == ["A1", "A5"]
    assert "cpt_code" not in rows[0].asDict()


def test_code_names(spark):
    assert [tuple(r) for r in warehouse.code_names(_referral_tables(spark)).collect()] == [("a" * 25, "x")]
