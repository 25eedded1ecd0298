"""Extracts from the claim and referral warehouses (star joins).

Tables are passed as a mapping of name to DataFrame. Lookups carry no
broadcast hint: Spark broadcasts a lookup when its measured size is below the
session threshold and shuffles it otherwise. Dimensions that contribute no
column only have to exist, so they are semi-joins, cheapest ones first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane import constants as K

Tables = Mapping[str, DataFrame]
# column of a claim fact that is stored by month
SERVICE_MONTH = "service_month"


def between_days(column: str, window: tuple[str, str]):
    """Closed range; on a timestamp the last day ends at its first instant."""
    return F.col(column).between(
        F.lit(window[0]).cast("timestamp_ntz"), F.lit(window[1]).cast("timestamp_ntz")
    )


def eligible_claims(
    tables: Tables,
    window: tuple[str, str] = K.CLAIM_WINDOW,
    with_month: bool = False,
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Paid, non-capitated professional claims of the super region with the
    specialty and procedure code names, and the service month if wanted. A fact
    that is stored by service month is read for the months of the period only.
    ``months`` (``2019-02``) asks for some months only."""
    fact = tables["fact_claim"].filter((F.col("capitation_flag") == 0) & (F.col("hcp_cost") > 0))
    day = ["date_service_from_sk", *(c for c in fact.columns if c == SERVICE_MONTH)]
    dates = tables["dim_date"].filter(between_days("date_bk", window)).select(
        F.col("date_sk").alias("date_service_from_sk"),
        F.date_format("date_bk", "yyyy-MM").alias(SERVICE_MONTH),
    )
    if months is not None:
        dates = dates.filter(F.col(SERVICE_MONTH).isin(*months))
    dates = dates.select(*dict.fromkeys([*day, *([SERVICE_MONTH] if with_month else [])]))
    funds = tables["dim_fund_type"].filter(F.col("fund_type_name") == K.FUND_TYPE).select("fund_type_sk")
    markets = tables["dim_market"].filter(F.col("super_region_name") == K.SUPER_REGION)
    # one hierarchy key may belong to several markets: inner join keeps that fan-out
    sites = (
        tables["bridge_site_market_hierarchy"]
        .join(markets, "market_sk")
        .select("site_market_hierarchy_sk")
    )
    return (
        fact.join(funds, "fund_type_sk")
        .join(dates, day)
        .join(sites, "site_market_hierarchy_sk")
        .join(tables["dim_place_of_service"], "place_of_service_sk", "left_semi")
        .join(tables["dim_specialty"], "specialty_sk")
        .join(tables["dim_procedure_code"], "procedure_code_sk")
        .join(tables["dim_vendor"], "vendor_sk", "left_semi")
        .join(tables["dim_patient"], "patient_sk", "left_semi")
        .select(
            F.col("specialty_long_name").alias("specialty"),
            F.col("procedure_code").alias("cpt_code"),
            "hcp_cost",
            *([SERVICE_MONTH] if with_month else []),
        )
    )


def claims_cost_stats(tables: Tables, window: tuple[str, str] = K.CLAIM_WINDOW) -> DataFrame:
    """Count, mean and sample standard deviation of cost per (specialty, code)."""
    return (
        eligible_claims(tables, window)
        .groupBy("specialty", "cpt_code")
        .agg(
            F.count("hcp_cost").alias("cnt_hcp_cost"),
            F.avg("hcp_cost").alias("avg_hcp_cost"),
            F.stddev_samp("hcp_cost").alias("sd_hcp_cost"),
        )
    )


def in_report_order(claims: DataFrame) -> DataFrame:
    return claims.orderBy("specialty", "cpt_code")


def code_names(tables: Tables) -> DataFrame:
    """One short name per procedure code: the alphabetically first prefix."""
    return (
        tables["lu_px_cpt"]
        .groupBy(F.col("procedure_code").alias("cpt_code"))
        .agg(F.min(F.substring("name", 1, K.DESCRIPTION_LENGTH)).alias("name"))
        .select("name", "cpt_code")
    )


def resolved_headers(
    tables: Tables,
    window: tuple[str, str],
    communities: Sequence[str],
    with_priority: bool,
) -> DataFrame:
    """Referral headers of a period and set of communities with all lookups
    resolved. Filters run before the join to the detail lines."""
    sites = tables["lu_site"].filter(F.col("budget_community").isin(*communities)).select(
        F.col("record_number").alias("hcp_site_key"), F.col("budget_community").alias("region")
    )
    specialties = tables["lu_specialty"].select(
        F.col("record_number").alias("specialty_ref_to_provider_key"),
        F.col("billing_area").alias("specialty"),
    )
    statuses = tables["lu_referral_status"].select(
        F.col("record_number").alias("referral_status_key"),
        F.col("status_type").alias("status_cat"),
        F.col("name").alias("status_name"),
    )
    types = tables["lu_referral_type"].select(
        F.col("ref_type").alias("ref_type_key"), F.col("referral_type_name").alias("ref_type")
    )
    plans = tables["lu_benefit_plan"].select(
        "patient_plan_key", F.col("product_category_name").alias("lob")
    )
    providers = tables["lu_referring_provider"].select(
        F.col("record_number").alias("referring_prov_key")
    )
    headers = (
        tables["referral_hdr"]
        .filter(between_days("dt_received", window))
        .join(specialties, "specialty_ref_to_provider_key")
        .join(statuses, "referral_status_key")
        .join(types, "ref_type_key")
        .join(plans, "patient_plan_key")
    )
    if with_priority:
        priorities = tables["lu_priority"].select(
            F.col("record_number").alias("priority_key"), F.col("name").alias("urgent")
        )
        headers = headers.join(priorities, "priority_key")
    return (
        # members of the wanted sites, not all members, meet the headers
        headers.join(tables["lu_eligibility"].join(sites, "hcp_site_key"), "elig_key")
        .join(providers, "referring_prov_key", "left_semi")
        .withColumnsRenamed(
            {
                "hcp_connect_auth_number": "auth_number",
                "dt_received": "date_received",
                "decision_dt": "date_decision",
            }
        )
    )


HEADER_COLUMNS = (
    "auth_number", "ref_type_key", "ppl", "date_received", "date_decision", "ref_type",
    "status_cat", "status_name", "specialty", "region",
)


def known_details(tables: Tables, keep_name_fanout: bool = False, copies: str | None = None) -> DataFrame:
    """Detail lines whose code has a name. The column ``copies`` says how often the
    names repeat a line, which is there once then."""
    codes = tables["lu_px_cpt"].select(F.col("procedure_code").alias("px_code"))
    detail = tables["referral_det"].select("referral_key", "px_code", "units")
    if keep_name_fanout and copies is not None:
        return detail.join(codes.groupBy("px_code").agg(F.count(F.lit(1)).alias(copies)), "px_code").select(*detail.columns, copies)
    return detail.join(codes, "px_code", "inner" if keep_name_fanout else "left_semi").select(*detail.columns)


def referral_lines(
    tables: Tables,
    window: tuple[str, str] = K.REFERRAL_WINDOW,
    communities: Sequence[str] = K.COMMUNITIES,
    with_priority: bool = True,
    keep_name_fanout: bool = False,
    copies: str | None = None,
) -> DataFrame:
    """One row per procedure line of a referral.

    A code can have several names in the code lookup. By default the lookup
    only has to contain the code; ``keep_name_fanout`` repeats the line per
    name as a plain inner join does. With a name for ``copies`` it does not write
    the repeated lines out: each is one row, and this column their number. Sums
    over lines then take it as a weight.
    """
    detail = known_details(tables, keep_name_fanout, copies)
    headers = resolved_headers(tables, window, communities, with_priority)
    extra = ["urgent"] if with_priority else []
    weight = [copies] if keep_name_fanout and copies is not None else []
    return detail.join(headers, "referral_key").select(
        F.col("px_code").alias("cpt_code"), *HEADER_COLUMNS, *extra, "units", "lob", *weight
    )


def referral_headers(
    tables: Tables,
    window: tuple[str, str] = K.REFERRAL_WINDOW_HEADER,
    communities: Sequence[str] = K.COMMUNITIES,
) -> DataFrame:
    """One row per referral, without procedure lines and priority."""
    return resolved_headers(tables, window, communities, with_priority=False).select(*HEADER_COLUMNS, "lob")
