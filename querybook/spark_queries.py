"""One entry per operator, each over the whole given tables.

Results that are sums of fractions depend on the order of addition in the last
digits, so such columns are rounded for comparison. A small shift moves exact
halves off the rounding boundary, where the last digit would decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane import schemas
from clearlane.operators import (
    approval,
    cleaning,
    costing,
    crosstab,
    evaluation,
    monthly,
    overrides,
    period,
    quality,
    rules,
    summary,
)
from clearlane.operators.staging import new_folder, stage, stage_table
from clearlane.plans.decisions import Decisions, analyse, decide
from clearlane.sources import readers, sinks, stores, warehouse
from querybook import sample as S
from querybook.sample import once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Book(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    shift = 0.123 * 10**-digits
    return df.withColumns({c: F.round(F.col(c) + shift, digits) for c in columns})


def amounts(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df, 4, *columns)


def totals(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df, 2, *columns)


def rates(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df, 6, *columns)


UNUSED_AFTER_CLEANING = ("ref_type_key", "ppl", "date_decision", "status_cat", "lob")


class Book(S.Sample):
    """Steps that several queries share."""

    def lines(self, window=S.REFERRAL_WINDOW, with_priority: bool = True) -> DataFrame:
        return warehouse.referral_lines(self.referral_tables(), window, with_priority=with_priority)

    def claims(self, window=S.CLAIM_WINDOW) -> DataFrame:
        return warehouse.claims_cost_stats(self.claim_tables(), window)

    def names(self) -> DataFrame:
        return warehouse.code_names(self.referral_tables())

    def clean(self, rules_=cleaning.RULES_C, window=S.REFERRAL_WINDOW) -> DataFrame:
        return cleaning.clean_referrals(self.lines(window), rules_)

    @once
    def stored(self, rules_=cleaning.RULES_C, window=S.REFERRAL_WINDOW) -> DataFrame:
        """Cleaned lines for queries that pass over them more than once, with
        the columns these queries use."""
        return stage_table(self.clean(rules_, window).drop(*UNUSED_AFTER_CLEANING))

    @once
    def master(self) -> DataFrame:
        """The decision sheet as a stored table, as it is in practice."""
        return stage(super().master())

    def analysed(self) -> Decisions:
        return analyse(self.clean(), self.claims(), S.DEPARTMENT_COST)

    def started(self) -> DataFrame:
        return overrides.start_decisions(self.analysed().table)

    def plan(self, plan, sheets, lines: DataFrame, **options) -> Decisions:
        options = {"department_cost": S.DEPARTMENT_COST, **options}
        return decide(lines, self.claims(), plan, sheets, **options)

    def plan_c(self, lines: DataFrame | None = None) -> Decisions:
        return self.plan(overrides.PLAN_C, {"master": self.master()}, lines or self.clean())

    @once
    def scored(self) -> DataFrame:
        lines = self.stored()
        return approval.assign_status(lines, approval.allow_list(self.plan_c(lines).table))

    def predictions_prepared(self) -> DataFrame:
        return evaluation.prepare_predictions(self.predictions())

    @once
    def evaluated(self) -> DataFrame:
        """Candidates are read for the quantile edges and again for the rest."""
        candidates = stage_table(self.predictions_prepared().drop("ref_to_status", "dt_prediction"))
        return evaluation.with_decisions(evaluation.confidence_decile(candidates), self.master())

    @once
    def costs(self) -> DataFrame:
        return evaluation.referral_cost(self.lines(), self.master())

    @once
    def cells(self) -> DataFrame:
        return evaluation.evaluation_cells(self.evaluated(), self.costs())


    # --- stored extracts ---------------------------------------------------------

    @once
    def lines_path(self) -> str:
        """All lines of the warehouse's period, stored by month."""
        path = new_folder(self.spark)
        stores.write_referral_lines(self.lines(), path)
        return path

    @once
    def referrals_path(self) -> str:
        """Headers and details in the same buckets."""
        path = new_folder(self.spark)
        stores.write_referrals(self.referral_tables(), path, S.BUCKETS, S.REFERRAL_WINDOW)
        return path

    @once
    def stored_claims(self) -> dict[str, DataFrame]:
        """The claim warehouse with its fact stored by service month."""
        tables = self.claim_tables()
        path = new_folder(self.spark)
        stores.write_claims(tables["fact_claim"], tables["dim_date"], path)
        return {**tables, "fact_claim": stores.read_claims(self.spark, path, tables["fact_claim"].schema)}


DECISION_ROUND = ("avg_hcp_cost", "cost_to_review", "sum_cost_denied", "roi")


def _decision_table(table: DataFrame) -> DataFrame:
    return amounts(table.drop("cnt_hcp_cost"), *DECISION_ROUND)


# --- extracts -----------------------------------------------------------------------


@query
def claims_cost_stats(b: Book) -> DataFrame:
    return amounts(warehouse.in_report_order(b.claims()), "sd_hcp_cost")


@query
def claims_cost_stats_quarterly(b: Book) -> DataFrame:
    return amounts(b.claims(S.CLAIM_WINDOW_QUARTERLY), "sd_hcp_cost")


@query
def claim_dimension_semi(b: Book) -> DataFrame:
    return warehouse.eligible_claims(b.claim_tables(), S.CLAIM_WINDOW)


@query
def cpt_short_name(b: Book) -> DataFrame:
    return b.names()


@query
def referral_extract(b: Book) -> DataFrame:
    return b.lines()


@query
def referral_extract_new(b: Book) -> DataFrame:
    return b.lines(S.NEW_WINDOW, with_priority=False)


@query
def referral_name_fanout(b: Book) -> DataFrame:
    """Lines repeated for every name of their code, as a plain join does."""
    lines = warehouse.referral_lines(b.referral_tables(), S.REFERRAL_WINDOW, keep_name_fanout=True, copies="k")
    n = F.coalesce(F.sum("k"), F.lit(0))  # a group has a line; the type of a count
    return lines.groupBy("cpt_code", "specialty").agg(n.alias("n"), F.sum(F.col("units") * F.col("k")).alias("units"))


@query
def referral_header_extract(b: Book) -> DataFrame:
    return warehouse.referral_headers(b.referral_tables(), S.REFERRAL_WINDOW)


# --- stored extracts and text files ---------------------------------------------------


@query
def referral_extract_stored(b: Book) -> DataFrame:
    """The lines of a quarter from the stored ones, reading its months only."""
    return stores.read_referral_lines(b.spark, b.lines_path(), S.REFERRAL_WINDOW_QUARTERLY)


@query
def referral_extract_bucketed(b: Book) -> DataFrame:
    """Headers and details that lie in the same buckets, joined without a shuffle."""
    return stores.read_referrals(b.spark, b.referrals_path(), S.REFERRAL_WINDOW, K.COMMUNITIES)


@query
def claims_cost_stats_stored(b: Book) -> DataFrame:
    """The quarterly window on claims stored by service month."""
    return amounts(warehouse.claims_cost_stats(b.stored_claims(), S.CLAIM_WINDOW_QUARTERLY), "sd_hcp_cost")


@query
def claims_cost_stats_monthly(b: Book) -> DataFrame:
    """Monthly states merged; the window's last month is read from the claims."""
    path = new_folder(b.spark)
    monthly.add_claim_months(b.stored_claims(), path, S.CLAIM_WINDOW)
    return amounts(monthly.claim_cost_stats(b.stored_claims(), path, S.CLAIM_WINDOW), "sd_hcp_cost")


@query
def code_summary_monthly(b: Book) -> DataFrame:
    """Monthly states, built in two steps, and the first and last month's lines."""
    path = new_folder(b.spark)
    for window in (S.OLD_WINDOW, S.REFERRAL_WINDOW):
        monthly.add_line_months(b.spark, b.lines_path(), path, window, cleaning.RULES_C)
    profile = monthly.line_profile(b.spark, b.lines_path(), path, S.PART_WINDOW, cleaning.RULES_C)
    return costing.known_groups(profile)


@query
def text_lines_pipe(b: Book) -> DataFrame:
    """Lines written with ``|`` and read again by their header."""
    path = new_folder(b.spark)
    sinks.write_delimited(b.lines(), path)
    return readers.read_delimited(b.spark, path, schemas.REFERRAL_LINE, sep="|")


@query
def text_claims_comma(b: Book) -> DataFrame:
    path = new_folder(b.spark)
    sinks.write_delimited(b.claims(), path, sep=",")
    return amounts(readers.read_delimited(b.spark, path, schemas.CLAIM_COST), "sd_hcp_cost")


@query
def text_saved_index(b: Book) -> DataFrame:
    """A file with a column of row numbers, as saved data frames have it."""
    path = new_folder(b.spark)
    numbered = b.names().select(F.lit(0).alias(readers.SAVED_INDEX), "name", "cpt_code")
    sinks.write_delimited(numbered, path, sep=",")
    return readers.read_delimited(b.spark, path, schemas.CODE_NAME, saved_index=True)


@query
def text_dates(b: Book) -> DataFrame:
    """Dates that arrive as text."""
    as_text = b.lines().select(
        "cpt_code", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("date_received", "date_decision")]
    )
    parsed = cleaning.parse_dates(as_text)
    return parsed.groupBy("cpt_code").agg(F.min("date_received").alias("oldest"), F.max("date_decision").alias("newest"), F.count("date_decision").alias("decided"))


@query
def table_round_trip(b: Book) -> DataFrame:
    """The header extract as a plain table, refused a second time."""
    path = new_folder(b.spark)
    headers = warehouse.referral_headers(b.referral_tables(), S.REFERRAL_WINDOW)
    sinks.write_table(headers, path)
    if sinks.write_table(headers.limit(0), path):
        raise AssertionError("a table was replaced")
    return readers.read_table(b.spark, path, schemas.REFERRAL_HEADER)


def _scanned(b: Book) -> readers.Scan:
    """Line items as text in which every seventh line has no number of units, and
    returned ones no date."""
    path = new_folder(b.spark)
    units = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string"))
    day = F.when(F.col("l_returnflag") == "R", "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    items = b.raw("lineitem").select(F.col("l_orderkey").cast("string").alias("auth_number"), day.alias("decision_date"), units.alias("units"))
    sinks.write_delimited(items, path)
    return readers.scan_delimited(b.spark, path, schemas._struct("auth_number string, decision_date date, units double"), sep="|")


@query
def text_scan_good(b: Book) -> DataFrame:
    return _scanned(b).good.groupBy("decision_date").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))


@query
def text_scan_rejected(b: Book) -> DataFrame:
    return _scanned(b).rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- cleaning -------------------------------------------------------------------------


@query
def clean_referrals(b: Book) -> DataFrame:
    return b.clean()


@query
def lob_specialty_split(b: Book) -> DataFrame:
    split = cleaning.split_specialties(b.lines())
    return split.groupBy("specialty", "lob").agg(F.count(F.lit(1)).alias("n"))


@query
def first_line_per_referral(b: Book) -> DataFrame:
    return cleaning.first_line_per_referral(b.lines())


@query
def specialty_union(b: Book) -> DataFrame:
    old, new = b.clean(window=S.OLD_WINDOW), b.clean(window=S.NEW_WINDOW)
    return cleaning.all_specialties(old, new, extra=(K.EXTRA_SPECIALTY,))


@query
def missing_lob(b: Book) -> DataFrame:
    return cleaning.missing_count(b.lines(), "lob")


@query
def one_region(b: Book) -> DataFrame:
    kept = cleaning.in_region(b.clean(), "SAN GABRIEL VALLEY")
    return kept.groupBy("region", "specialty").agg(F.count("units").alias("units"))


@query
def note_cleanup(b: Book) -> DataFrame:
    notes = b.decision_log().withColumnRenamed("reason", "notes")
    return cleaning.normalise_notes(notes).groupBy("notes").agg(F.count(F.lit(1)).alias("n"))


# --- cost and return ----------------------------------------------------------------------


@query
def cost_by_code(b: Book) -> DataFrame:
    return amounts(costing.cost_by_code(b.claims()), "avg_hcp_cost_code")


@query
def manual_volume(b: Book) -> DataFrame:
    return costing.manual_volume(b.clean())


@query
def code_summary(b: Book) -> DataFrame:
    return costing.code_summary(b.clean())


@query
def code_cost_fallback(b: Book) -> DataFrame:
    return amounts(costing.code_cost(costing.code_summary(b.clean()), b.claims()), "avg_hcp_cost")


@query
def review_unit_cost(b: Book) -> DataFrame:
    return amounts(costing.review_unit_cost(b.clean(), S.DEPARTMENT_COST), "unit_cost")


@query
def review_roi(b: Book) -> DataFrame:
    return amounts(b.analysed().table, *DECISION_ROUND)


@query
def unmatched_counts(b: Book) -> DataFrame:
    return costing.unmatched_counts(b.analysed().table)


# --- overrides ----------------------------------------------------------------------------


@query
def override_codes(b: Book) -> DataFrame:
    out = overrides.override_codes(b.started(), K.DERMATOLOGY_CODES, ("DERMATOLOGY",), 1)
    out = overrides.override_codes(out, K.CODES_TO_PEND, None, 0, is_ppl=1)
    return _decision_table(out)


@query
def override_specialties(b: Book) -> DataFrame:
    return _decision_table(
        overrides.override_specialties(
            b.started(), K.SOFT_PEND_SPECIALTIES, K.REASON_SOFT_PEND, K.SOURCE_CLINICAL
        )
    )


@query
def overlay_decisions(b: Book) -> DataFrame:
    return _decision_table(overrides.overlay_decisions(b.started(), b.master()))


@query
def override_low_volume(b: Book) -> DataFrame:
    return _decision_table(overrides.override_low_volume(b.started()))


@query
def override_out_of_network(b: Book) -> DataFrame:
    return _decision_table(overrides.override_out_of_network(b.started()))


@query
def latest_decisions(b: Book) -> DataFrame:
    return overrides.latest_decisions(b.master())


@query
def duplicate_decisions(b: Book) -> DataFrame:
    return overrides.duplicate_decisions(b.master())


@query
def decision_plan_a(b: Book) -> DataFrame:
    sheets = {f"sheet_{i}": b.sheet(1995 + i) for i in range(1, 5)}
    return _decision_table(b.plan(overrides.PLAN_A, sheets, b.clean(cleaning.RULES_A), unit_cost=10_000.0).table)


@query
def decision_plan_a_unit_cost(b: Book) -> DataFrame:
    """Plan A with the constant cost of a reviewed line."""
    sheets = {f"sheet_{i}": b.sheet(1995 + i) for i in range(1, 5)}
    lines = b.clean(cleaning.RULES_A)
    return _decision_table(b.plan(overrides.PLAN_A, sheets, lines, unit_cost=K.UNIT_COST_OVERRIDE).table)


@query
def decision_plan_b(b: Book) -> DataFrame:
    return _decision_table(b.plan(overrides.PLAN_B, {"sheet": b.sheet(2000)}, b.clean()).table)


@query
def decision_plan_c(b: Book) -> DataFrame:
    return _decision_table(b.plan_c().table)


@query
def decision_plan_m(b: Book) -> DataFrame:
    return _decision_table(b.plan(overrides.PLAN_M, {"master": b.master()}, b.clean(cleaning.RULES_M)).table)


@query
def decision_counts(b: Book) -> DataFrame:
    return crosstab.decision_counts(b.plan_c().table)


# --- allow-list and referrals -----------------------------------------------------------------


@query
def allow_list(b: Book) -> DataFrame:
    return approval.allow_list(b.plan_c().table)


@query
def allow_list_counts(b: Book) -> DataFrame:
    decisions = b.plan_c().table
    specialties = cleaning.all_specialties(decisions, extra=(K.EXTRA_SPECIALTY,))
    return approval.allow_list_counts(approval.allow_list(decisions), specialties)


@query
def assign_status(b: Book) -> DataFrame:
    return b.scored().select(
        "auth_number", "specialty", "cpt_code", "is_ppl", "ref_type", "auto_approvable"
    )


@query
def referral_decision(b: Book) -> DataFrame:
    return approval.referral_decision(b.scored()).drop("lines")


@query
def attach_referral_decision(b: Book) -> DataFrame:
    return approval.attach_referral_decision(b.scored()).select(
        "auth_number", "specialty", "cpt_code", "auto_approvable", "aa_yn"
    )


@query
def predicted_rate(b: Book) -> DataFrame:
    return rates(
        approval.predicted_rate(approval.referral_decision(b.scored()), K.RATE_HAIRCUT),
        "predicted_rate",
    )


@query
def false_positives(b: Book) -> DataFrame:
    return approval.false_positives(b.scored()).select(
        "auth_number", "specialty", "cpt_code", "date_received", "status_name", "is_den", "aa_yn"
    )


@query
def referral_lookup(b: Book) -> DataFrame:
    found = approval.referral_lookup(b.clean(), specialty="ENT-OTOLARYNGOLOGY", cpt_code="95024")
    return found.select("auth_number", "specialty", "cpt_code", "status_name", "date_received")


@query
def spot_check(b: Book) -> DataFrame:
    lines = approval.referral_lookup(b.clean(), specialty="CARDIOLOGY", is_ppl=1)
    order = ["date_received", "auth_number", "cpt_code", "units", "status_name"]
    return approval.last_rows(lines.filter(F.col("auth_number").isNotNull()), order).select(*order)


# --- reports ------------------------------------------------------------------------------------


@query
def referral_rollup(b: Book) -> DataFrame:
    return summary.referral_rollup(b.scored())


@query
def referral_rollup_region(b: Book) -> DataFrame:
    return summary.referral_rollup(b.scored(), with_region=True)


@query
def specialty_rates(b: Book) -> DataFrame:
    return rates(
        summary.specialty_rates(summary.referral_rollup(b.scored())), "new_rate", "old_rate"
    )


@query
def denied_now_approved(b: Book) -> DataFrame:
    return totals(
        summary.denied_now_approved(summary.referral_rollup(b.scored())), "deny_now_aa"
    )


@query
def line_financials(b: Book) -> DataFrame:
    decisions = b.plan_c(b.stored())
    lines = summary.scored_line_financials(b.stored(), decisions.table, decisions.unit_cost)
    kept = lines.select("auth_number", "specialty", "cpt_code", "is_ppl", "aa_yn", *summary.DOLLARS)
    return amounts(kept, *summary.DOLLARS)


@query
def specialty_financials(b: Book) -> DataFrame:
    decisions = b.plan_c(b.stored())
    lines = summary.scored_line_financials(b.stored(), decisions.table, decisions.unit_cost)
    return totals(summary.specialty_financials(lines), *summary.DOLLARS)


SUMMARY_AMOUNTS = (*summary.DOLLARS, "deny_now_aa", "net_benefit", "net_benefit_w_new_den")


def _summary(b: Book) -> DataFrame:
    decisions = b.plan_c(b.stored())
    return summary.specialty_summary(b.stored(), decisions.table, decisions.unit_cost, staged=True)


@query
def specialty_summary(b: Book) -> DataFrame:
    return totals(rates(_summary(b), "new_rate", "old_rate"), *SUMMARY_AMOUNTS)


@query
def specialty_report(b: Book) -> DataFrame:
    return sinks.report(_summary(b), K.SPECIALTY_SUMMARY_HEADER)


@query
def new_period_summary(b: Book) -> DataFrame:
    """Rules learned on the older referrals, applied to the newer ones."""
    sheets = {f"sheet_{i}": b.sheet(1995 + i) for i in range(1, 5)}
    old = cleaning.clean_referrals(b.lines(S.OLD_WINDOW), cleaning.RULES_A)
    new = cleaning.clean_referrals(
        b.lines(S.NEW_WINDOW, with_priority=False), cleaning.RULES_A_NEW
    )
    decisions = decide(old, b.claims(), overrides.PLAN_A, sheets, unit_cost=10_000.0)
    report = summary.specialty_summary(
        new, decisions.table, decisions.unit_cost, with_region=True, staged=True
    )
    return totals(rates(report, "new_rate", "old_rate"), *SUMMARY_AMOUNTS)


@query
def projected_code_rate(b: Book) -> DataFrame:
    return summary.projected_code_rate(b.scored())


def _code_detail(b: Book) -> DataFrame:
    decisions = b.plan_c(b.stored()).table
    scored = approval.score_lines(b.stored(), decisions, staged=True)
    return summary.code_detail(decisions, summary.projected_code_rate(scored), b.names())


@query
def code_detail(b: Book) -> DataFrame:
    return amounts(_code_detail(b), *DECISION_ROUND)


@query
def code_rate_report(b: Book) -> DataFrame:
    return sinks.report(summary.projected_code_rate(b.scored()), K.CODE_RATE_HEADER, 4)


@query
def code_detail_report(b: Book) -> DataFrame:
    rounded_ = rates(amounts(_code_detail(b), *DECISION_ROUND), "auto_rate", "denial_rate", "new_rate")
    return sinks.report(rounded_, K.CODE_DETAIL_HEADER, 6)


# --- cross-tabulations ---------------------------------------------------------------------------


@query
def xtab_auto_denied(b: Book) -> DataFrame:
    return crosstab.auto_by_denied(b.clean())


@query
def xtab_manual_denied(b: Book) -> DataFrame:
    return crosstab.auto_by_denied(b.clean().filter(F.col("is_autoapp") == 0))


@query
def xtab_referral(b: Book) -> DataFrame:
    return crosstab.referrals_by_decision(approval.referral_decision(b.scored()))


@query
def xtab_auto_denied_by_new(b: Book) -> DataFrame:
    return crosstab.old_by_new(b.scored())


@query
def xtab_lines(b: Book) -> DataFrame:
    return crosstab.lines_by_decision(b.scored())


@query
def xtab_urgent(b: Book) -> DataFrame:
    return crosstab.lines_by_priority(b.scored())


# --- halves of a period -----------------------------------------------------------------------------


@query
def period_split(b: Book) -> DataFrame:
    return period.period_split(b.stored()).select("auth_number", "cpt_code", "date_received", "post")


@query
def period_bounds(b: Book) -> DataFrame:
    return period.period_bounds(b.clean())


@query
def period_summary(b: Book) -> DataFrame:
    return amounts(period.period_summary(b.stored(), S.DEPARTMENT_COST), "cost_to_review")


def _comparison(b: Book, window=S.REFERRAL_WINDOW, claims=S.CLAIM_WINDOW) -> DataFrame:
    lines = b.stored() if window == S.REFERRAL_WINDOW else stage_table(b.clean(window=window))
    return period.period_compare(lines, b.claims(claims), b.names(), b.master(), S.DEPARTMENT_COST)


@query
def period_compare(b: Book) -> DataFrame:
    return amounts(period.by_volume(_comparison(b)), "avg_hcp_cost", "roi", "roi_pre")


def _quarter(b: Book) -> DataFrame:
    return b.clean(window=S.REFERRAL_WINDOW_QUARTERLY)


@query
def period_bounds_quarterly(b: Book) -> DataFrame:
    return period.period_bounds(_quarter(b))


@query
def period_split_quarterly(b: Book) -> DataFrame:
    split = period.period_split(stage_table(_quarter(b)))
    return split.select("auth_number", "cpt_code", "date_received", "post")


@query
def period_summary_quarterly(b: Book) -> DataFrame:
    return amounts(period.period_summary(stage_table(_quarter(b)), S.DEPARTMENT_COST), "cost_to_review")


@query
def period_compare_quarterly(b: Book) -> DataFrame:
    compared = _comparison(b, S.REFERRAL_WINDOW_QUARTERLY, S.CLAIM_WINDOW_QUARTERLY)
    return amounts(compared, "avg_hcp_cost", "roi", "roi_pre")


@query
def high_volume_groups(b: Book) -> DataFrame:
    return period.high_volume(_comparison(b), above=40).select(
        "specialty", "cpt_code", "is_ppl", "units", "units_pre", "vol_increase"
    )


@query
def reason_category(b: Book) -> DataFrame:
    categorised = period.reason_category(b.master())
    return categorised.groupBy("reason", "reason_cat").agg(F.count(F.lit(1)).alias("n"))


# --- model evaluation ---------------------------------------------------------------------------------


@query
def predictions_prepared(b: Book) -> DataFrame:
    return b.predictions_prepared().select(
        "referral_ident", "ref_to_status", "is_ppl", "ref_to_specialty", "px_code", "is_approved"
    )


@query
def confidence_decile(b: Book) -> DataFrame:
    candidates = stage_table(b.predictions_prepared().select("referral_ident", "px_code", "confidence"))
    return evaluation.confidence_decile(candidates)


@query
def confidence_decile_monthly(b: Book) -> DataFrame:
    """Brackets from sketches of the months, which are kept."""
    columns = ("referral_ident", "px_code", "confidence", "dt_prediction")
    candidates = stage_table(b.predictions_prepared().select(*columns))
    kept = stage(evaluation.confidence_sketches(candidates))
    return evaluation.confidence_decile(candidates, sketches=kept).drop("dt_prediction")


@query
def referral_cost(b: Book) -> DataFrame:
    return b.costs()


@query
def false_positive_dollars(b: Book) -> DataFrame:
    evaluated = evaluation.false_positive_dollars(b.evaluated(), b.costs())
    return evaluated.select(
        "referral_ident", "px_code", "decile", "decision", "reason", "is_approved", "avg_cost",
        "false_positive_dollars",
    )


@query
def decile_report(b: Book) -> DataFrame:
    return evaluation.decile_report(b.cells())


@query
def decile_status(b: Book) -> DataFrame:
    return evaluation.decile_status(b.cells())


@query
def decision_reason_xtab(b: Book) -> DataFrame:
    return evaluation.decision_reason_crosstab(stage(b.cells()))


@query
def status_frequency(b: Book) -> DataFrame:
    return evaluation.rejected_status_frequency(b.cells())


@query
def rejection_rate(b: Book) -> DataFrame:
    return evaluation.rejection_rate(b.predictions_prepared())


@query
def unmatched_candidates(b: Book) -> DataFrame:
    return evaluation.unmatched_candidates(
        evaluation.with_decisions(b.predictions_prepared(), b.master())
    )


@query
def candidate_lookup(b: Book) -> DataFrame:
    found = approval.referral_lookup(
        b.evaluated(), decile=9, ref_to_specialty="SURGERY - VASCULAR", reason="DBA"
    )
    return found.select("referral_ident", "px_code", "decile", "confidence", "decision")


# --- checks and rules -----------------------------------------------------------------------------------


@query
def unexpected_reasons(b: Book) -> DataFrame:
    return quality.unexpected_reasons(b.master())


def _checks(b: Book, window, claims, as_of: str, fresh_days: int, span_days: tuple[int, int]) -> DataFrame:
    """The extract and the analysed groups are watched while they are stored."""
    watched, seen_lines = quality.watch_lines(b.lines(window))
    lines = stage_table(watched)
    analysed = analyse(cleaning.clean_referrals(lines, cleaning.RULES_C), b.claims(claims), S.DEPARTMENT_COST)
    groups, seen_groups = quality.watch_decisions(analysed.table)
    stage_table(groups)
    checks = quality.written_checks(seen_lines, seen_groups, b.master(), as_of, S.DEPARTMENT_COST, fresh_days, span_days)
    return totals(checks, "value", "lo", "hi")


@query
def quality_checks_scanned(b: Book) -> DataFrame:
    """The same checks of an extract and groups that are already there."""
    lines = stage_table(b.lines())
    table = stage_table(analyse(cleaning.clean_referrals(lines, cleaning.RULES_C), b.claims(), S.DEPARTMENT_COST).table)
    return totals(quality.quality_checks(lines, table, b.master(), S.AS_OF, S.DEPARTMENT_COST), "value", "lo", "hi")


@query
def missing_lob_seen(b: Book) -> DataFrame:
    watched, seen = quality.watch_lines(b.lines())
    stores.write_referral_lines(watched, new_folder(b.spark))
    return quality.missing_lob_seen(b.spark, seen)


@query
def quality_checks(b: Book) -> DataFrame:
    return _checks(b, S.REFERRAL_WINDOW, S.CLAIM_WINDOW, S.AS_OF, K.FRESH_DAYS, K.SPAN_DAYS)


@query
def quality_checks_quarterly(b: Book) -> DataFrame:
    return _checks(
        b, S.REFERRAL_WINDOW_QUARTERLY, S.CLAIM_WINDOW_QUARTERLY, S.AS_OF_QUARTERLY,
        K.FRESH_DAYS_QUARTERLY, K.SPAN_DAYS_QUARTERLY,
    )


@query
def rule_table(b: Book) -> DataFrame:
    table = rules.rule_table(approval.allow_list(b.plan_c().table), "analytics", "2019-06-14")
    return table.withColumn("px_list", F.array_join("px_list", ","))
