"""Reports per specialty and per code.

The specialty report needs the referral decision on every line, but only sums
per specialty in the end. Lines are therefore summed to (referral, specialty,
type) first. That is one shuffle with map-side combining, and it leaves at
most a few rows per referral, so a referral number shared by a third of all
lines is harmless in the per-referral step that follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane.operators.approval import allow_list, attach_referral_decision, score_lines
from clearlane.operators.costing import GROUP

ROLLUP = ("specialty", "ref_type", "auth_number")
DOLLARS = (
    "dollars_denied_now_app",
    "cost_to_review_bene",
    "cost_to_review_loss",
    "new_denial_bene_est",
)


def _referral_parts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums per ``keys`` with the decision of the whole referral. Works on any
    number of lines per referral: only the sums meet in the window."""
    auto, den = F.col("is_autoapp"), F.col("is_den")
    sums = {
        "units": F.count("units"),
        "lines": F.count(F.lit(1)),
        "auto": F.sum("is_autoapp"),
        "ppl": F.sum("is_ppl"),
        "app": F.sum("is_app"),
        "den": F.sum("is_den"),
        "__least": F.min("auto_approvable"),
    }
    if "avg_hcp_cost" in scored.columns:
        sums["den_cost"] = F.sum(den * F.col("avg_hcp_cost"))
        sums["auto_roi"] = F.sum(auto * F.col("roi") * F.col("is_ppl"))
    parts = scored.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    whole = Window.partitionBy("auth_number")
    return parts.withColumn(
        "aa_yn", F.when(F.col("auth_number").isNotNull(), F.min("__least").over(whole))
    ).drop("__least")


def _complete(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def referral_rollup(scored: DataFrame, with_region: bool = False) -> DataFrame:
    """Volume and rates per referral within specialty, type (and region)."""
    keys = ("specialty", "ref_type", "region", "auth_number") if with_region else ROLLUP
    n = F.col("lines")
    return (
        _referral_parts(scored, keys)
        .filter(_complete(keys))
        .select(
            *keys,
            "units",
            (F.col("auto") / n).alias("is_autoapp"),
            (F.col("ppl") / n).alias("is_ppl"),
            (F.col("app") / n).alias("is_app"),
            (F.col("den") / n).alias("is_den"),
            "aa_yn",
        )
    )


def specialty_rates(rollup: DataFrame) -> DataFrame:
    """Referral volume, new and old automatic approval rate per specialty."""
    return rollup.groupBy("specialty").agg(
        F.count("aa_yn").alias("ref_vol"),
        F.avg("aa_yn").alias("new_rate"),
        F.avg("is_autoapp").alias("old_rate"),
    )


def denied_now_approved(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("specialty").agg(
        F.coalesce(F.sum(F.col("is_den") * F.col("aa_yn")), F.lit(0.0)).alias("deny_now_aa")
    )


def line_financials(lines: DataFrame, unit_cost: float | None) -> DataFrame:
    """Dollar effects per line; needs aa_yn, avg_hcp_cost and roi."""
    unit_cost = F.lit(unit_cost).cast("double")
    aa, auto = F.col("aa_yn"), F.col("is_autoapp")
    loss = auto * (1 - aa) * unit_cost
    return lines.withColumns(
        {
            "dollars_denied_now_app": F.col("is_den") * aa * F.col("avg_hcp_cost"),
            "cost_to_review_bene": (1 - auto) * aa * unit_cost,
            "cost_to_review_loss": loss,
            "new_denial_bene_est": loss * F.col("roi") * F.col("is_ppl"),
        }
    )


def scored_line_financials(lines: DataFrame, decisions: DataFrame, unit_cost: float | None) -> DataFrame:
    """Line financials from cleaned lines and decisions."""
    return line_financials(attach_referral_decision(score_lines(lines, decisions)), unit_cost)


def specialty_financials(financials: DataFrame) -> DataFrame:
    """Sums per specialty; a specialty without any known amount sums to 0."""
    return (
        financials.filter(F.col("specialty").isNotNull())
        .groupBy("specialty")
        .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in DOLLARS])
    )


def net_benefit(df: DataFrame) -> DataFrame:
    kept = (
        F.col("cost_to_review_bene") - F.col("cost_to_review_loss") - F.col("dollars_denied_now_app")
    )
    return df.withColumns(
        {"net_benefit": kept, "net_benefit_w_new_den": kept + F.col("new_denial_bene_est")}
    )


def specialty_summary(
    lines: DataFrame,
    decisions: DataFrame,
    unit_cost: float | None,
    with_region: bool = False,
    staged: bool = False,
) -> DataFrame:
    """The specialty report in one pass over the cleaned lines: rates count
    referrals that have a specialty, a type and a number; dollars count every
    line of the specialty. ``decisions`` should be staged, it is read twice."""
    keys = ("specialty", "ref_type", "region", "auth_number") if with_region else ROLLUP
    parts = _referral_parts(score_lines(lines, decisions, staged=staged), keys).filter(
        F.col("specialty").isNotNull()
    )
    aa, auto, n = F.col("aa_yn"), F.col("auto"), F.col("lines")
    counted = _complete(keys)
    unit_cost = F.lit(unit_cost).cast("double")

    def total(amount: Column) -> Column:
        return F.coalesce(F.sum(amount), F.lit(0.0))

    report = parts.groupBy("specialty").agg(
        F.count(F.when(counted, aa)).alias("ref_vol"),
        F.avg(F.when(counted, aa)).alias("new_rate"),
        F.avg(F.when(counted, auto / n)).alias("old_rate"),
        total(F.when(counted, F.col("den") / n * aa)).alias("deny_now_aa"),
        (total((n - auto) * aa) * unit_cost).alias("cost_to_review_bene"),
        (total(auto * (1 - aa)) * unit_cost).alias("cost_to_review_loss"),
        total(F.col("den_cost") * aa).alias("dollars_denied_now_app"),
        (total(F.col("auto_roi") * (1 - aa)) * unit_cost).alias("new_denial_bene_est"),
    )
    codes = allow_list(decisions).groupBy("specialty").agg(F.count(F.lit(1)).alias("num_codes"))
    return net_benefit(
        report.filter(F.col("ref_vol") > 0)
        .join(codes, "specialty", "left")
        .withColumn("num_codes", F.coalesce("num_codes", F.lit(0).cast("long")))
    ).select(
        "specialty", "ref_vol", "new_rate", "old_rate", "num_codes", "deny_now_aa",
        "cost_to_review_bene", "cost_to_review_loss", "dollars_denied_now_app",
        "new_denial_bene_est", "net_benefit", "net_benefit_w_new_den",
    )


def projected_code_rate(lines: DataFrame) -> DataFrame:
    """Share of a code's lines whose whole referral is approvable.

    Takes lines with ``auto_approvable``. Lines are counted per referral and
    group first, so the referral step sees sums only.
    """
    counted = lines.groupBy("auth_number", *GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.min("auto_approvable").alias("__least")
    )
    whole = Window.partitionBy("auth_number")
    known = F.when(F.col("auth_number").isNotNull(), F.min("__least").over(whole))
    return (
        counted.withColumn("aa_yn", known)
        .filter(_complete(GROUP))
        .groupBy(*GROUP)
        .agg(
            F.try_divide(
                F.sum(F.col("aa_yn") * F.col("n")),
                F.sum(F.when(F.col("aa_yn").isNotNull(), F.col("n"))),
            ).alias("new_rate")
        )
    )


def code_detail(decisions: DataFrame, rates: DataFrame, names: DataFrame) -> DataFrame:
    """Decisions with the projected rate and the code description; codes
    without a description are left out. All sides are grouped results."""
    described = names.select("cpt_code", F.col("name").alias("cpt_desc"))
    return (
        decisions.drop("cnt_hcp_cost")
        .join(rates, list(GROUP), "left")
        .join(described, "cpt_code")
        .select(
            *GROUP, "units", "auto_rate", "denial_rate", "units_man", "cost_to_review",
            "avg_hcp_cost", "sum_cost_denied", "roi", "fin_aa_rec", "dec_source",
            "overrule_rsn", "final_decision", "new_rate", "cpt_desc",
        )
    )
