"""Volumes, unit costs and the return on investment of manual review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.functions.columns import flag, safe_ratio

GROUP = ("specialty", "cpt_code", "is_ppl")


def _known(*keys: str) -> Column:
    """Groups with a missing key do not exist in grouped results."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def cost_by_code(claims: DataFrame) -> DataFrame:
    """Mean cost of a code over specialties, each specialty counting once."""
    return (
        claims.filter(_known("cpt_code"))
        .groupBy("cpt_code")
        .agg(F.avg("avg_hcp_cost").alias("avg_hcp_cost_code"))
    )


def manual_volume(lines: DataFrame) -> DataFrame:
    """Manually reviewed lines per group; groups without any are absent."""
    return (
        lines.filter((F.col("is_autoapp") == 0) & _known(*GROUP))
        .groupBy(*GROUP)
        .agg(F.count("units").alias("units_man"))
    )


def code_profile(lines: DataFrame) -> DataFrame:
    """The one pass over the lines that every decision figure needs. Groups
    with a missing key stay in, because the unit cost counts all lines."""
    manual = F.when(F.col("is_autoapp") == 0, F.col("units"))
    return lines.groupBy(*GROUP).agg(
        F.count("units").alias("units"),
        F.avg("is_autoapp").alias("auto_rate"),
        F.avg("is_den").alias("denial_rate"),
        F.count(manual).alias("units_man"),
        F.sum(flag(F.col("is_autoapp") == 0)).cast("long").alias("lines_man"),
    )


def code_summary(lines: DataFrame) -> DataFrame:
    """Volume, automatic approval rate, denial rate and manual volume per
    (specialty, code, in network)."""
    return known_groups(code_profile(lines))


def known_groups(profile: DataFrame) -> DataFrame:
    return profile.filter(_known(*GROUP)).drop("lines_man")


def review_unit_cost(lines: DataFrame, department_cost: float = K.DEPARTMENT_COST) -> DataFrame:
    """One row: manual lines, and department cost per manual line."""
    manual = F.sum(flag(F.col("is_autoapp") == 0)).cast("long")
    return lines.agg(manual.alias("lines_man")).select(
        "lines_man", safe_ratio(F.lit(department_cost), F.col("lines_man")).alias("unit_cost")
    )


def profile_unit_cost(
    profile: DataFrame, department_cost: float = K.DEPARTMENT_COST
) -> float | None:
    """The same unit cost as one number from a staged profile."""
    manual = profile.agg(F.sum("lines_man")).first()[0]
    return department_cost / manual if manual else None


def code_cost(summary: DataFrame, claims: DataFrame) -> DataFrame:
    """Average cost of (specialty, code), else of the code over specialties,
    else null. Both sides are grouped results; nothing is hinted."""
    by_pair = claims.select("specialty", "cpt_code", "cnt_hcp_cost", "avg_hcp_cost")
    return (
        summary.join(by_pair, ["specialty", "cpt_code"], "left")
        .join(cost_by_code(claims), "cpt_code", "left")
        .withColumn("avg_hcp_cost", F.coalesce("avg_hcp_cost", "avg_hcp_cost_code"))
        .drop("avg_hcp_cost_code")
    )


def roi_columns(
    cost: Column, denied_rate: Column, denied_units: Column, cost_to_review: Column
) -> dict[str, Column]:
    """Denied dollars over review cost. Unknown cost is settled first (never
    approve), then groups that nobody reviewed (approve)."""
    denied = denied_rate * denied_units * cost
    ratio = F.when(cost.isNull(), F.lit(K.ROI_UNKNOWN_COST)).otherwise(
        F.coalesce(safe_ratio(denied, cost_to_review), F.lit(K.ROI_NO_REVIEW))
    )
    return {
        "sum_cost_denied": denied,
        "roi": ratio,
        "fin_aa_rec": flag(ratio < K.ROI_THRESHOLD),
    }


def review_cost(units_man: str, unit_cost: float | None) -> Column:
    """Null where nobody reviewed."""
    return F.when(F.col(units_man) > 0, F.col(units_man) * F.lit(unit_cost).cast("double"))


def review_roi(summary: DataFrame, unit_cost: float | None) -> DataFrame:
    """``summary`` with costs gains the review cost, the return and the
    recommendation."""
    with_cost = summary.withColumn("cost_to_review", review_cost("units_man", unit_cost))
    return with_cost.withColumns(
        roi_columns(
            F.col("avg_hcp_cost"), F.col("denial_rate"), F.col("units"), F.col("cost_to_review")
        )
    )


def unmatched_counts(decisions: DataFrame) -> DataFrame:
    """How many groups had no reviewer and how many no usable return."""
    return decisions.agg(
        F.count(F.when(F.col("cost_to_review").isNull(), 1)).alias("groups_without_review"),
        F.count(F.when(F.col("avg_hcp_cost").isNull(), 1)).alias("groups_without_cost"),
        F.count(F.when(F.col("roi").isNull(), 1)).alias("groups_without_roi"),
    )
