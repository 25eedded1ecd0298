"""From decisions to an allow-list, and from the allow-list to referrals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.functions.columns import flag, not_in_list
from clearlane.operators.costing import GROUP
from clearlane.operators.staging import bounded_left_join, keyed_left_join

REFERRAL = ("auth_number",)


def allow_list(decisions: DataFrame, is_ppl: int = 1) -> DataFrame:
    """Distinct (specialty, code) that may be approved automatically."""
    return (
        decisions.filter((F.col("final_decision") == 1) & (F.col("is_ppl") == is_ppl))
        .select("specialty", "cpt_code")
        .distinct()
    )


def allow_list_counts(allowed: DataFrame, specialties: DataFrame) -> DataFrame:
    """Allowed codes per specialty, 0 where a specialty has none."""
    counts = allowed.groupBy("specialty").agg(F.count(F.lit(1)).alias("num_codes"))
    return (
        specialties.filter(F.col("specialty").isNotNull())
        .join(counts, "specialty", "left")
        .withColumn("num_codes", F.coalesce("num_codes", F.lit(0).cast("long")))
    )


def _approvable(listed: Column, pend_types: Sequence[str]) -> Column:
    """An unknown referral type is not a type to pend."""
    return flag((F.col("is_ppl") == 1) & listed & not_in_list(F.col("ref_type"), pend_types))


def assign_status(
    lines: DataFrame,
    allowed: DataFrame,
    pend_types: Sequence[str] = K.PEND_REFERRAL_TYPES,
) -> DataFrame:
    """``auto_approvable`` per line for any allow-list."""
    marked = allowed.select("specialty", "cpt_code").distinct().withColumn("__listed", F.lit(True))
    joined = bounded_left_join(lines, marked, ["specialty", "cpt_code"])
    return joined.withColumn(
        "auto_approvable", _approvable(F.col("__listed").isNotNull(), pend_types)
    ).drop("__listed")


def score_lines(
    lines: DataFrame,
    decisions: DataFrame,
    pend_types: Sequence[str] = K.PEND_REFERRAL_TYPES,
    staged: bool = False,
) -> DataFrame:
    """``auto_approvable`` together with cost and return of the line's group,
    in one join with the decisions."""
    lookup = decisions.select(*GROUP, "avg_hcp_cost", "roi", F.col("final_decision").alias("__final"))
    joined = bounded_left_join(lines, lookup, list(GROUP), staged=staged)
    listed = F.coalesce(F.col("__final") == 1, F.lit(False))
    return joined.withColumn("auto_approvable", _approvable(listed, pend_types)).drop("__final")


def referral_decision(lines: DataFrame) -> DataFrame:
    """A referral is approvable when every one of its lines is."""
    return (
        lines.filter(F.col("auth_number").isNotNull())
        .groupBy("auth_number")
        .agg(
            F.min("auto_approvable").alias("aa_yn"),
            F.avg("is_den").alias("denial_rate"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def attach_referral_decision(lines: DataFrame) -> DataFrame:
    """``aa_yn`` of the referral on each of its lines; null without a referral
    number. Safe for a referral number that holds a large share of the lines."""
    referrals = referral_decision(lines).select("auth_number", "aa_yn", "lines")
    return keyed_left_join(lines, referrals, REFERRAL, "lines")


def predicted_rate(referrals: DataFrame, haircut: float = 0.0) -> DataFrame:
    return referrals.agg((F.avg("aa_yn") - F.lit(haircut)).alias("predicted_rate"))


def false_positives(lines: DataFrame) -> DataFrame:
    """Lines that people denied and the rules would approve. Only referrals
    with a denied line and no line to pend can contribute, so both sides are
    reduced to those before they meet."""
    referrals = (
        lines.filter(F.col("auth_number").isNotNull())
        .groupBy("auth_number")
        .agg(
            F.min("auto_approvable").alias("aa_yn"),
            F.sum("is_den").cast("long").alias("__denied"),
        )
        .filter((F.col("aa_yn") == 1) & (F.col("__denied") > 0))
    )
    denied = lines.filter(F.col("is_den") == 1)
    return keyed_left_join(denied, referrals, REFERRAL, "__denied").filter(F.col("aa_yn") == 1)


def referral_lookup(
    lines: DataFrame,
    specialty: str | None = None,
    cpt_code: str | None = None,
    auth_number: str | None = None,
    **equal: object,
) -> DataFrame:
    """Rows that match every given value."""
    wanted = {"specialty": specialty, "cpt_code": cpt_code, "auth_number": auth_number, **equal}
    for column, value in wanted.items():
        if value is not None:
            lines = lines.filter(F.col(column) == value)
    return lines


def last_rows(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The last ``n`` rows in a stated order, for inspection."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order_by]).limit(n)
