"""Evaluation of model candidates by confidence decile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.functions.columns import flag, in_list, replace_values
from clearlane.operators.cleaning import RULES_M, split_specialties
from clearlane.operators.crosstab import frequency, margin_table
from clearlane.operators.overrides import latest_decisions
from clearlane.operators.ranking import merged_sketch, quantile_bin, quantile_sketches
from clearlane.operators.staging import bounded_left_join, keyed_left_join


def prepare_predictions(predictions: DataFrame) -> DataFrame:
    """Default provider status, network flag (null for unknown statuses),
    normalised specialty and the human verdict."""
    status = F.coalesce(F.col("ref_to_status"), F.lit(K.DEFAULT_PROVIDER_STATUS))
    return predictions.withColumns(
        {
            "ref_to_status": status,
            "is_ppl": F.when(in_list(status, K.IN_NETWORK_PROVIDER_STATUSES), F.lit(1)).when(
                in_list(status, K.OUT_OF_NETWORK_PROVIDER_STATUSES), F.lit(0)
            ),
            "ref_to_specialty": replace_values(
                F.col("ref_to_specialty"), K.PREDICTED_SPECIALTY_CLEANUP
            ),
            "is_approved": flag(F.col("status_type_human") == K.HUMAN_APPROVED),
        }
    )


def confidence_sketches(predictions: DataFrame, column: str = "confidence") -> DataFrame:
    """(month, sketch) of the candidates; sketches of new months can be added."""
    by_month = predictions.withColumn("month", F.date_format("dt_prediction", "yyyy-MM"))
    return quantile_sketches(by_month, column, "month")


def confidence_decile(
    predictions: DataFrame, column: str = "confidence", sketches: DataFrame | None = None
) -> DataFrame:
    """``sketches`` of the same candidates save one of the passes over them."""
    sketch = None if sketches is None else merged_sketch(sketches)
    return quantile_bin(predictions, column, K.DECILES, "decile", sketch)


def in_network_decisions(decisions: DataFrame) -> DataFrame:
    """One in-network decision per (specialty, code); reason defaults to the
    analysis."""
    return (
        latest_decisions(decisions.filter(F.col("is_ppl") == 1))
        .withColumn("reason", F.coalesce("reason", F.lit(K.SOURCE_ANALYSIS)))
    )


def referral_cost(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cost of a referral: the sum of its codes' average costs, 0 when none is
    known. Takes lines before retrospective reviews are removed.

    Lines are counted per referral and code before they meet the costs.
    Missing specialties or codes match missing ones.
    """
    counted = (
        split_specialties(lines, RULES_M)
        .filter(F.col("auth_number").isNotNull())
        .groupBy("auth_number", "specialty", "cpt_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    costs = in_network_decisions(decisions).select("specialty", "cpt_code", "avg_cost")
    joined = bounded_left_join(counted, costs, ["specialty", "cpt_code"], null_safe=True)
    return joined.groupBy("auth_number").agg(
        F.coalesce(F.sum(F.col("avg_cost") * F.col("n")), F.lit(0.0)).alias("avg_cost")
    )


def with_decisions(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clinical decision and reason of the predicted (specialty, code)."""
    sheet = in_network_decisions(decisions).select(
        F.col("specialty").alias("ref_to_specialty"),
        F.col("cpt_code").alias("px_code"),
        "is_ppl",
        "decision",
        "reason",
    )
    return bounded_left_join(
        predictions, sheet, ["ref_to_specialty", "px_code", "is_ppl"], null_safe=True
    )


def false_positive_dollars(predictions: DataFrame, costs: DataFrame) -> DataFrame:
    """Dollars approved by the model and not by people, per candidate. A
    referral without a cost record gets the default cost."""
    counts = (
        predictions.filter(F.col("referral_ident").isNotNull())
        .groupBy("referral_ident")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    sized = counts.join(
        costs.withColumnRenamed("auth_number", "referral_ident"), "referral_ident", "left"
    )
    joined = keyed_left_join(predictions, sized, ["referral_ident"], "__n")
    return joined.withColumn(
        "avg_cost", F.coalesce("avg_cost", F.lit(K.DEFAULT_REFERRAL_COST))
    ).withColumn("false_positive_dollars", (1 - F.col("is_approved")) * F.col("avg_cost"))


def evaluation_cells(evaluated: DataFrame, costs: DataFrame) -> DataFrame:
    """Candidates counted per referral, decile, status, decision and reason,
    then valued: the input of every report below. Counting first means the
    cost join sees each referral a few times at most."""
    keys = ["decile", "status_type_human", "is_approved", "decision", "reason"]
    counted = evaluated.groupBy("referral_ident", *keys).agg(F.count(F.lit(1)).alias("candidates"))
    priced = counted.join(
        costs.withColumnRenamed("auth_number", "referral_ident"), "referral_ident", "left"
    )
    dollars = (
        (1 - F.col("is_approved"))
        * F.coalesce("avg_cost", F.lit(K.DEFAULT_REFERRAL_COST))
        * F.col("candidates")
    )
    return priced.groupBy(*keys).agg(
        F.sum("candidates").alias("candidates"),
        F.sum(F.when(F.col("referral_ident").isNotNull(), F.col("candidates"))).alias("referrals"),
        F.sum(dollars).alias("false_positive_dollars"),
    )


def decile_report(cells: DataFrame) -> DataFrame:
    """Candidates and false positive dollars per decile and in total; once for
    all, once without cancelled referrals (a missing status is not one)."""
    open_case = ~F.col("status_type_human").eqNullSafe(K.HUMAN_CANCELLED)
    dollars = F.col("false_positive_dollars")
    return margin_table(
        cells,
        ["decile"],
        [[]],
        {
            "candidates": F.sum("candidates"),
            "false_positive_dollars": F.sum(dollars),
            "dollars_not_cancelled": F.sum(F.when(open_case, dollars)),
        },
    )


def decile_status(cells: DataFrame, decile: int = K.DECILES - 1) -> DataFrame:
    """Human statuses within one decile, with total."""
    return margin_table(
        cells.filter(F.col("decile") == decile),
        ["status_type_human"],
        [[]],
        {"n": F.coalesce(F.sum("referrals"), F.lit(0).cast("long"))},
    )


def decision_reason_crosstab(cells: DataFrame, above_decile: int = K.DECILES - 2) -> DataFrame:
    """Decision and reason (rows) by approval (columns) in the top decile. All
    observed decisions are paired with all observed reasons; empty cells are
    kept with a null count. Margins as usual."""
    top = cells.filter(F.col("decile") > above_decile)
    keys = ["decision", "reason", "is_approved"]
    table = margin_table(
        top, keys, [["decision", "reason"], ["is_approved"], []],
        {"n": F.coalesce(F.sum("referrals"), F.lit(0).cast("long"))},
    )
    inner = table.filter(F.col("decision") != K.ALL)
    # a decision is 0 or 1, approval is 0, 1 or the margin: a fixed set per reason
    frame = (
        inner.select("reason").distinct()
        .withColumn("decision", F.explode(F.array(F.lit("0"), F.lit("1"))))
        .withColumn("is_approved", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit(K.ALL))))
        .join(inner.select("decision").distinct(), "decision", "left_semi")
        .join(inner.select("is_approved").distinct(), "is_approved", "left_semi")
    )
    full = frame.join(inner, keys, "left").select(*keys, "n")
    return full.union(table.filter(F.col("decision") == K.ALL).select(*keys, "n"))


def rejected_status_frequency(cells: DataFrame, decile: int = 6) -> DataFrame:
    """Statuses of the candidates of one decile that people did not approve."""
    chosen = cells.filter((F.col("decile") == decile) & (F.col("is_approved") == 0))
    return (
        chosen.filter(F.col("status_type_human").isNotNull())
        .groupBy("status_type_human")
        .agg(F.sum("candidates").alias("n"))
        .orderBy(F.col("n").desc(), "status_type_human")
    )


def rejection_rate(predictions: DataFrame) -> DataFrame:
    return predictions.agg((1 - F.avg("is_approved")).alias("rejection_rate"))


def unmatched_candidates(evaluated: DataFrame) -> DataFrame:
    """Candidates without a clinical decision, by specialty."""
    return frequency(evaluated.filter(F.col("decision").isNull()), "ref_to_specialty")
