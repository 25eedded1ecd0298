"""Ordered overrides of the analytic recommendation.

An override plan is data: a tuple of steps applied first to last, the last
writer winning. Two kinds behave differently and must not be merged: *force*
steps always rewrite reason and source, *decision sheets* only where their
decision differs from the current one.

A whole plan is one table of rules: the lists, sheets and conditions of all steps as
rows with the number of the step and the keys they are for, where a key may be
any. The groups meet the rules in one join and fold theirs in the order of the
steps, however many steps and sheets a plan has. The functions for a single step
say what a step does; a plan never touches the referral lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane import constants as K
from clearlane.operators.costing import GROUP


def start_decisions(roi: DataFrame) -> DataFrame:
    """Decision columns before any override: analysis decides."""
    return roi.withColumns(
        {
            "dec_source": F.lit(K.SOURCE_ANALYSIS),
            "overrule_rsn": F.lit(None).cast("string"),
            "final_decision": F.col("fin_aa_rec"),
        }
    )


def force(df: DataFrame, where: Column, reason: str, source: str, decision: int) -> DataFrame:
    return df.withColumns(
        {
            "dec_source": F.when(where, F.lit(source)).otherwise(F.col("dec_source")),
            "overrule_rsn": F.when(where, F.lit(reason)).otherwise(F.col("overrule_rsn")),
            "final_decision": F.when(where, F.lit(decision)).otherwise(F.col("final_decision")),
        }
    )


def override_codes(
    df: DataFrame,
    codes: Sequence[str],
    specialties: Sequence[str] | None,
    decision: int,
    reason: str = K.REASON_CODE_LIST,
    is_ppl: int | None = None,
) -> DataFrame:
    """Force a decision on listed codes of listed specialties (None = all)."""
    where = F.col("cpt_code").isin(*codes)
    if specialties is not None:
        where = where & F.col("specialty").isin(*specialties)
    if is_ppl is not None:
        where = where & (F.col("is_ppl") == is_ppl)
    return force(df, where, reason, K.SOURCE_CLINICAL, decision)


def override_specialties(
    df: DataFrame, specialties: Sequence[str], reason: str, source: str
) -> DataFrame:
    return force(df, F.col("specialty").isin(*specialties), reason, source, 0)


def override_low_volume(
    df: DataFrame, threshold: int = K.LOW_VOLUME, source: str = K.SOURCE_RULE
) -> DataFrame:
    return force(df, F.col("units") <= threshold, K.REASON_LOW_VOLUME, source, 0)


def override_out_of_network(df: DataFrame, source: str = K.SOURCE_RULE) -> DataFrame:
    return force(df, F.col("is_ppl") == 0, K.REASON_OUT_OF_NETWORK, source, 0)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per (specialty, code, in network): the latest by date, ties
    broken by the remaining columns."""
    rest = [c for c in decisions.columns if c not in (*GROUP, "decision_date")]
    order = Window.partitionBy(*GROUP).orderBy(
        F.col("decision_date").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]
    )
    return (
        decisions.withColumn("__place", F.row_number().over(order))
        .filter(F.col("__place") == 1)
        .drop("__place")
    )


def duplicate_decisions(decisions: DataFrame) -> DataFrame:
    return (
        decisions.groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def overlay_decisions(df: DataFrame, decisions: DataFrame, reason: str = "reason") -> DataFrame:
    """Apply a decision sheet where it says something else than the current
    decision; agreeing or empty decisions change nothing."""
    sheet = latest_decisions(decisions).select(
        *GROUP, F.col("decision").alias("__decision"), F.col(reason).alias("__reason")
    )
    joined = df.join(sheet, list(GROUP), "left")
    differs = F.col("__decision").isNotNull() & (F.col("__decision") != F.col("final_decision"))
    return joined.withColumns(
        {
            "dec_source": F.when(differs, F.lit(K.SOURCE_CLINICAL)).otherwise(F.col("dec_source")),
            "overrule_rsn": F.when(differs, F.col("__reason")).otherwise(F.col("overrule_rsn")),
            "final_decision": F.coalesce("__decision", "final_decision"),
        }
    ).drop("__decision", "__reason")


# --- plans as data ------------------------------------------------------------


@dataclass(frozen=True)
class Codes:
    codes: Sequence[str]
    specialties: Sequence[str] | None
    decision: int
    is_ppl: int | None = None


@dataclass(frozen=True)
class Specialties:
    specialties: Sequence[str]
    reason: str
    source: str


@dataclass(frozen=True)
class Sheet:
    """A decision sheet, looked up by name when the plan runs."""

    name: str
    reason: str = "reason"


@dataclass(frozen=True)
class LowVolume:
    source: str = K.SOURCE_RULE


@dataclass(frozen=True)
class OutOfNetwork:
    source: str = K.SOURCE_RULE


Step = Codes | Specialties | Sheet | LowVolume | OutOfNetwork


def _code_lists(is_ppl: int | None = None) -> tuple[Step, ...]:
    return (
        Codes(K.DERMATOLOGY_CODES, ("DERMATOLOGY",), 1, is_ppl),
        Codes(K.PAIN_CODES, ("PAIN MANAGEMENT",), 1, is_ppl),
        Codes(K.GASTRO_CODES, ("GASTROENTEROLOGY", "SURGERY - GENERAL"), 1, is_ppl),
        Codes(K.TRANSFUSION_CODES, None, 1, is_ppl),
        Codes(K.PODIATRY_CODES, ("PODIATRY",), 1, is_ppl),
        Codes(K.CODES_TO_PEND, None, 0, is_ppl),
    )


_SOFT = Specialties(K.SOFT_PEND_SPECIALTIES, K.REASON_SOFT_PEND, K.SOURCE_CLINICAL)
_HARD = Specialties(K.HARD_PEND_SPECIALTIES, K.REASON_HARD_PEND, K.SOURCE_RULE)

PLAN_A: tuple[Step, ...] = (
    *_code_lists(),
    _SOFT,
    Sheet("sheet_1", "notes"),
    Sheet("sheet_2", "notes"),
    Sheet("sheet_3", "notes"),
    Sheet("sheet_4", "notes"),
    LowVolume(K.SOURCE_RULE_CAPITAL),
    Specialties(K.HARD_PEND_SPECIALTIES_A, K.REASON_HARD_PEND, K.SOURCE_CLINICAL),
    OutOfNetwork(K.SOURCE_CLINICAL),
)
PLAN_B: tuple[Step, ...] = (
    *_code_lists(is_ppl=1),
    _SOFT,
    OutOfNetwork(),
    LowVolume(),
    Sheet("sheet", "notes"),
    _HARD,
)
PLAN_C: tuple[Step, ...] = (
    Sheet("master"),
    Specialties(K.SOFT_PEND_SPECIALTIES_C, K.REASON_SOFT_PEND, K.SOURCE_CLINICAL),
    LowVolume(),
    _HARD,
    OutOfNetwork(),
)
PLAN_M: tuple[Step, ...] = (
    *_code_lists(),
    _SOFT,
    Sheet("master"),
    LowVolume(),
    _HARD,
    OutOfNetwork(),
)


_ALL_KEYS = 7  # the mask of a rule for one specialty, code and network flag
_RULE = "step int, mask int, specialty string, cpt_code string, is_ppl int, decision int, reason string, source string, sheet boolean, max_units long"


def _fixed_rules(plan: Sequence[Step], low_volume: int) -> list[tuple]:
    """The rows of all steps but the sheets. A key that is any is left empty, and
    its bit in the mask is 0."""

    def row(step, specialty, code, is_ppl, decision, reason, source, max_units=None) -> tuple:
        mask = (specialty is not None) + 2 * (code is not None) + 4 * (is_ppl is not None)
        return (step, mask, specialty or "", code or "", -1 if is_ppl is None else is_ppl, decision, reason, source, False, max_units)

    rows = []
    for number, step in enumerate(plan):
        match step:
            case Codes():
                for code in dict.fromkeys(step.codes):
                    for specialty in (None,) if step.specialties is None else dict.fromkeys(step.specialties):
                        rows.append(row(number, specialty, code, step.is_ppl, step.decision, K.REASON_CODE_LIST, K.SOURCE_CLINICAL))
            case Specialties():
                for specialty in dict.fromkeys(step.specialties):
                    rows.append(row(number, specialty, None, None, 0, step.reason, step.source))
            case LowVolume():
                rows.append(row(number, None, None, None, 0, K.REASON_LOW_VOLUME, step.source, low_volume))
            case OutOfNetwork():
                rows.append(row(number, None, None, 0, 0, K.REASON_OUT_OF_NETWORK, step.source))
    return rows


def _sheet_rules(plan: Sequence[Step], sheets: Mapping[str, DataFrame]) -> DataFrame | None:
    """All sheets of a plan: one decision per step and group, the latest by date,
    ties broken by the remaining columns."""
    used = [(number, sheets[step.name].withColumnRenamed(step.reason, "reason")) for number, step in enumerate(plan) if isinstance(step, Sheet)]
    if not used:
        return None
    rows = None
    for number, sheet in used:
        part = sheet.withColumn("step", F.lit(number))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*GROUP, "step", "decision_date")]
    order = Window.partitionBy("step", *GROUP).orderBy(F.col("decision_date").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest])
    latest = rows.withColumn("__place", F.row_number().over(order)).filter("__place = 1 AND decision IS NOT NULL")
    return latest.select(
        "step", F.lit(_ALL_KEYS).alias("mask"), *GROUP, "decision", "reason", F.lit(K.SOURCE_CLINICAL).alias("source"), F.lit(True).alias("sheet"), F.lit(None).cast("long").alias("max_units")
    )


def plan_rules(spark: SparkSession, plan: Sequence[Step], sheets: Mapping[str, DataFrame], low_volume: int = K.LOW_VOLUME) -> DataFrame:
    """A plan as a table of rules, in no order; ``step`` says when a rule counts."""
    rules = spark.createDataFrame(_fixed_rules(plan, low_volume), _RULE)
    decided = _sheet_rules(plan, sheets)
    return rules if decided is None else rules.unionByName(decided)


def apply_plan(
    df: DataFrame,
    plan: Sequence[Step],
    sheets: Mapping[str, DataFrame],
    low_volume: int = K.LOW_VOLUME,
) -> DataFrame:
    """``df`` (one row per group, as ``start_decisions`` gives it) after all steps
    of ``plan``. A group without a specialty, code or network flag meets the rules
    in which that key is any."""
    rules = plan_rules(df.sparkSession, plan, sheets, low_volume)
    any_key = {"specialty": "", "cpt_code": "", "is_ppl": -1}
    keys = lambda mask: [
        (F.col(c) if mask >> bit & 1 else F.lit(any_key[c]).cast(df.schema[c].dataType)).alias(f"__{c}") for bit, c in enumerate(GROUP)
    ]
    # a group asks once for every combination of keys that some rule has
    masks = sorted({r[1] for r in _fixed_rules(plan, low_volume)} | {_ALL_KEYS})
    asked = df.withColumn("__k", F.explode(F.array(*[F.struct(F.lit(m).alias("__mask"), *keys(m)) for m in masks]))).select(*df.columns, "__k.*")
    rule = F.struct("step", "decision", "reason", "source", "sheet", "max_units")
    met = rules.select(F.col("mask").alias("__mask"), *[F.col(c).alias(f"__{c}") for c in GROUP], rule.alias("__rule"))
    joined = asked.join(met, ["__mask", *[f"__{c}" for c in GROUP]], "left")
    others = [c for c in df.columns if c not in GROUP]
    # the rules of one group: at most one of a step and a sheet, and of each mask
    folded = joined.groupBy(*GROUP).agg(*[F.first(c).alias(c) for c in others], F.array_sort(F.collect_list("__rule")).alias("__rules"))

    def step(now: Column, rule: Column) -> Column:
        applies = rule["max_units"].isNull() | F.coalesce(F.col("units") <= rule["max_units"], F.lit(False))
        differs = F.coalesce(rule["decision"] != now["final_decision"], F.lit(False))
        rewrites = F.when(rule["sheet"], differs).otherwise(applies)
        decides = F.when(rule["sheet"], F.lit(True)).otherwise(applies)
        return F.struct(
            F.when(rewrites, rule["source"]).otherwise(now["dec_source"]).alias("dec_source"),
            F.when(rewrites, rule["reason"]).otherwise(now["overrule_rsn"]).alias("overrule_rsn"),
            F.when(decides, rule["decision"]).otherwise(now["final_decision"]).alias("final_decision"),
        )

    state = ("dec_source", "overrule_rsn", "final_decision")
    kinds = "struct<dec_source:string,overrule_rsn:string,final_decision:int>"
    start = F.struct(*[F.col(c) for c in state]).cast(kinds)
    last = F.aggregate("__rules", start, lambda now, rule: step(now, rule).cast(kinds))
    done = folded.withColumn("__last", last)
    return done.select(*[F.col(f"__last.{c}").alias(c) if c in state else F.col(c) for c in df.columns])
