"""Cleaning and flagging of referral lines. Projections only: no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane import constants as K
from clearlane.functions.columns import flag, in_list, replace_values, split_by_lob


@dataclass(frozen=True)
class CleaningRules:
    """What differs between the pipeline generations."""

    lob_suffixes: Mapping[str, str] = field(default_factory=lambda: dict(K.LOB_SUFFIX_SENIOR))
    split_specialties: Sequence[str] = K.SPLIT_SPECIALTIES
    # volume is the number of lines; False keeps the units of the source
    count_lines: bool = True
    require_auth_number: bool = False


RULES_A = CleaningRules(lob_suffixes=K.LOB_SUFFIX_A, count_lines=False)
RULES_A_NEW = CleaningRules(lob_suffixes=K.LOB_SUFFIX_A, require_auth_number=True)
RULES_B = CleaningRules()
RULES_C = CleaningRules()
RULES_M = CleaningRules(lob_suffixes=K.LOB_SUFFIX_M)


def parse_dates(lines: DataFrame) -> DataFrame:
    """Text dates of a delimited extract to timestamps."""
    return lines.withColumns(
        {c: F.to_timestamp_ntz(c) for c in ("date_received", "date_decision")}
    )


def split_specialties(lines: DataFrame, rules: CleaningRules = RULES_C) -> DataFrame:
    """Line-of-business suffix on the specialties that are ruled separately."""
    return lines.withColumns(
        {
            "lob": replace_values(F.col("lob"), rules.lob_suffixes),
            "specialty": split_by_lob(
                F.col("specialty"), F.col("lob"), rules.split_specialties, rules.lob_suffixes
            ),
        }
    )


def drop_retro(lines: DataFrame) -> DataFrame:
    """Remove retrospective reviews; a missing status is not retrospective."""
    return lines.filter(flag(in_list(F.col("status_name"), K.RETRO_STATUSES)) == 0)


def add_flags(lines: DataFrame) -> DataFrame:
    """0/1 indicators. A missing network mark means out of network."""
    return lines.withColumns(
        {
            "is_autoapp": flag(F.col("status_name") == K.AUTO_APPROVED_STATUS),
            "is_ppl": flag(F.coalesce(F.col("ppl"), F.lit("N")) == "Y"),
            "is_den": flag(in_list(F.col("status_name"), K.DENIED_STATUSES)),
            "is_app": flag(F.col("status_cat") == K.APPROVED_CATEGORY),
        }
    )


def clean_referrals(lines: DataFrame, rules: CleaningRules = RULES_C) -> DataFrame:
    cleaned = add_flags(drop_retro(split_specialties(lines, rules)))
    if rules.require_auth_number:
        cleaned = cleaned.filter(F.col("auth_number").isNotNull())
    if rules.count_lines:
        cleaned = cleaned.withColumn("units", F.lit(1.0))
    return cleaned


def in_region(lines: DataFrame, region: str) -> DataFrame:
    """Lines of one region; source systems disagree on letter case."""
    return lines.filter(F.upper("region") == region.upper())


def first_line_per_referral(lines: DataFrame) -> DataFrame:
    """Earliest line of each referral, ties broken by every column, so the
    result does not depend on row order. Spark keeps one row per referral and
    map task before it shuffles."""
    tie_break = [c for c in lines.columns if c not in ("auth_number", "date_received", "cpt_code")]
    order = Window.partitionBy("auth_number").orderBy("date_received", "cpt_code", *tie_break)
    return (
        lines.filter(F.col("auth_number").isNotNull())
        .withColumn("__place", F.row_number().over(order))
        .filter(F.col("__place") == 1)
        .drop("__place")
    )


def normalise_notes(decisions: DataFrame, column: str = "notes") -> DataFrame:
    return decisions.withColumn(column, replace_values(F.col(column), K.NOTE_CLEANUP))


def all_specialties(*frames: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct specialties of several extracts, plus named extra ones. Each
    extract is reduced before the union."""
    parts = [f.select("specialty").distinct() for f in frames]
    if extra:
        spark = frames[0].sparkSession
        listed = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in extra])).alias("specialty"))
        parts.append(listed)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    return merged.distinct()


def missing_count(lines: DataFrame, column: str) -> DataFrame:
    return lines.agg(F.sum(F.col(column).isNull().cast("int")).cast("long").alias("missing"))
