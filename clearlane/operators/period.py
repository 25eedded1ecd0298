"""Comparison of the two halves of a period."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.functions.columns import flag, in_list, safe_ratio, whole_days
from clearlane.operators.costing import GROUP, code_cost, review_cost, roi_columns
from clearlane.operators.overrides import latest_decisions
from clearlane.operators.staging import stage


def period_bounds(lines: DataFrame) -> DataFrame:
    """One row: first and last date received, midpoint and year fraction."""
    first, last = F.min("date_received"), F.max("date_received")
    return lines.agg(first.alias("first_date"), last.alias("last_date")).select(
        "first_date",
        "last_date",
        (F.col("first_date") + (F.col("last_date") - F.col("first_date")) / 2).alias("mid_date"),
        (whole_days(F.col("last_date") - F.col("first_date")) / K.DAYS_PER_YEAR).alias("year_share"),
    )


@dataclass(frozen=True)
class Period:
    """The figures of :func:`period_bounds`; nulls for an empty period."""

    mid_date: datetime | None
    year_share: float | None


def measure_period(lines: DataFrame) -> Period:
    row = period_bounds(lines).first()
    return Period(row["mid_date"], row["year_share"])


def period_split(lines: DataFrame, measured: Period | None = None) -> DataFrame:
    """``post`` is 1 from the midpoint on; a missing date counts as before."""
    measured = measured or measure_period(lines)
    # as text: a Python datetime would be taken for the machine's time zone
    middle = F.lit(measured.mid_date and measured.mid_date.isoformat(" ")).cast("timestamp_ntz")
    return lines.withColumn("post", flag(F.col("date_received") >= middle))


def _half(post: int) -> dict[str, Column]:
    here = F.col("post") == post
    manual = here & (F.col("is_autoapp") == 0)
    return {
        "units": F.count(F.when(here, F.col("units"))),
        "lines": F.count(F.when(here, 1)),
        "is_autoapp": F.avg(F.when(here, F.col("is_autoapp"))),
        "units_man": F.count(F.when(manual, F.col("units"))),
        "is_den": F.avg(F.when(manual, F.col("is_den"))),
        "lines_man": F.count(F.when(manual, 1)),
    }


def half_profiles(split: DataFrame) -> DataFrame:
    """Both halves of every group side by side from one pass over the lines;
    columns of the earlier half end in ``_pre``."""
    later, earlier = _half(1), _half(0)
    return split.groupBy(*GROUP).agg(
        *[c.alias(n) for n, c in later.items()],
        *[c.alias(f"{n}_pre") for n, c in earlier.items()],
    )


def _known() -> Column:
    return F.col("specialty").isNotNull() & F.col("cpt_code").isNotNull()


def period_unit_cost(
    lines_man: int | None, measured: Period, department_cost: float = K.DEPARTMENT_COST
) -> float | None:
    """Department cost scaled to the period, per manual line."""
    if not lines_man or measured.year_share is None:
        return None
    return department_cost * measured.year_share / lines_man


def period_summary(
    lines: DataFrame, department_cost: float = K.DEPARTMENT_COST
) -> DataFrame:
    """Per half and group: volume, automatic approval rate, manual volume,
    denial rate of the manual lines and review cost."""
    measured = measure_period(lines)
    manual = F.col("is_autoapp") == 0
    grouped = stage(
        period_split(lines, measured)
        .groupBy("post", *GROUP)
        .agg(
            F.count("units").alias("units"),
            F.avg("is_autoapp").alias("is_autoapp"),
            F.count(F.when(manual, F.col("units"))).alias("units_man"),
            F.avg(F.when(manual, F.col("is_den"))).alias("is_den"),
            F.count(F.when(manual, 1)).alias("lines_man"),
        )
    )
    unit_cost = period_unit_cost(
        grouped.agg(F.sum("lines_man")).first()[0], measured, department_cost
    )
    return (
        grouped.filter(_known())
        .withColumn("cost_to_review", review_cost("units_man", unit_cost))
        .drop("lines_man")
    )


def reason_category(df: DataFrame, reason: str = "reason", out: str = "reason_cat") -> DataFrame:
    """A missing reason means the analysis decided; unlisted reasons get the
    default category."""
    df = df.withColumn(reason, F.coalesce(F.col(reason), F.lit(K.SOURCE_ANALYSIS)))
    category = F.lit(K.REASON_CATEGORY_DEFAULT)
    for name, reasons in K.REASON_CATEGORIES.items():
        category = F.when(in_list(F.col(reason), reasons), F.lit(name)).otherwise(category)
    return df.withColumn(out, category)


def _half_roi(profiles: DataFrame, unit_cost: float | None) -> DataFrame:
    """Return and recommendation of each half; a half without lines is null."""
    for suffix in ("", "_pre"):
        units, man = f"units{suffix}", f"units_man{suffix}"
        present = F.col(f"lines{suffix}") > 0
        figures = roi_columns(
            F.col("avg_hcp_cost"),
            F.col(f"is_den{suffix}"),
            F.col(man),
            review_cost(man, unit_cost),
        )
        profiles = profiles.withColumns(
            {
                f"roi{suffix}": F.when(present, figures["roi"]),
                f"fin_aa_rec{suffix}": F.when(present, figures["fin_aa_rec"]),
                units: F.when(present, F.col(units)),
                man: F.when(present, F.col(man)),
            }
        )
    return profiles


def period_compare(
    lines: DataFrame,
    claims: DataFrame,
    names: DataFrame,
    decisions: DataFrame,
    department_cost: float = K.DEPARTMENT_COST,
) -> DataFrame:
    """Later against earlier half per (specialty, code, in network), with code
    name and clinical decision. Decisions without volume stay; groups whose
    code has no name do not."""
    measured = measure_period(lines)
    profiles = stage(half_profiles(period_split(lines, measured)))
    manual = profiles.agg(F.sum(F.col("lines_man") + F.col("lines_man_pre"))).first()[0]
    unit_cost = period_unit_cost(manual, measured, department_cost)
    halves = _half_roi(code_cost(profiles.filter(_known()), claims), unit_cost)
    compared = halves.withColumns(
        {
            # the report shows the cost as seen by the later half
            "avg_hcp_cost": F.when(F.col("lines") > 0, F.col("avg_hcp_cost")),
            "vol_increase": safe_ratio(F.col("units"), F.col("units_pre")) - 1,
            "aa_rate_increase": F.col("is_autoapp") - F.col("is_autoapp_pre"),
            "den_rate_increase": F.col("is_den") - F.col("is_den_pre"),
        }
    ).join(names, "cpt_code")
    sheet = latest_decisions(decisions).select(
        *GROUP, "decision_source", "reason", "decision_maker", "decision_date", "decision"
    )
    return reason_category(sheet.join(compared, list(GROUP), "full")).select(
        "specialty", "cpt_code", "name", "is_ppl", "decision_source", "reason", "reason_cat",
        "decision_maker", "decision_date", "decision", "units", "units_pre", "vol_increase",
        "is_autoapp", "is_autoapp_pre", "aa_rate_increase", "is_den", "is_den_pre",
        "den_rate_increase", "units_man", "units_man_pre", "avg_hcp_cost", "roi", "roi_pre",
        "fin_aa_rec", "fin_aa_rec_pre",
    )


def by_volume(comparison: DataFrame) -> DataFrame:
    """Report order: largest volume first, groups without volume last."""
    return comparison.orderBy(F.col("units").desc_nulls_last(), *GROUP)


def high_volume(comparison: DataFrame, above: int = 5000) -> DataFrame:
    return comparison.filter(F.col("units") > above)
