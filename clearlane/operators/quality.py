"""Data quality checks as rows: check, value, lo, hi, passed.

The figures of the extract and of the analysed groups can be seen while these are
written (``watch_lines``, ``watch_decisions``); the checks then scan neither. Such
figures are whole when the watched frame is written once by a job of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clearlane import constants as K

_COLUMNS = ("check", "value", "lo", "hi", "passed")


def _row(name: str, value: Column, lo: float | None, hi: float | None) -> Column:
    """Exclusive bounds; a missing bound is open, a missing value fails."""
    passed = value.isNotNull()
    if lo is not None:
        passed = passed & (value > lo)
    if hi is not None:
        passed = passed & (value < hi)
    return F.struct(
        F.lit(name).alias("check"),
        value.cast("double").alias("value"),
        F.lit(lo).cast("double").alias("lo"),
        F.lit(hi).cast("double").alias("hi"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _as_rows(one_row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select(
        *[F.col(f"r.{c}").alias(c) for c in _COLUMNS]
    )


def _days(span: Column) -> Column:
    """Length of an interval in days, fractions included."""
    return span.cast("interval second").cast("decimal(18,6)").cast("double") / 86400.0


def watch_lines(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """The extract, and what is seen of it while it is written: bounds of the dates,
    lines, and lines without a line of business. Write the frame once, as it is."""
    seen = Observation()
    watched = lines.observe(
        seen,
        F.min("date_received").alias("oldest"),
        F.max("date_received").alias("newest"),
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(F.col("lob").isNull(), 1)).alias("missing_lob"),
    )
    return watched, seen


def watch_decisions(decisions: DataFrame) -> tuple[DataFrame, Observation]:
    """The analysed groups, and the totals that the cost checks need."""
    seen = Observation()
    return decisions.observe(seen, *_costs()), seen


def _seen(spark: SparkSession, seen: Observation, schema: str) -> DataFrame:
    """One row with the observed figures; those of an empty frame are null."""
    try:
        figures = seen.get
    except Py4JJavaError:  # nothing was written, so nothing was seen
        figures = {}
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(figures.get(c) for c in names)], schema)


def _date_rows(bounds: DataFrame, as_of: str, fresh_days: int, span_days: tuple[int, int]) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return _as_rows(
        bounds,
        [
            _row("freshness_days", _days(now - F.col("newest")), None, fresh_days),
            _row("span_days", _days(F.col("newest") - F.col("oldest")), *span_days),
        ],
    )


def date_checks(
    lines: DataFrame,
    as_of: str,
    fresh_days: int = K.FRESH_DAYS,
    span_days: tuple[int, int] = K.SPAN_DAYS,
) -> DataFrame:
    """Age of the newest line at ``as_of``, and the span of the extract."""
    bounds = lines.agg(F.min("date_received").alias("oldest"), F.max("date_received").alias("newest"))
    return _date_rows(bounds, as_of, fresh_days, span_days)


def date_checks_seen(
    spark: SparkSession,
    seen: Observation,
    as_of: str,
    fresh_days: int = K.FRESH_DAYS,
    span_days: tuple[int, int] = K.SPAN_DAYS,
) -> DataFrame:
    """``date_checks`` of an extract that was watched while it was written."""
    return _date_rows(_seen(spark, seen, "oldest timestamp_ntz, newest timestamp_ntz"), as_of, fresh_days, span_days)


def missing_lob_seen(spark: SparkSession, seen: Observation) -> DataFrame:
    """Lines, and those without a line of business, of a watched extract."""
    figures = _seen(spark, seen, "lines bigint, missing_lob bigint")
    return figures.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in figures.columns])


def _costs() -> tuple[Column, ...]:
    return (
        F.sum("cost_to_review").alias("cost"),
        F.count(F.when(F.col("roi").isNull(), 1)).alias("no_roi"),
        F.count(F.when(F.col("units_man") == 0, 1)).alias("no_review"),
    )


def _cost_rows(totals: DataFrame, department_cost: float, tolerance: float) -> DataFrame:
    return _as_rows(
        totals,
        [
            _row(
                "review_cost", F.col("cost"),
                department_cost * (1 - tolerance), department_cost * (1 + tolerance),
            ),
            _row("groups_without_roi", F.coalesce("no_roi", F.lit(0)), None, 1),
            _row("groups_without_review", F.coalesce("no_review", F.lit(0)), None, None),
        ],
    )


def cost_checks(
    decisions: DataFrame,
    department_cost: float = K.DEPARTMENT_COST,
    tolerance: float = K.COST_TOLERANCE,
) -> DataFrame:
    """Total review cost near the department cost; groups without a return or
    without a reviewer are reported, not judged."""
    return _cost_rows(decisions.agg(*_costs()), department_cost, tolerance)


def cost_checks_seen(
    spark: SparkSession,
    seen: Observation,
    department_cost: float = K.DEPARTMENT_COST,
    tolerance: float = K.COST_TOLERANCE,
) -> DataFrame:
    """``cost_checks`` of groups that were watched while they were written."""
    return _cost_rows(_seen(spark, seen, "cost double, no_roi bigint, no_review bigint"), department_cost, tolerance)


def unexpected_reasons(
    decisions: DataFrame, expected: Sequence[str] = K.EXPECTED_REASONS
) -> DataFrame:
    """Reasons outside the expected list; a missing reason is expected."""
    listed = decisions.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(r) for r in expected])).alias("reason")
    )
    return (
        decisions.filter(F.col("reason").isNotNull())
        .select("reason")
        .distinct()
        .join(listed, "reason", "left_anti")
    )


def reason_check(decisions: DataFrame) -> DataFrame:
    found = unexpected_reasons(decisions).agg(F.count(F.lit(1)).alias("n"))
    return _as_rows(found, [_row("unexpected_reasons", F.col("n"), None, 1)])


def duplicate_check(decisions: DataFrame) -> DataFrame:
    """Decision keys that occur more than once."""
    from clearlane.operators.overrides import duplicate_decisions

    found = duplicate_decisions(decisions).agg(F.count(F.lit(1)).alias("n"))
    return _as_rows(found, [_row("duplicate_decision_keys", F.col("n"), None, 1)])


def quality_checks(
    lines: DataFrame,
    decisions: DataFrame,
    sheet: DataFrame,
    as_of: str,
    department_cost: float = K.DEPARTMENT_COST,
    fresh_days: int = K.FRESH_DAYS,
    span_days: tuple[int, int] = K.SPAN_DAYS,
) -> DataFrame:
    """All checks: ``lines`` as extracted, ``decisions`` the analysed groups,
    ``sheet`` the clinical decisions."""
    return (
        date_checks(lines, as_of, fresh_days, span_days)
        .union(cost_checks(decisions, department_cost))
        .union(reason_check(sheet))
        .union(duplicate_check(sheet))
    )


def written_checks(
    seen_lines: Observation,
    seen_decisions: Observation,
    sheet: DataFrame,
    as_of: str,
    department_cost: float = K.DEPARTMENT_COST,
    fresh_days: int = K.FRESH_DAYS,
    span_days: tuple[int, int] = K.SPAN_DAYS,
) -> DataFrame:
    """``quality_checks`` from what was seen when the extract and the groups were
    written; only the sheet is read."""
    spark = sheet.sparkSession
    return (
        date_checks_seen(spark, seen_lines, as_of, fresh_days, span_days)
        .union(cost_checks_seen(spark, seen_decisions, department_cost))
        .union(reason_check(sheet))
        .union(duplicate_check(sheet))
    )
