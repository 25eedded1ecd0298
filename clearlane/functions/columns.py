"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def in_list(column: Column, values: Iterable[str]) -> Column:
    return column.isin(*values)


def not_in_list(column: Column, values: Iterable[str]) -> Column:
    """Membership test in which a null value counts as not listed."""
    return F.coalesce(~column.isin(*values), F.lit(True))


def replace_values(column: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary replacement; values without an entry, and null, are kept."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(lookup[column], column)


def split_by_lob(
    specialty: Column, lob: Column, specialties: Iterable[str], suffixes: Mapping[str, str]
) -> Column:
    """Append the line-of-business suffix to the listed specialties. A missing
    line of business makes the specialty unknown (null)."""
    with_suffix = F.concat(specialty, replace_values(lob, suffixes))
    return F.when(in_list(specialty, specialties), with_suffix).otherwise(specialty)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def whole_days(span: Column) -> Column:
    """Complete 24-hour days in a day-time interval."""
    return F.extract(F.lit("DAY"), span)
