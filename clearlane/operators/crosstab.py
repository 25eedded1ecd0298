"""Cross-tabulations with margins, in long form.

A row of the result is one cell: the keys as text, ``All`` marking a margin,
and the measures. The data is grouped to cells once; margins are grouping sets
over the cells, so the input is not expanded. Rows with a missing key are in
no cell and no margin. Empty cells have no row, except where stated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane import constants as K


def margin_table(
    df: DataFrame,
    keys: Sequence[str],
    margins: Sequence[Sequence[str]],
    measures: Mapping[str, Column],
) -> DataFrame:
    """``measures`` are counts or sums, so cells add up to margins. ``margins``
    lists the grouping sets next to the full one; an empty set is the grand
    total."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    cells = df.filter(complete).groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    sets = [list(keys), *[list(m) for m in margins]]
    return (
        cells.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
        .agg(*[F.sum(n).alias(n) for n in measures])
        .select(
            *[F.coalesce(F.col(k).cast("string"), F.lit(K.ALL)).alias(k) for k in keys], *measures
        )
        # without any cell the grand total is not a row either
        .filter(F.col(next(iter(measures))).isNotNull())
    )


def _crossed(a: str, b: str) -> list[list[str]]:
    return [[a], [b], []]


def auto_by_denied(lines: DataFrame) -> DataFrame:
    """Automatic approval and denial, with a grand total."""
    return margin_table(
        lines, ["is_autoapp", "is_den"], [[]], {"n": F.count("auth_number")}
    )


def referrals_by_decision(referrals: DataFrame) -> DataFrame:
    """Referrals by new decision and share of denied lines, with margins."""
    return margin_table(
        referrals, ["aa_yn", "denial_rate"], _crossed("aa_yn", "denial_rate"),
        {"n": F.count("auth_number")},
    )


def _lines_with_decision(lines: DataFrame, *flags: str) -> DataFrame:
    """Lines counted per referral and values of the 0/1 columns ``flags``, with
    the referral's decision. One grouping by referral counts every combination
    of flags, so there is one shuffle, combined before it, and a referral number
    shared by many lines is one row. Lines without a number have no decision."""
    values = list(product((0, 1), repeat=len(flags)))

    def cell(chosen: Sequence[int]) -> Column:
        here = F.lit(True)
        for name, value in zip(flags, chosen, strict=True):
            here = here & (F.col(name).cast("int") == value)
        return here

    measures = {"units": "units", "codes": "cpt_code", "numbers": "auth_number"}
    counted = (
        lines.filter(F.col("auth_number").isNotNull())
        .groupBy("auth_number")
        .agg(
            F.min("auto_approvable").alias("aa_yn"),
            *[
                F.struct(
                    *[F.lit(v).alias(f) for f, v in zip(flags, chosen, strict=True)],
                    *[F.count(F.when(cell(chosen), F.col(c))).alias(m) for m, c in measures.items()],
                ).alias(f"cell_{i}")
                for i, chosen in enumerate(values)
            ],
        )
    )
    each = counted.select("aa_yn", F.explode(F.array(*[f"cell_{i}" for i in range(len(values))])).alias("c"))
    # a combination that a referral does not have is no cell
    return each.filter("c.numbers > 0").select("aa_yn", "c.*")


def _lines_by_value(lines: DataFrame, key: str) -> DataFrame:
    """The same for a column with any values: counted per referral and value
    first, so the rows that meet for the decision are few."""
    counted = (
        lines.filter(F.col("auth_number").isNotNull())
        .groupBy("auth_number", key)
        .agg(F.count(F.lit(1)).alias("numbers"), F.min("auto_approvable").alias("__least"))
    )
    whole = Window.partitionBy("auth_number")
    return counted.withColumn("aa_yn", F.min("__least").over(whole)).drop("__least")


def old_by_new(lines: DataFrame) -> DataFrame:
    """Old status (rows) by new decision (columns), with margins. Takes lines
    with ``auto_approvable``, as do the next two."""
    rows = ["is_autoapp", "is_den"]
    return margin_table(
        _lines_with_decision(lines, *rows), [*rows, "aa_yn"], [rows, ["aa_yn"], []],
        {"n": F.sum("units")},
    )


def lines_by_decision(lines: DataFrame) -> DataFrame:
    return margin_table(
        _lines_with_decision(lines, "is_den"), ["aa_yn", "is_den"], _crossed("aa_yn", "is_den"),
        {"n": F.sum("codes")},
    )


def lines_by_priority(lines: DataFrame) -> DataFrame:
    return margin_table(
        _lines_by_value(lines, "urgent"), ["aa_yn", "urgent"], _crossed("aa_yn", "urgent"),
        {"n": F.sum("numbers")},
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    return margin_table(decisions, ["final_decision"], [[]], {"n": F.count("cpt_code")})


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their frequency, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(column))
    )
