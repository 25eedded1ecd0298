"""The decision jobs end to end: lines and claims in, decisions out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from clearlane import constants as K
from clearlane.operators.costing import (
    code_cost,
    code_profile,
    known_groups,
    profile_unit_cost,
    review_roi,
)
from clearlane.operators.overrides import Step, apply_plan, start_decisions
from clearlane.operators.staging import stage, stage_table


@dataclass(frozen=True)
class Decisions:
    """Decisions per (specialty, code, in network) and the cost of reviewing
    one line."""

    table: DataFrame
    unit_cost: float | None


def analyse(
    lines: DataFrame,
    claims: DataFrame,
    department_cost: float = K.DEPARTMENT_COST,
    unit_cost: float | None = None,
) -> Decisions:
    """Return on review per group from cleaned lines. The lines are read once;
    their grouped profile is staged because both the unit cost and the groups
    come from it. ``unit_cost`` overrides the computed cost."""
    profile = stage(code_profile(lines))
    cost = profile_unit_cost(profile, department_cost) if unit_cost is None else unit_cost
    return Decisions(review_roi(code_cost(known_groups(profile), claims), cost), cost)


def decide(
    lines: DataFrame,
    claims: DataFrame,
    plan: Sequence[Step],
    sheets: Mapping[str, DataFrame],
    department_cost: float = K.DEPARTMENT_COST,
    unit_cost: float | None = None,
    low_volume: int = K.LOW_VOLUME,
) -> Decisions:
    """Analysis, then the ordered overrides of ``plan``. The result is staged:
    allow-list, line costs and reports all read it."""
    analysed = analyse(lines, claims, department_cost, unit_cost)
    final = apply_plan(start_decisions(analysed.table), plan, sheets, low_volume)
    return Decisions(stage_table(final), analysed.unit_cost)
