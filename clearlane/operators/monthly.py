"""Figures of whole months that are kept and merged, so that a new extract reads
only the months that are new.

A state has one row per month and group with figures that add up: counts, sums,
and the sum of squared deviations from the month's mean. Merged over months they
are the figures of one pass over all lines. A period that starts or ends inside a
month takes that month from the lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlane import constants as K
from clearlane.functions.columns import safe_ratio
from clearlane.operators.cleaning import clean_referrals
from clearlane.operators.costing import GROUP
from clearlane.operators.staging import new_folder
from clearlane.sources import stores, warehouse
from clearlane.sources.sinks import children, publish, rename, target_exists

MONTH = stores.MONTH
SERVICE_MONTH = warehouse.SERVICE_MONTH
PAIR = ("specialty", "cpt_code")


# --- calendar -----------------------------------------------------------------------


def _instant(text: str) -> datetime:
    return datetime.fromisoformat(text)


def months_of(window: tuple[str, str]) -> list[str]:
    """The months that a closed period touches."""
    first, last = (_instant(x) for x in window)
    at, found = date(first.year, first.month, 1), []
    while at <= last.date():
        found.append(f"{at:%Y-%m}")
        at = (at + timedelta(days=31)).replace(day=1)
    return found


def month_window(month: str) -> tuple[str, str]:
    """The closed period of a month, to its last microsecond."""
    first = datetime.fromisoformat(f"{month}-01")
    last = (first + timedelta(days=31)).replace(day=1) - timedelta(microseconds=1)
    return first.isoformat(" "), last.isoformat(" ")


def whole_months(window: tuple[str, str]) -> list[str]:
    """The months that lie inside a closed period as a whole."""
    first, last = (_instant(x) for x in window)
    inside = []
    for month in months_of(window):
        a, b = (_instant(x) for x in month_window(month))
        if first <= a and b <= last:
            inside.append(month)
    return inside


# --- states ---------------------------------------------------------------------------


def line_state(lines: DataFrame) -> DataFrame:
    """Counts of cleaned lines (with date_received) per month and group."""
    manual = F.col("is_autoapp") == 0
    count = lambda x: F.count(x)
    return lines.groupBy(F.date_format("date_received", "yyyy-MM").alias(MONTH), *GROUP).agg(
        count("units").alias("units"),
        count("is_autoapp").alias("n_auto"),
        F.sum("is_autoapp").cast("long").alias("auto"),
        count("is_den").alias("n_denied"),
        F.sum("is_den").cast("long").alias("denied"),
        count(F.when(manual, F.col("units"))).alias("units_man"),
        count(F.when(manual, F.lit(1))).alias("lines_man"),
    )


def merged_lines(state: DataFrame) -> DataFrame:
    """The columns of ``costing.code_profile`` from a state of any months."""
    total = lambda c: F.sum(c).cast("long")
    added = state.groupBy(*GROUP).agg(*[total(c).alias(c) for c in ("units", "n_auto", "auto", "n_denied", "denied", "units_man", "lines_man")])
    return added.select(
        *GROUP,
        "units",
        safe_ratio(F.col("auto"), F.col("n_auto")).alias("auto_rate"),
        safe_ratio(F.col("denied"), F.col("n_denied")).alias("denial_rate"),
        "units_man",
        "lines_man",
    )


def claim_state(claims: DataFrame) -> DataFrame:
    """Count, sum and squared deviations of cost per service month, specialty and
    code, from ``warehouse.eligible_claims(..., with_month=True)``."""
    return claims.groupBy(SERVICE_MONTH, *PAIR).agg(
        F.count("hcp_cost").alias("n"),
        F.sum("hcp_cost").alias("total"),
        (F.var_pop("hcp_cost") * F.count("hcp_cost")).alias("squares"),
    )


def _combined(a: Column, b: Column) -> Column:
    """Two (n, total, squares) as one. What the means differ by goes to the squares."""
    n = a["n"] + b["n"]
    apart = a["total"] / a["n"] - b["total"] / b["n"]
    return F.struct(
        n.alias("n"),
        (a["total"] + b["total"]).alias("total"),
        (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n).alias("squares"),
    )


def merged_claims(state: DataFrame) -> DataFrame:
    """The columns of ``warehouse.claims_cost_stats`` from a state of any months;
    months are merged in order, so the result is the same each time."""
    part = F.struct(SERVICE_MONTH, F.struct("n", "total", "squares").alias("part"))
    # a row for each month
    months = state.filter("n > 0").groupBy(*PAIR).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    parts = F.transform("parts", lambda x: x["part"])
    kind = "struct<n:bigint,total:double,squares:double>"
    first = F.get(parts, F.lit(0)).cast(kind)
    all_ = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), first, lambda a, b: _combined(a, b).cast(kind))
    return months.withColumn("x", all_).select(
        *PAIR,
        F.col("x.n").alias("cnt_hcp_cost"),
        (F.col("x.total") / F.col("x.n")).alias("avg_hcp_cost"),
        F.when(F.col("x.n") > 1, F.sqrt(F.col("x.squares") / (F.col("x.n") - 1))).alias("sd_hcp_cost"),
    )


# --- stored states ------------------------------------------------------------------------


def stored_months(spark: SparkSession, path: str) -> list[str]:
    if not target_exists(spark, path):
        return []
    return [x.split("=", 1)[1] for x in children(spark, path) if "=" in x]


def _add_months(state: DataFrame, path: str, column: str, months: Sequence[str]) -> list[str]:
    """Write the rows of ``months`` in one job, then give every month its folder.
    A month that another job stored meanwhile is left alone."""
    spark = state.sparkSession
    written = new_folder(spark)
    state.hint("rebalance", column).write.partitionBy(column).parquet(written)
    made = set(children(spark, written))
    added = []
    for month in months:
        name = f"{column}={month}"
        if name in made:
            move = lambda aside, name=name: rename(spark, f"{written}/{name}", aside)
        else:  # a month without rows is known to have none
            move = state.drop(column).limit(0).write.parquet
        if publish(spark, f"{path}/{name}", move):
            added.append(month)
    return added


def add_line_months(spark: SparkSession, lines_path: str, path: str, window: tuple[str, str], rules=None) -> list[str]:
    """Bring the line state up to ``window``: reads the stored lines of its whole
    months that have no state yet, and no others. Returns the months added."""
    known = {*stored_months(spark, path)}
    missing = [m for m in whole_months(window) if m not in known]
    if not missing:
        return []
    lines = stores.read_referral_lines(spark, lines_path, months=missing)
    return _add_months(line_state(clean_referrals(lines, *([] if rules is None else [rules]))), path, MONTH, missing)


def add_claim_months(tables: warehouse.Tables, path: str, window: tuple[str, str]) -> list[str]:
    """The same for the claim state; with a fact stored by service month only the
    missing months are read."""
    spark = tables["fact_claim"].sparkSession
    known = {*stored_months(spark, path)}
    missing = [m for m in whole_months(window) if m not in known]
    if not missing:
        return []
    span = (month_window(missing[0])[0], month_window(missing[-1])[1])
    claims = warehouse.eligible_claims(tables, span, with_month=True).filter(F.col(SERVICE_MONTH).isin(*missing))
    return _add_months(claim_state(claims), path, SERVICE_MONTH, missing)


_LINE_STATE = "specialty string, cpt_code string, is_ppl int, units long, n_auto long, auto long, n_denied long, denied long, units_man long, lines_man long"
_CLAIM_STATE = "specialty string, cpt_code string, n long, total double, squares double"


def _read_state(spark: SparkSession, path: str, columns: str, column: str, months: Sequence[str]) -> DataFrame:
    return spark.read.schema(f"{columns}, {column} string").parquet(path).filter(F.col(column).isin(*months))


def line_profile(spark: SparkSession, lines_path: str, path: str, window: tuple[str, str], rules=None) -> DataFrame:
    """``costing.code_profile`` of a closed period: whole months from the state, at
    most the first and the last month from the stored lines."""
    known = {*stored_months(spark, path)}
    inside = [m for m in whole_months(window) if m in known]
    rest = [m for m in months_of(window) if m not in inside]
    parts = []
    if inside:
        parts.append(_read_state(spark, path, _LINE_STATE, MONTH, inside))
    if rest or not parts:
        lines = stores.read_referral_lines(spark, lines_path, window, months=rest)
        parts.append(line_state(clean_referrals(lines, *([] if rules is None else [rules]))))
    return merged_lines(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def claim_cost_stats(tables: warehouse.Tables, path: str, window: tuple[str, str] = K.CLAIM_WINDOW) -> DataFrame:
    """``warehouse.claims_cost_stats`` of a closed period, whole months from the
    state."""
    spark = tables["fact_claim"].sparkSession
    known = {*stored_months(spark, path)}
    inside = [m for m in whole_months(window) if m in known]
    rest = [m for m in months_of(window) if m not in inside]
    parts = []
    if inside:
        parts.append(_read_state(spark, path, _CLAIM_STATE, SERVICE_MONTH, inside))
    if rest or not parts:
        claims = warehouse.eligible_claims(tables, window, with_month=True, months=rest)
        parts.append(claim_state(claims))
    return merged_claims(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
