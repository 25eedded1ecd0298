"""Exact ranks and quantiles without passing the data through one task."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane.operators.staging import stage


def _ranged(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Range partition once and write the rows with their partition number."""
    return stage(df.repartitionByRange(*order_by).withColumn("__part", F.spark_partition_id()))


def _accumulate(ranged: DataFrame, order_by: Sequence[str], weight: str, out: str) -> DataFrame:
    per_part = ranged.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    # one row per shuffle partition, so this ordering of everything is short
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col("__part"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset")
    )
    inside = (
        Window.partitionBy("__part")
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumn("__inside", F.sum(weight).over(inside))
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .drop("__part", "__inside", "__offset")
    )


def running_total(df: DataFrame, order_by: Sequence[str], weight: str, out: str) -> DataFrame:
    """Inclusive running sum of ``weight`` in the order of ``order_by``, which
    must be a total order.

    Each range partition sums its own rows; the offset of a partition is the
    sum of the earlier ones.
    """
    return _accumulate(_ranged(df, order_by), order_by, weight, out)


def sequence_number(df: DataFrame, order_by: Sequence[str], out: str) -> DataFrame:
    """1, 2, 3, ... in the order of ``order_by``."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), order_by, "__one", out).drop(
        "__one"
    )


# size of a sketch, and the share of ranks that its answers are surely off by less
# than; an answer that is off by more is noticed and asked again with more room
SKETCH = 16_384
ROOM = 0.001


def _values(df: DataFrame, column: str) -> DataFrame:
    """The numbers in ``column``; null and NaN are none."""
    value = F.col(column).cast("double")
    return df.withColumn("__value", value).filter(F.col("__value").isNotNull() & ~F.isnan("__value"))


def quantile_sketches(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, sketch): a summary of the values of ``column`` that can be merged, for
    example one for each month, so that a new month is the only one to be read."""
    return _values(df, column).groupBy(*by).agg(F.kll_sketch_agg_double("__value", F.lit(SKETCH)).alias("sketch"))


def merged_sketch(sketches: DataFrame) -> bytes:
    """One sketch of all, some tens of kB; of no sketches, one of no values."""
    return sketches.agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch")).first()["sketch"]


def _brackets(one: DataFrame, total: int, positions: Sequence[float], room: float) -> list[tuple[float, float]]:
    """Disjoint brackets around the positions, from a frame with one ``sketch``."""
    ends = [(max(0.0, p / total - room), min(1.0, (p + 2) / total + room)) for p in positions]
    shares = sorted({x for pair in ends for x in pair})
    marks = one.select(*[F.kll_sketch_get_quantile_double("sketch", F.lit(x)).alias(str(i)) for i, x in enumerate(shares)])
    at = dict(zip(shares, marks.first(), strict=True))
    found: list[tuple[float, float]] = []
    for low, high in ((at[a], at[b]) for a, b in ends):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def quantile_edges(df: DataFrame, column: str, parts: int, sketch: bytes | None = None) -> list[float]:
    """The ``parts - 1`` inner quantile edges of ``column``, linearly
    interpolated; empty without any value. Null and NaN are not values.

    A sketch, made in one pass or merged from stored ones of the same values,
    brackets the wanted ranks. A second pass counts the values between the brackets
    and groups those inside, below a hundredth of the rows, which are then ordered
    and ranked exactly. Equal values are one row. Only figures and the sketch reach
    the driver."""
    spark = df.sparkSession
    sketch = merged_sketch(quantile_sketches(df, column)) if sketch is None else sketch
    one = spark.createDataFrame([(bytearray(sketch),)], "sketch binary")
    total = one.select(F.kll_sketch_get_n_double("sketch")).first()[0]
    if not total:
        return []
    positions = [(total - 1) * (part * (1.0 / parts)) for part in range(1, parts)]
    places = sorted({x for p in positions for x in (math.floor(p), math.ceil(p))})
    room = ROOM
    while True:
        brackets = _brackets(one, total, positions, room)
        value, place = F.col("__value"), None
        # even numbers are the gaps between brackets, odd ones brackets
        for i, (low, high) in enumerate(brackets):
            below, inside = value < low, value <= high
            place = F.when(below, 2 * i) if place is None else place.when(below, 2 * i)
            place = place.when(inside, 2 * i + 1)
        rows = _values(df, column).select("__value", place.otherwise(2 * len(brackets)).alias("place"))
        kept = F.when(F.col("place") % 2 == 1, F.col("__value")).alias("value")
        counted = stage(rows.groupBy("place", kept).agg(F.count(F.lit(1)).alias("n")))
        sizes = {r["place"]: r["n"] for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect()}
        if sum(sizes.values()) != total:
            raise ValueError("the sketch is not one of these values")
        before = {i: sum(n for k, n in sizes.items() if k < i) for i in range(2 * len(brackets) + 1)}
        of = {x: next((i for i in range(1, 2 * len(brackets), 2) if before[i] <= x < before[i] + sizes.get(i, 0)), None) for x in places}
        if None not in of.values():
            break
        room *= 8
    ranged = _ranged(counted.filter("place % 2 = 1").select("place", "value", "n"), ["value"])
    ranked = _accumulate(ranged, ["value"], "n", "upto")
    gaps = {i: sum(n for k, n in sizes.items() if k < i and k % 2 == 0) for i in set(of.values())}
    wanted = [
        F.min(F.when((F.col("place") == of[x]) & (F.col("upto") + gaps[of[x]] > x), F.col("value"))).alias(str(x)) for x in places
    ]
    found = dict(zip(places, ranked.agg(*wanted).first(), strict=True))

    def interpolate(at: float) -> float:
        low, high = found[math.floor(at)], found[math.ceil(at)]
        share = at - math.floor(at)
        if share < 0.5:
            return low + (high - low) * share
        return high - (high - low) * (1 - share)

    return [interpolate(p) for p in positions]


def quantile_bin(df: DataFrame, column: str, parts: int, out: str, sketch: bytes | None = None) -> DataFrame:
    """Number (0-based) of the value-quantile bin of ``column``: equal values
    always share a bin, a bin includes its upper edge, null and NaN have none
    and repeated edges merge."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    above = F.lit(0)
    for edge in quantile_edges(df, column, parts, sketch):
        above = above + F.when(value > edge, 1).otherwise(0)
    return df.withColumn(out, F.when(value.isNotNull(), above))
