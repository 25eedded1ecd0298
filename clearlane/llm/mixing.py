"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, at most ``MOST`` times
what it has; what is above goes to the others by weight. A document of a source
is wanted target / source size times. The whole part is taken outright. The
fractional parts are rounded in pairs: words are moved from one document of the
pair to the other, in a random direction with probabilities that keep every
expectation, until one of them is wanted 0 or 1 times more. So the words of a
source never change but for one last document.

The pairs form a reduction tree. Documents of a source are dealt into blocks of
about ``BLOCK`` by a hash; one fold over a block's array leaves one undecided
document, and the undecided ones are the input of the next level. All of it are
DataFrame functions; random numbers are hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane.operators.staging import stage_table

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 256
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(*parts: Column | int) -> Column:
    """In [0, 1), from a hash."""
    columns = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, target) from rows of (source, size).

    Weights repeat over the sources in code point order, null last. The targets
    are min(most * size, level * weight) for the one level at which they sum to
    all words. Over the sources by ascending most * size / weight, the level
    that follows if exactly the earlier ones were full is highest at the right
    place. The window is over one row for each source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    full = F.lit(float(most)) * F.col("source_size")
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - earlier("full")) / (F.sum("weight").over(everything) - earlier("weight"))
    return (
        per_source.withColumn("weight", weight)
        .withColumn("full", full)
        .withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "docs", F.least("full", F.col("level") * F.col("weight")).alias("target"))
    )


def _pivot(state: Column, other: Column) -> Column:
    """One pair: the document carried so far and the next one."""
    s1, p1, s2, p2 = state["size"], state["p"], other["size"], other["p"]
    to_first = F.least((1 - p1) * s1, p2 * s2)
    to_second = F.least((1 - p2) * s2, p1 * s1)
    first_grows = other["u"] * (to_first + to_second) < to_second
    carried = state["doc"]
    first_done = F.when(first_grows, (1 - p1) * s1 <= p2 * s2).otherwise((1 - p2) * s2 > p1 * s1)
    rest = (
        F.when(first_grows & first_done, p2 - to_first / s2)
        .when(first_grows, p1 + to_first / s1)
        .when(first_done, p2 + to_second / s2)
        .otherwise(p1 - to_second / s1)
    )
    decided = F.struct(
        F.when(first_done, carried).otherwise(other["doc"]).alias("doc"),
        F.when(first_done, s1).otherwise(s2).alias("size"),
        # a document ends at 1 if the words went to it, else at 0
        (first_grows == first_done).cast("int").alias("up"),
    )
    return F.struct(
        F.when(first_done, other["doc"]).otherwise(carried).alias("doc"),
        F.when(first_done, s2).otherwise(s1).alias("size"),
        F.greatest(F.least(rest, F.lit(1.0)), F.lit(0.0)).alias("p"),
        F.concat(state["decided"], F.array(decided)).alias("decided"),
    )


def _reduce_level(rows: DataFrame, id_type: str, level: int) -> DataFrame:
    """Rows (source, block, doc, size, p) to rows with ``up`` decided, and one
    undecided (null) for each source and block. Largest documents go first, so
    that what stays undecided is mostly small."""
    element = F.struct(
        (-F.col("size")).alias("order"),
        F.xxhash64(F.lit(SEED), "doc").alias("tie"),
        "doc",
        "size",
        "p",
        _uniform(SEED, level, F.col("doc")).alias("u"),
    )
    first = F.col("items")[0]
    start = F.struct(
        first["doc"].alias("doc"),
        first["size"].alias("size"),
        first["p"].alias("p"),
        F.array().cast(f"array<struct<doc:{id_type},size:double,up:int>>").alias("decided"),
    )
    folded = (
        rows.groupBy("source", "block")
        .agg(F.array_sort(F.collect_list(element)).alias("items"))
        .select("source", "block", F.aggregate(F.expr("slice(items, 2, size(items))"), start, _pivot).alias("s"))
    )
    left = F.struct(F.col("s.doc").alias("doc"), F.col("s.size").alias("size"), F.lit(None).cast("int").alias("up"))
    return folded.select(
        "source", "block", F.col("s.p").alias("p"), F.explode(F.concat("s.decided", F.array(left))).alias("x")
    ).select("source", "block", "x.doc", "x.size", "x.up", "p")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    ``size`` is the number of words (0 for null), ``taken`` is size * copies.
    Rows with a null source are a source of their own. Documents without words
    are taken as often as their source's whole part, for 0 words. Rows that share
    an id are rounded each on its own, but their blocks hold them together. If
    no document has a word, all targets are 0. An empty table gives no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    sized = docs.select(
        docs[id_col].alias("doc"),
        docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = stage_table(sized)
    targets = stage_table(source_targets(sized, weights, most))
    wanted = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .select("doc", sized["source"], "size", "docs", "target", "source_size")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("whole"))
    )
    undecided = (F.col("p") > 0) & (F.col("size") > 0)
    certain = wanted.filter(~undecided).select("doc", "source", "size", F.lit(0).alias("up"))
    largest = targets.agg(F.max("docs")).first()[0] or 0
    blocks = -(-largest // block)  # of the largest source
    rows = wanted.filter(undecided).select(
        "source",
        F.pmod(F.xxhash64(F.lit(SEED + 1), "doc"), F.ceil(F.col("docs") / block)).alias("block"),
        "doc",
        F.col("size").cast("double").alias("size"),
        "p",
    )
    parts, level = [certain], 0
    while True:
        done = stage_table(_reduce_level(rows, id_type, level))
        parts.append(done.filter("up IS NOT NULL").select("doc", "source", F.col("size").cast("long"), "up"))
        rest = done.filter("up IS NULL")
        if blocks <= 1:
            # one document of a source is left; the nearer end is taken
            parts.append(rest.select("doc", "source", F.col("size").cast("long"), (F.col("p") >= 0.5).cast("int").alias("up")))
            break
        blocks, level = -(-blocks // block), level + 1
        rows = rest.select("source", F.pmod("block", F.lit(blocks)).alias("block"), "doc", "size", "p")
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.union(part)
    copies = (F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)) + F.col("up")).cast("long")
    return (
        decided.join(targets, decided["source"].eqNullSafe(targets["source"]))
        .select(F.col("doc").alias("doc_id"), "size", "source_size", "target", copies.alias("copies"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed``, their mixture, takes them.

    Rows that share an id are all taken as often as the one of them that is
    taken most, and so are rows without an id.
    """
    times = mixed.groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("mixed_times"))
    return (
        docs.join(times, docs[id_col].eqNullSafe(times["mixed_id"]))
        .filter("mixed_times > 0")
        .withColumn("mixed_times", F.explode(F.expr("sequence(1, mixed_times)")))
        .select(*[docs[c] for c in docs.columns])
    )
