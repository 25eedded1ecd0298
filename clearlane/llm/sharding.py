"""Even shards by longest processing time first.

Rows with equal texts form a group that stays together. Groups, largest first,
go to the shard with the least bytes so far, which a heap holds on top. At any
size of the data the heap sees a bounded number of items: every group that has
more than 1/``ITEMS`` of all bytes (fewer than ``ITEMS`` by arithmetic) is an
item of its own, and the others are dealt by the hash of their text into
``ITEMS`` bundles, whose sizes are sums that Spark makes. Shards of bundles
differ by about one bundle, 1/``ITEMS`` of all bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 16
ITEMS = 16384
# rows of a shard are numbered in so many parts
PARTS = 64


def longest_first(items: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (item, size): largest first to the least loaded shard; of
    equals, the smaller item and the smaller shard."""
    heap = [(0, shard) for shard in range(shards)]
    heapq.heapify(heap)
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[item] = shard
    return placed


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot and
    grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 1. The law is ``bytes``:
    shards have nearly equal sums of sizes, and a group of equal texts is in one
    shard. A null text counts as empty and shares the group of empty texts.
    ``slot`` numbers the rows of a shard without gaps from 0; rows that share an
    id get slots of their own. ``grown_shard`` is null under this law. An empty
    table gives no rows.
    """
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(_text(docs[text_col])) + 1).cast("long").alias("size"),
        F.crc32(_text(docs[text_col]).cast("binary")).alias("text_crc32"),
        F.xxhash64(_text(docs[text_col])).alias("group"),
        F.sha2(_text(docs[text_col]), 256).alias("text_key"),
    )
    groups = rows.groupBy("text_key", "group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        total = 0
    is_large = F.col("bytes") * F.lit(items) > F.lit(total)
    # negative numbers for the bundles, hashes of large groups made positive
    bundle = -1 - F.pmod(F.col("group"), F.lit(items))
    large = groups.filter(is_large).select("text_key", "bytes").orderBy("text_key").collect()
    bundles = groups.filter(~is_large).groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = longest_first(
        [*((i, r["bytes"]) for i, r in enumerate(large)), *((r["item"], r["bytes"]) for r in bundles)], shards
    )
    spark = docs.sparkSession
    own = spark.createDataFrame([(r["text_key"], placed[i]) for i, r in enumerate(large)], "text_key string, own int")
    of_bundle = spark.createDataFrame([(r["item"], placed[r["item"]]) for r in bundles], "item long, common int")
    # both tables have at most ``items`` rows
    placed_rows = (
        rows.join(F.broadcast(own), "text_key", "left")
        .withColumn("item", bundle)
        .join(F.broadcast(of_bundle), "item", "left")
        .withColumn("shard", F.coalesce("own", "common"))
        .select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    )
    return number_slots(placed_rows)


def number_slots(rows: DataFrame) -> DataFrame:
    """Rows of a shard are numbered within parts, and each part starts where
    the part before it ends, so that no task orders a whole shard."""
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "part"])  # shards * PARTS rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("inside") + F.col("offset")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
