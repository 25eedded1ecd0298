"""Fingerprints of documents by SimHash, with DataFrame functions only.

The terms of a text are its pairs of neighbouring words and its last word. Each
occurrence votes, so a term weighs its frequency: for every bit, the ones among
the 64-bit hashes of all occurrences are counted, and the bit is set if they
are the majority. Bits i and i + 32 are counted in the two halves of one long,
so one row adds 32 numbers, in generated code and before any shuffle. Counts
are grouped by the hash of the text: copies multiply all votes by the same
number and leave the signs alone.

``near_fingerprints`` finds all pairs within a Hamming radius by permuted block
tables: with ``blocks`` blocks, two fingerprints that differ in ``radius`` bits
agree on at least ``blocks - radius`` of them, so each choice of so many blocks
is a table, joined on the agreeing bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 64
HALF = 0x0000000100000001
SEPARATOR = r"[\x20\x09-\x0D]+"


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def fingerprints(texts: DataFrame) -> DataFrame:
    """(a, b, bits) for each distinct ``text``; (a, b) is its 128-bit hash.
    Texts without words have no row."""
    split = texts.select(
        F.xxhash64("text").alias("a"),
        F.xxhash64(F.lit(1), "text").alias("b"),
        F.filter(F.split("text", SEPARATOR), lambda w: w != "").alias("words"),
    )
    terms = split.select("a", "b", F.inline(F.arrays_zip(F.col("words").alias("x"), F.expr("slice(words, 2, size(words))").alias("y"))).alias("x", "y"))
    counted = (
        terms.select("a", "b", F.xxhash64("x", "y").alias("h"))
        .groupBy("a", "b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(HALF))).alias(f"c{i}") for i in range(BITS // 2)],
        )
    )
    bits = F.lit(0).cast("long")
    for i in range(BITS // 2):
        low = F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"c{i}", 32)
        for at, ones in ((i, low), (i + BITS // 2, high)):
            bits = bits.bitwiseOR(F.shiftleft((2 * ones > F.col("n")).cast("long"), at))
    return counted.select("a", "b", bits.alias("bits"))


def as_text(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), BITS // 4, "0"))


def likeness(x: Column, y: Column) -> Column:
    return 1 - F.bit_count(x.bitwiseXOR(y)) / F.lit(float(BITS))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``next_text``, the text of the next row by
    (doc_id, text), after the last the first.

    Rows are dealt by ranges of ids into as many parts as a shuffle has, and
    ordered in each part. The first row of a part is also sent to the part
    before, where it comes last. Only one id for each part reaches the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / parts for i in range(1, parts)] or [0.5]
    edges = docs.agg(F.percentile_approx("doc_id", steps, 10 * parts)).first()[0] or []
    edges = sorted(set(edges))
    edge = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<bigint>")
    # the first part that ends at the id or after it; null ids come last
    part = F.when(F.col("doc_id").isNull(), len(edges)).otherwise(F.size(F.filter(edge, lambda e: e < F.col("doc_id"))))
    dealt = docs.withColumn("part", part)
    firsts = sorted((r["part"], r["doc_id"]) for r in dealt.groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect() if r["doc_id"] is not None)
    has_null = bool(docs.filter("doc_id IS NULL").limit(1).count()) and not any(p == len(edges) for p, _ in firsts)
    order = [p for p, _ in firsts] + [len(edges)] * has_null
    sent = [(order[i - 1], p, d) for i, (p, d) in enumerate(firsts)]
    if has_null:
        sent.append((order[-2] if len(order) > 1 else order[-1], len(edges), None))
    to = spark.createDataFrame(sent, "to int, part int, doc_id long")
    first_rows = (
        dealt.join(F.broadcast(to), dealt["part"].eqNullSafe(to["part"]) & dealt["doc_id"].eqNullSafe(to["doc_id"]))
        .groupBy("to", to["doc_id"])
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("sent"))
    )
    all_rows = dealt.select("doc_id", "text", "part", F.lit(0).alias("sent")).union(first_rows)
    ordered = Window.partitionBy("part").orderBy("sent", F.col("doc_id").asc_nulls_last(), "text")
    return all_rows.withColumn("next_text", F.lead("text").over(ordered)).filter("sent = 0").drop("sent", "part")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the
    first as many (or all) of the next document's text. A null text counts as
    empty; a text without words has the fingerprint 0. Rows that share an id are
    ordered by text; rows without one come last. A single row is its own next.
    An empty table gives no rows.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = with_next(base).select(
        "doc_id",
        "text",
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
        "next_text",
    )
    bits = fingerprints(edited.select(F.explode(F.array("text", "edited")).alias("text")))
    rows = edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[f(c).alias(f"{c}_{k}") for c in ("text", "edited", "next_text") for k, f in (("a", lambda c: F.xxhash64(c)), ("b", lambda c: F.xxhash64(F.lit(1), c)))],
    )
    for c in ("text", "edited", "next_text"):
        side = bits.select(F.col("a").alias(f"{c}_a"), F.col("b").alias(f"{c}_b"), F.col("bits").alias(f"{c}_bits"))
        rows = rows.join(side, [f"{c}_a", f"{c}_b"], "left").withColumn(f"{c}_bits", F.coalesce(f"{c}_bits", F.lit(0).cast("long")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("text_bits")).alias("fingerprint"),
        as_text(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("text_bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("text_bits"), F.col("next_text_bits")).alias("near_next"),
    )


def near_fingerprints(bits: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (x, y, distance) of distinct values of the long column ``bits``
    with x < y that differ in at most ``radius`` bits; ``blocks`` > ``radius``.
    Null and repeated values are left out first, so copies make no pairs."""
    distinct = bits.select("bits").filter("bits IS NOT NULL").distinct()
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    tables = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= (1 << BITS) if mask >= 1 << (BITS - 1) else 0
        tables.append(F.struct(F.lit(number).alias("table"), F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    keyed = distinct.select("bits", F.inline(F.array(*tables)))
    x, y = keyed.select("table", "key", F.col("bits").alias("x")), keyed.select("table", "key", F.col("bits").alias("y"))
    return (
        x.join(y, ["table", "key"])
        .filter("x < y")
        .withColumn("distance", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))))
        .filter(F.col("distance") <= radius)
        .select("x", "y", "distance")
        .distinct()
    )
