"""Near duplicates by MinHash with sequential Bayesian verification.

1. Every document gets the number of its distinct shingles, a 128-bit hash of
   the set and ``HASHES`` minimum hashes. Documents with equal sets are one
   class; only its first document goes on.
2. Bands of ``ROWS`` minimum hashes make buckets. In each bucket, members are
   compared with its first document, then the first documents of the components
   that are still apart, and at last all members that are still in different
   components. Members that are connected already are never paired, so a group
   of thousands of near copies costs a pair for each member and band. Two bounds
   that lose no link keep the last step small: members with too many shingles of
   their own to be linked to any other component are left out, and a pair is only
   made if the parities of its sets allow the threshold. The parity of a set has
   ``PARITY_BITS`` bits, each the number of its shingles with one hash modulo 2, so
   two sets differ in at least as many shingles as their parities do in bits.
3. Candidate pairs are judged on batches of ``BATCH`` minimum hashes. With a
   uniform prior the similarity after m of n agreements is Beta(m + 1,
   n - m + 1); a pair whose probability of reaching the threshold falls below
   ``MISS`` is dropped.
4. Survivors are verified on their full shingle sets.
5. Components come from alternating star contractions with every step
   checkpointed; no link reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane.llm import tokens as T
from clearlane.operators.staging import stage, stage_table

SHINGLE = 5
THRESHOLD = 85  # percent
ROWS, BANDS = 5, 20
HASHES = ROWS * BANDS
BATCH = 20
MISS = 1e-7
PARITY_BITS = 2048

_multiplier = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text (with repeats) and their offsets. A
    text with fewer words is one shingle; without words it has none."""
    w = T.words(column, lower=True)
    per_doc = np.diff(w.first)
    if not w.n:
        return np.zeros(0, np.uint64), np.zeros(len(per_doc) + 1, np.int64)
    g = w.hashes()
    n = np.where(per_doc >= size, per_doc - size + 1, np.minimum(per_doc, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(offsets[-1]) - offsets[doc] + w.first[doc]
    end = np.minimum(start + size, w.first[doc + 1])
    rolling = T.Rolling(g, T.BASES[1])
    return T.mix(rolling.of(start, end) + (end - start).astype(np.uint64)), offsets


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets."""
    hashes, offsets = shingle_hashes(column, size)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, HASHES) minimum hashes; every document has a shingle."""
    out = np.empty((len(offsets) - 1, HASHES), np.uint32)
    starts = offsets[:-1]
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(hashes * _multiplier[k], starts) >> np.uint64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text", 1 << 18):
        hashes, offsets = shingle_sets(batch.column("text"), size)
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        sign = np.zeros((len(n), HASHES), np.uint32)
        sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
        if len(full):
            starts = np.append(offsets[:-1][full], offsets[-1])
            sign[full] = signatures(hashes, starts)
            for k, total in enumerate(sums):
                total[full] = np.add.reduceat(T.mix(hashes ^ np.uint64(T.BASES[k])), starts[:-1])
        width = pa.binary(HASHES * 4)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n.astype(np.int64)),
                pa.array(T.signed(sums[0])),
                pa.array(T.signed(sums[1])),
                pa.FixedSizeBinaryArray.from_buffers(width, len(n), [None, pa.py_buffer(sign.tobytes())]).cast(pa.binary()),
            ],
            names=["doc_id", "n_shingles", "s1", "s2", "sign"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = _binary(column)
    return data.view(np.uint32).reshape(-1, HASHES)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buffers = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.ascontiguousarray(np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]), offsets


def _bands(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    bands = HASHES // rows
    for batch in batches:
        if not batch.num_rows:
            continue
        sign = _matrix(batch.column("sign")).astype(np.uint64)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = np.zeros((len(ids), bands), np.uint64)
        for row in range(rows):
            keys = T.mix(keys * np.uint64(31) + sign[:, row : rows * bands : rows] + np.arange(bands, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(T.signed(keys.ravel())), pa.array(np.repeat(ids, bands))], names=["bucket", "doc_id"]
        )


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """For each batch end n, the fewest agreements that keep a pair: the
    posterior probability of the threshold, P(Beta(m + 1, n - m + 1) >= t) =
    P(Binomial(n + 1, t) <= m), is at least ``miss``."""
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append((n, m))
    return found


def _prune(batches: Iterator[pa.RecordBatch], least: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch.column("sign_x")), _matrix(batch.column("sign_y"))
        live = np.arange(batch.num_rows)
        agree = np.zeros(batch.num_rows, np.int64)
        for n, m in least:
            agree[live] += (x[live, n - BATCH : n] == y[live, n - BATCH : n]).sum(axis=1)
            live = live[agree[live] >= m]
        yield batch.select(["x", "y"]).take(pa.array(live))


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text_y", 1 << 20):
        sets = []
        for name in ("text_x", "text_y"):
            hashes, offsets = shingle_sets(batch.column(name), size)
            sets.append([hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        linked = []
        for i, (a, b) in enumerate(zip(*sets, strict=True)):
            common = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * common >= percent * (len(a) + len(b) - common):
                linked.append(i)
        yield batch.select(["x", "y"]).take(pa.array(linked, pa.int64()))


def _links(pairs: DataFrame, signs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are similar on their full sets."""
    sx = signs.select(F.col("doc_id").alias("x"), F.col("sign").alias("sign_x"), F.col("n_shingles").alias("nx"))
    sy = signs.select(F.col("doc_id").alias("y"), F.col("sign").alias("sign_y"), F.col("n_shingles").alias("ny"))
    sized = (
        pairs.join(sx, "x")
        .join(sy, "y")
        .filter(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
        .select("x", "y", "sign_x", "sign_y")
    )
    likely = sized.mapInArrow(partial(_prune, least=least_matches(percent / 100)), "x long, y long")
    tx = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x"))
    ty = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y"))
    return (
        likely.join(ty, "y")
        .join(tx, "x")
        .select("x", "y", "text_x", "text_y")
        .mapInArrow(partial(_verify, size=size, percent=percent), "x long, y long")
    )


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every end of the links (x, y); the component
    is its smallest end. Large-star and small-star steps alternate until the
    links point at the smallest end only; each step is checkpointed."""
    edges = stage(links.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).filter("v <> u").distinct())
    while True:
        # large star: every larger neighbour of a node is linked to its least neighbour
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .filter("v <> u")
            .distinct()
        )
        after = stage(small)
        # done when each node has one link, and to a node that has none upwards
        several = after.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        chained = after.select(F.col("u").alias("v")).distinct().join(after.select("v").distinct(), "v").limit(1)
        edges = after
        if not several.union(chained.withColumn("n", F.lit(0).cast("long"))).count():
            break
    roots = edges.select(F.col("u").alias("doc_id"), F.col("u").alias("component_id")).distinct()
    return edges.select(F.col("v").alias("doc_id"), F.col("u").alias("component_id")).union(roots)


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return members.withColumn("label", F.col("doc_id"))
    return (
        members.join(components(links), "doc_id", "left")
        .withColumn("label", F.coalesce("component_id", "doc_id"))
        .drop("component_id")
    )


def _divided(labelled: DataFrame) -> DataFrame:
    """Buckets whose members have more than one label."""
    return (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .filter("lo < hi")
        .select("bucket")
    )


def _star(labelled: DataFrame) -> DataFrame:
    """In each bucket, the first member of every label with the first of all."""
    firsts = labelled.groupBy("bucket", "label").agg(F.min("doc_id").alias("y"))
    hubs = firsts.groupBy("bucket").agg(F.min("y").alias("x"))
    return firsts.join(hubs, "bucket").filter("x < y").select("x", "y").distinct()


def _explode_shingles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text", 1 << 20):
        hashes, offsets = shingle_sets(batch.column("text"), size)
        doc = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(T.signed(hashes)), batch.column("doc_id").take(doc), batch.column("label").take(doc)],
            names=["shingle", "doc_id", "label"],
        )


def _parities(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words = PARITY_BITS // 64
    for batch in T.slices(batches, "text", 1 << 20):
        hashes, offsets = shingle_sets(batch.column("text"), size)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        bit = (T.mix(hashes) % np.uint64(PARITY_BITS)).astype(np.int64)
        odd = (np.bincount(doc * PARITY_BITS + bit, minlength=batch.num_rows * PARITY_BITS) & 1).astype(np.uint8)
        packed = np.packbits(odd).view(np.int64)
        bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(packed))], names=["doc_id", "parity"])


def _reach(labelled: DataFrame, signs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, reach, parity): the largest partner of another component that a
    member of a divided bucket can be linked to. Only shingles that some other
    component among these members has can be common, so with m of them a link
    needs 100 m >= percent (n + partner - m)."""
    each = stage_table(labelled.select("doc_id", "label").distinct())
    own = texts.join(each.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "label")
    shingles = own.mapInArrow(partial(_explode_shingles, size=size), "shingle long, doc_id long, label long")
    common = (
        shingles.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("shingle")
    )
    counted = shingles.join(common, "shingle").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    sizes = signs.groupBy("doc_id").agg(F.min("n_shingles").alias("n"))
    parities = own.select("doc_id", "text").mapInArrow(partial(_parities, size=size), "doc_id long, parity array<long>")
    first, last = F.min("parity"), F.max("parity")
    parities = parities.groupBy("doc_id").agg(F.when(first == last, first).alias("parity"))
    # for rows that share an id, the smallest size, all common shingles, no parity
    return counted.join(sizes, "doc_id").join(parities, "doc_id").select(
        "doc_id", "n", F.floor(F.col("m") * (100 + percent) / percent - F.col("n")).alias("reach"), "parity"
    )


def _crossing(labelled: DataFrame, signs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of members of a bucket that have different labels and can be linked
    by the number of shingles they share with others, and by their parities."""
    reach = stage_table(_reach(labelled, signs, texts, size, percent))
    sized = labelled.join(reach.drop("parity"), "doc_id")
    least = sized.groupBy("bucket").agg(F.min("n").alias("least"))
    able = stage_table(sized.join(least, "bucket").filter("reach >= least").select("bucket", "doc_id", "label", "n", "reach"))
    places = able.join(_divided(able), "bucket")
    # a pair is made where it meets first, not in every bucket it shares; a
    # document has at most as many buckets as there are bands
    own = places.groupBy("doc_id").agg(F.collect_set("bucket").alias("places"))
    keyed = places.join(own, "doc_id").join(reach.select("doc_id", "parity"), "doc_id")
    x, y = (
        keyed.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "label", "n", "reach", "places", "parity")]) for side in "xy"
    )
    apart = F.aggregate(F.zip_with("parity_x", "parity_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    condition = (
        (x["bucket"] == y["bucket"])
        & (F.col("doc_id_x") < F.col("doc_id_y"))
        & (F.col("label_x") != F.col("label_y"))
        & (F.col("n_x") <= F.col("reach_y"))
        & (F.col("n_y") <= F.col("reach_x"))
        # with d shingles that only one of them has, the similarity is (n - d) / (n + d)
        & F.coalesce(apart * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent), F.lit(True))
        & (F.array_min(F.array_intersect("places_x", "places_y")) == x["bucket"])
    )
    return x.join(y, condition).select(F.col("doc_id_x").alias("x"), F.col("doc_id_y").alias("y"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = THRESHOLD,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased for A-Z. Two documents are linked if 100 * common >=
    percent * union holds for their sets of distinct shingles. ``rows`` minimum
    hashes make a band; lower thresholds need fewer (4 for 80 per cent). ``component_id``
    is the smallest id that can be reached over links, ``kept`` says whether it
    is the row's own. A null or empty text has no shingle and no link, fewer
    words than a shingle are one shingle. Rows that share an id share the
    component of all of them; rows without an id are not linked: their
    component is null and they are kept. An empty table gives no rows. A task holds
    the shingles of one text at a time, however long it is.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signs = stage_table(
        base.mapInArrow(partial(_sign, size=shingle), "doc_id long, n_shingles long, s1 long, s2 long, sign binary")
    )
    linkable = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = (
        linkable.select("s1", "s2", "doc_id")
        .join(classes.filter("n > 1").select("s1", "s2", "first"), ["s1", "s2"])
        .filter("doc_id <> first")
        .select(F.col("first").alias("x"), F.col("doc_id").alias("y"))
    )
    firsts = (
        linkable.join(classes.select("s1", "s2", F.col("first").alias("doc_id")), ["s1", "s2", "doc_id"])
        .dropDuplicates(["s1", "s2", "doc_id"])  # rows that repeat as a whole
        .select("doc_id", "n_shingles", "sign")
    )
    bands = firsts.mapInArrow(partial(_bands, rows=rows), "bucket long, doc_id long")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = stage_table(bands.join(shared, "bucket").select("bucket", "doc_id").distinct())
    wanted = members.select("doc_id").distinct()
    texts = stage_table(base.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text"))
    signed = stage_table(firsts.join(wanted, "doc_id"))

    links = stage_table(_links(_star(_labelled(members, None)), signed, texts, shingle, percent))
    for last in (False, True):
        labelled = _labelled(members, links)
        labelled = stage_table(labelled.join(_divided(labelled), "bucket"))
        pairs = _crossing(labelled, signed, texts, shingle, percent) if last else _star(labelled)
        links = links.union(stage_table(_links(pairs, signed, texts, shingle, percent)))
    reached = components(links.union(copies))
    return signs.select("doc_id", "n_shingles").join(reached, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
