"""Hard negatives by summaries of vector segments.

A vector is cut into 1, 2, 4, ... segments, and for each the mean and the
deviation of its components are stored. For two vectors and segments of s
components, the inner product is s * (mean * mean) plus a rest of at most
s * (deviation * deviation), so the summaries bound a score from both sides. Pairs
that no bound can decide are looked at with segments half as long, and only those
left after the shortest segments are scored exactly.

Anchors are a stated set of queries against all rows. They are taken in blocks of
bounded bytes, and a block is sent to all tasks, which read the stored rows and
keep, for every anchor, the few best of theirs; a window joins these. A first pass
finds the positives, whose scores are the limits of the second one. Lower limits
rise while a task reads, so bounds leave out ever more rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clearlane.operators.staging import stage_table

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# per cent of the positive's score that a negative's score lies between
AT_LEAST, AT_MOST = 50, 95
# components of larger size have no exact score in 64 bits
LARGEST = 1 << 23
SHORTEST = 4  # components of the shortest segments
# bytes of the vectors and summaries of a block of anchors, and their number
BLOCK_BYTES = 8 << 20
BLOCK = 1024
ROWS = 512  # rows scored at once
# below this share of open pairs they are looked at one by one
FEW = 0.2
NOTHING = np.iinfo(np.int64).min
_STORED = "vec_id long, label string, dim int, vector binary, summary binary"


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    found, n = [1], 2
    while dim // n >= SHORTEST:
        found.append(n)
        n *= 2
    return found


def summaries(vectors: np.ndarray) -> np.ndarray:
    """For each row the means, then the deviations, of all levels, times the root
    of the length of their segment. Deviations are rounded up."""
    n, dim = vectors.shape
    means, deviations = [], []
    x = vectors.astype(np.float64)
    for count in levels(dim) if dim else []:
        bounds = np.arange(count) * dim // count
        lengths = np.diff(np.append(bounds, dim))
        mean = np.add.reduceat(x, bounds, axis=1) / lengths
        spread = x - np.repeat(mean, lengths, axis=1)
        means.append(mean * np.sqrt(lengths))
        deviations.append(np.sqrt(np.add.reduceat(spread * spread, bounds, axis=1)) * (1 + 1e-9))
    return np.concatenate([*means, *deviations], axis=1) if means else np.zeros((n, 0))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector")
        dims = np.diff(column.offsets.to_numpy())
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            part = batch.take(pa.array(mine))
            vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(mine), dim)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id"),
                    part.column("label"),
                    pa.array(np.full(len(mine), dim, np.int32)),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array([v.tobytes() for v in summaries(vectors)], pa.binary()),
                ],
                names=["vec_id", "label", "dim", "vector", "summary"],
            )


def stored_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vector, summary) of the rows (vec_id, label, values)
    that take part, as a stored table. ``values`` are doubles."""
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / SCALE))
    whole = F.transform("values", lambda x: F.floor(x * SCALE))
    good = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND values IS NOT NULL").filter(finite)
    return stage_table(good.select("vec_id", "label", whole.alias("vector")).mapInArrow(_summarised, _STORED))


@dataclass(frozen=True)
class Block:
    """Rows of one dimension."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    summary: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, dim: int) -> Block:
        def matrix(name: str, kind: type) -> np.ndarray:
            data = b"".join(batch.column(name).to_pylist())
            return np.frombuffer(data, kind).reshape(batch.num_rows, -1) if data else np.zeros((batch.num_rows, 0), kind)

        return cls(
            np.array(batch.column("vec_id").to_pylist(), np.int64),
            np.array(batch.column("label").to_pylist(), object),
            matrix("vector", np.int32),
            matrix("summary", np.float64),
        )

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]

    @property
    def size(self) -> np.ndarray:
        """Length of each vector."""
        return np.hypot(*(x[:, 0] for x in self.part(1))) if self.dim else np.zeros(len(self.ids))

    def part(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations of the level with ``count`` segments."""
        half = self.summary.shape[1] // 2
        at = count - 1  # 1 + 2 + 4 + ... before it
        return self.summary[:, at : at + count], self.summary[:, half + at : half + at + count]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:  # all sums are whole numbers that doubles hold
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def open_scores(anchors: Block, rows: Block, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the ``allowed`` pairs, without those whose bounds
    say that the score is below ``least`` or above ``most`` of the anchor."""
    least, most = least.astype(np.float64), most.astype(np.float64)
    still = allowed
    # more than what sums of doubles can be off
    spare_a, spare_r = 1e-9 * anchors.size, rows.size
    for number, count in enumerate(levels(anchors.dim) if anchors.dim else []):
        if still.mean() < FEW:
            break
        (am, ad), (rm, rd) = anchors.part(count), rows.part(count)
        middle, rest = am @ rm.T, ad @ rd.T
        rest += np.outer(spare_a, spare_r) + 1e-3
        still = still & (middle + rest >= least[:, None]) & (middle - rest <= most[:, None])
    else:
        number = len(levels(anchors.dim))
    a, r = np.nonzero(still)
    for count in levels(anchors.dim)[number:] if anchors.dim else []:
        if not len(a):
            break
        (am, ad), (rm, rd) = anchors.part(count), rows.part(count)
        middle, rest = np.einsum("ij,ij->i", am[a], rm[r]), np.einsum("ij,ij->i", ad[a], rd[r])
        rest += spare_a[a] * spare_r[r] + 1e-3
        kept = (middle + rest >= least[a]) & (middle - rest <= most[a])
        a, r = a[kept], r[kept]
    if len(a) > FEW * still.size:
        return a, r, exact(anchors.vectors, rows.vectors)[a, r]
    x, y = anchors.vectors[a].astype(np.int64), rows.vectors[r].astype(np.int64)
    return a, r, np.einsum("ij,ij->i", x, y)


def _best(slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` highest scores of each slot, ties to smaller ids."""
    order = np.lexsort((vec_id, -score, slot))
    ordered = slot[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < keep]


@dataclass(frozen=True)
class Slots:
    """Places to fill: the anchor, and the limits of a score. ``same`` says
    whether rows need the anchor's label or another one."""

    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    keep: int
    same: bool


def _search(batches: Iterator[pa.RecordBatch], block, slots) -> Iterator[pa.RecordBatch]:
    """(slot, score, vec_id): the best rows of a task for every slot."""
    anchors, places = block.value, slots.value
    n = len(anchors.ids)
    best = [np.zeros(0, np.int64) for _ in range(3)]  # slot, score, vec_id
    least = places.least.copy()
    known = {label: code for code, label in enumerate(dict.fromkeys(anchors.labels))}
    label = np.array([known[x] for x in anchors.labels], np.int64)
    by_anchor = np.argsort(places.anchor, kind="stable")
    first = np.searchsorted(places.anchor[by_anchor], np.arange(n + 1))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = Block.of(batch.slice(at, ROWS), anchors.dim)
            same = label[:, None] == np.array([known.get(x, -1) for x in rows.labels], np.int64)[None, :]
            allowed = same & (anchors.ids[:, None] != rows.ids[None, :]) if places.same else ~same
            lowest, highest = np.full(n, np.iinfo(np.int64).max), np.full(n, NOTHING)
            np.minimum.at(lowest, places.anchor, least)
            np.maximum.at(highest, places.anchor, places.most)
            allowed &= (lowest <= highest)[:, None]
            a, r, score = open_scores(anchors, rows, allowed, lowest, highest)
            # each pair for each slot of its anchor
            times = first[a + 1] - first[a]
            of = np.repeat(np.arange(len(a)), times)
            slot = by_anchor[first[a][of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)]
            fits = (score[of] >= least[slot]) & (score[of] <= places.most[slot])
            slot, of = slot[fits], of[fits]
            found = [np.concatenate(x) for x in zip(best, (slot, score[of], rows.ids[r[of]]), strict=True)]
            kept = _best(*found, places.keep)
            best = [x[kept] for x in found]
            # a full slot needs no row below its last one
            full = np.bincount(best[0], minlength=len(least)) == places.keep
            last = np.full(len(least), np.iinfo(np.int64).max)
            np.minimum.at(last, best[0], best[1])
            least = np.where(full, np.maximum(least, last), least)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["slot", "score", "vec_id"])


def _run(rows: DataFrame, block, slots: Slots) -> DataFrame:
    """(slot, place, score, vec_id) over all rows, stored."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(slots)
    found = rows.mapInArrow(partial(_search, block=block, slots=sent), "slot long, score long, vec_id long")
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "vec_id")
    found = stage_table(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= slots.keep))
    sent.destroy()
    return found


def _limits(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest whole score between the two shares of ``score``."""
    low, high = Fraction(AT_LEAST, 100), Fraction(AT_MOST, 100)
    return -(-low.numerator * score // low.denominator), high.numerator * score // high.denominator


def _mine(rows: DataFrame, anchors: Block) -> DataFrame:
    """The triples of a block of anchors, whose rows have its dimension."""
    context = rows.sparkSession.sparkContext
    block = context.broadcast(anchors)
    n = len(anchors.ids)
    wide = np.iinfo(np.int64).max
    every = Slots(np.arange(n), np.full(n, NOTHING + 1), np.full(n, wide), POSITIVES, True)
    found = _run(rows, block, every).orderBy("slot", "place").toArrow()  # at most POSITIVES for each anchor of a block
    anchor, positive, score = (found.column(c).to_numpy() for c in ("slot", "vec_id", "score"))
    least, most = _limits(score)
    negatives = _run(rows, block, Slots(anchor, least, most, NEGATIVES, False))
    block.destroy()
    pairs = pa.table(
        {"slot": np.arange(len(anchor)), "anchor_id": anchors.ids[anchor], "positive_id": positive, "positive_score": score}
    )
    pairs = rows.sparkSession.createDataFrame(pairs)
    return stage_table(
        negatives.join(pairs, "slot").select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
    )


def mine(
    table: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For every anchor and each of its ``POSITIVES`` best rows of its label, the
    ``NEGATIVES`` best rows of other labels whose score is between ``AT_LEAST`` and
    ``AT_MOST`` per cent of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the id. A score is the inner product of the
    components times ``SCALE``, rounded down to whole numbers; ties go to the
    smaller id. Rows without id or label, with a null vector, or with a component
    that is null, not finite or not below ``LARGEST / SCALE`` (32,768) take no part.
    Vectors of different length have no score together; empty ones score 0. Repeated
    rows are rows of their own where they are found, but an anchor that is repeated
    with the same label and vector is one anchor; rows with the anchor's id are
    never its positives. An empty table, and one without anchors, gives no rows.
    """
    rows = stored_rows(
        table.select(
            table[id_col].cast("long").alias("vec_id"),
            table[label_col].cast("string").alias("label"),
            table[vector_col].cast("array<double>").alias("values"),
        )
    )
    anchors = stage_table(rows.filter(is_anchor).distinct())
    found = None
    # one block after the other; a block is bounded in rows and bytes
    for dim in [r["dim"] for r in anchors.select("dim").distinct().orderBy("dim").collect()]:
        own, same = anchors.filter(F.col("dim") == dim), rows.filter(F.col("dim") == dim)
        row_bytes = 1 + dim * 4 + 16 * sum(levels(dim))
        step = max(1, min(BLOCK, BLOCK_BYTES // row_bytes))
        blocks = -(-own.count() // step)
        # ids near each other are dealt to different blocks; the hash says to which
        dealt = own.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)))
        for number in range(blocks):
            block = Block.of(dealt.filter(F.col("block") == number).orderBy("vec_id", "label", "vector").toArrow(), dim)
            if len(block.ids):
                part = _mine(same, block)
                found = part if found is None else found.union(part)
    if found is None:
        return table.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return found
