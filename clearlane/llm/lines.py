"""Removal of lines that come from templates, by a log-template tree.

A line's words are masked: a word with a digit is a variable field. The tree has
a fixed depth: the number of words, then the first ``DEPTH`` masked words. A leaf
holds templates that agree with a line in at least half of its words. Instead of
a running list of templates, whose outcome would depend on the order of lines,
every line proposes the templates it could belong to: its masked words as they
are, and, if it is long enough, the same with the words of its latter or former
half generalised to variable fields. A template recurs if ``DOCUMENTS``
documents have a line that proposes it. All lines of recurring templates go.

Tasks propose each template once for a document; counting templates is a grouping
that is combined before the shuffle, whatever share of the lines one of them has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane.llm import tokens as T

DEPTH = 3
DOCUMENTS = 10
# words a line needs before halves of it are generalised
HALVES_FROM = 8
FIELD = "<*>"
_digit = re.compile(r"[0-9]")


def split_lines(text: str) -> list[str]:
    """Lines end at a line feed; white space around them does not count."""
    return [line.strip(" \t\n\r\x0b\x0c") for line in text.split("\n")]


def masked_words(line: str) -> list[str]:
    words = re.split(r"[ \t\r\x0b\x0c]+", line)
    if _digit.search(line):
        words = [FIELD if _digit.search(w) else w for w in words]
    return words


def proposals(words: list[str], depth: int = DEPTH) -> list[str]:
    """Templates of a masked line: kind, number of words, words."""
    n = len(words)
    found = [f"w {n} " + " ".join(words)]
    if n >= HALVES_FROM:
        half = n // 2
        head = " ".join(words[:depth])
        found.append(f"a {n} " + " ".join(words[:half]))
        found.append(f"b {n} {head} " + " ".join(words[half:]))
    return found


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, lines): each template of a document with its lines."""
    for batch in T.slices(batches, "text", 1 << 21):
        docs, hashes, lines = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own: dict[bytes, list[int]] = {}
            for number, line in enumerate(split_lines(text or "")):
                if line:
                    for template in proposals(masked_words(line)):
                        own.setdefault(xxhash.xxh3_128_digest(template.encode()), []).append(number)
            docs.extend([doc] * len(own))
            hashes.extend(own)
            lines.extend(own.values())
        pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(lines, pa.list_(pa.int32()))],
            names=["doc_id", "t1", "t2", "lines"],
        )


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, "text", 1 << 21):
        out: list[list] = [[] for _ in names]
        for doc, text, gone in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "gone")], strict=True):
            raw = [] if not text else text.split("\n")
            dropped = {x for part in gone or () for x in part}
            kept = "\n".join(line for i, line in enumerate(raw) if i not in dropped)
            row = [doc, len(raw), len(dropped), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept]
            for column, value in zip(out, row, strict=False):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)


def drop_template_lines(
    docs: DataFrame,
    documents: int = DOCUMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256 of the
    lines that stay, joined by line feeds, and these lines as kept_text.

    Empty lines and lines of white space always stay. A null or empty text has
    no lines. Rows that share an id count as so many documents, and a line
    number that goes in one of them goes in all; rows without an id count, but
    keep all lines. An empty table gives no rows.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    proposed = base.filter("length(text) > 0").mapInArrow(_propose, "doc_id long, t1 long, t2 long, lines array<int>")
    recurring = proposed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= documents).select("t1", "t2")
    gone = (
        proposed.filter("doc_id IS NOT NULL")
        .join(recurring, ["t1", "t2"])
        .groupBy("doc_id")
        .agg(F.collect_list("lines").alias("gone"))
    )
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text]
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return (
        base.join(gone.hint("shuffle_hash"), "doc_id", "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(partial(_cut, names=names, with_text=with_text), schema)
    )
