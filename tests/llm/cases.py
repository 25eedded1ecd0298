"""Inputs and plain versions that several tests use."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
CLASHING = {c: c for c in ("at", "n", "x", "y", "part", "size", "label", "bucket", "sign", "spans", "model", "copies", "shard", "line", "term")}


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words((text or "").translate(UPPER))


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Rows of documents with columns whose names the operators use inside."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = ["en"] * n if langs is None else langs
    sources = [f"s{i % 3}" for i in range(n)] if sources is None else sources
    rows = [(i, t, a, s, len(t or ""), *CLASHING.values()) for i, t, a, s in zip(ids, texts, langs, sources, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema + "".join(f", `{c}` string" for c in CLASHING)).repartition(3)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(str(seed))
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " \t\n ", "one", "One\u00a0two  three", "\u00e9\U0001f600 \x0b x", "a b c d e"]
