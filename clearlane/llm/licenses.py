"""Licences of files: by their own notice, or inherited from the nearest
directory above that declares one. DataFrame functions only.

1. Every line of every file is a possible notice, and every file a possible
   licence text. Lines are compared with ``TEMPLATES``, whole files with ``TEXTS``,
   by the cosine of sparse TF-IDF vectors. Document frequencies are those of all
   words over all files, so a score does not depend on how many files there are.
2. Lines without a distinctive word, and files without enough of the weight of a
   licence text, are left out first. That loses nothing: the words that a line or
   file shares with a template bound the cosine.
3. A file is a licence file, and declares its licence for its directory, if it is
   like a licence text as a whole, if at least ``FILE_SHARE`` of its words stand in
   notices, or if it has a notice and a name like LICENSE or COPYING.
4. Directories, not files, are joined with the directories above them; files
   are then joined with their directory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlane.operators.staging import stage_table

TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
COSINE = 0.6
FILE_SHARE = 0.5
# names of files that hold a licence, without regard to case
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|copyright|unlicen[cs]e)[^/]*$"

# Usual short notices of well-known licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License",
        "Apache License Version 2.0, January 2004",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "GNU General Public License Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "GNU General Public License Version 3, 29 June 2007",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3",),
    "LicenseRef-Proprietary": ("All rights reserved",),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}


_DISCLAIMER_BSD = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, "
    "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or "
    "services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, "
    "whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use "
    "of this software, even if advised of the possibility of such damage."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
# The words of whole licences, and of the opening sections of long ones.
TEXTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, "
        "reproduction, and distribution 1. Definitions. License shall mean the terms and conditions for use, reproduction, "
        "and distribution as defined by Sections 1 through 9 of this document. Licensor shall mean the copyright owner or "
        "entity authorized by the copyright owner that is granting the License. Legal Entity shall mean the union of the "
        "acting entity and all other entities that control, are controlled by, or are under common control with that "
        "entity. You (or Your) shall mean an individual or Legal Entity exercising permissions granted by this License. "
        "Source form shall mean the preferred form for making modifications, including but not limited to software source "
        "code, documentation source, and configuration files. Object form shall mean any form resulting from mechanical "
        "transformation or translation of a Source form. Work shall mean the work of authorship, whether in Source or "
        "Object form, made available under the License. Derivative Works shall mean any work that is based on the Work. "
        "Contribution shall mean any work of authorship that is intentionally submitted to Licensor for inclusion in the "
        "Work. Contributor shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has "
        "been received by Licensor. 2. Grant of Copyright License. Subject to the terms and conditions of this License, "
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable "
        "copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
        "distribute the Work and such Derivative Works in Source or Object form. 3. Grant of Patent License. "
        "4. Redistribution. 5. Submission of Contributions. 6. Trademarks. 7. Disclaimer of Warranty. "
        "8. Limitation of Liability. 9. Accepting Warranty or Additional Liability.",
    ),
    "BSD-2-Clause": (_BSD + _DISCLAIMER_BSD,),
    "BSD-3-Clause": (_BSD + _THIRD_CLAUSE + _DISCLAIMER_BSD,),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. The software is "
        "provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, "
        "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether "
        "in an action of contract, negligence or other tortious action, arising out of or in connection with the use or "
        "performance of this software.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. The software is provided as is, without warranty of any kind, express or implied, including but not "
        "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event "
        "shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
        "of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
        "dealings in the software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
}


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _template_terms(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, dict[str, int]]]:
    found = []
    for name, texts in templates.items():
        for text in texts:
            counts: dict[str, int] = {}
            for term in re.findall(TERM, text.lower()):
                counts[term] = counts.get(term, 0) + 1
            found.append((name, counts))
    return found


def template_weights(
    counted: list[tuple[str, dict[str, int]]], idf: Mapping[str, float]
) -> list[tuple[str, dict[str, float]]]:
    """Unit vectors of the templates."""
    out = []
    for name, counts in counted:
        vector = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        out.append((name, {t: x / length for t, x in vector.items()}))
    return out


def distinctive_terms(vectors: list[tuple[str, dict[str, float]]], idf: Mapping[str, float], cosine: float) -> list[str]:
    """All terms but the most common ones that, even together, keep a line below
    ``cosine`` for every template: with no other term of the template, the
    cosine is at most the length of the common part of its vector."""
    common: set[str] = set()
    for term in sorted(idf, key=lambda t: (idf[t], t)):
        common.add(term)
        if any(sum(x * x for t, x in v.items() if t in common) >= cosine * cosine * 0.999 for _, v in vectors):
            common.discard(term)
    return sorted(t for t in idf if t not in common)


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, df) of all words, stored. Tasks add up their own files first."""
    terms = files.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    return stage_table(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def _idf(df: Column, total: int) -> Column:
    return F.log((1 + total) / (1 + df)) + 1


def _similar(units: DataFrame, key: list[str], vectors: list[tuple[str, dict[str, float]]], frequency: DataFrame, total: int, cosine: float) -> DataFrame:
    """(key, words, licence, score) of the units (key, terms) that are like a
    template: of equals the first by name."""
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    term = units.select(*key, F.explode("terms").alias("term"))
    # the same unit of a file repeated counts once more in both parts of a cosine
    tf = term.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))
    value = tf.join(frequency, "term").withColumn("x", (1 + F.log("n")) * _idf(F.col("df"), total))
    rows = [(t, i, name, w) for i, (name, v) in enumerate(vectors) for t, w in v.items()]
    side = units.sparkSession.createDataFrame(rows, "term string, template int, licence string, w double")
    # the templates are constants of this module or of the caller
    by_unit = value.join(F.broadcast(side.groupBy("term").agg(F.collect_list(F.struct("template", "licence", "w")).alias("of"))), "term", "left")
    lengths = by_unit.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.sum("n").alias("words"))
    dots = (
        by_unit.select(*key, "x", F.explode("of").alias("t"))
        .groupBy(*key, "t.template", "t.licence")
        .agg(F.sum(F.col("x") * F.col("t.w")).alias("dot"))
    )
    matches = same(dots, lengths)
    condition = matches[0]
    for part in matches[1:]:
        condition = condition & part
    scored = dots.join(lengths, condition).select(
        *[dots[k] for k in key], "words", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("score")
    )
    return (
        scored.filter(F.col("score") >= cosine)
        .groupBy(*key)
        .agg(F.first("words").alias("words"), F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
        .select(*key, "words", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))
    )


def _enough(terms: Column, vectors: list[tuple[str, dict[str, float]]], cosine: float) -> Column:
    """Whether the words of a template that are there could give the cosine: it is
    at most the length of their part of the template's vector. One pass over the
    words adds up the squares for all templates."""
    vocabulary = sorted({t for _, v in vectors for t in v})
    squares = F.create_map(
        *[x for t in vocabulary for x in (F.lit(t), F.array(*[F.lit(v.get(t, 0.0) ** 2) for _, v in vectors]))]
    )
    there = F.array_intersect(terms, F.array(*[F.lit(t) for t in vocabulary]))
    nothing = F.array(*[F.lit(0.0) for _ in vectors])
    shares = F.aggregate(there, nothing, lambda s, t: F.zip_with(s, F.element_at(squares, t), lambda a, b: a + b))
    return F.exists(shares, lambda x: x >= cosine * cosine * 0.999)


def notices(
    files: DataFrame, templates: Mapping[str, tuple[str, ...]], texts: Mapping[str, tuple[str, ...]], cosine: float
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, path, line, words, licence, score) of each line that is a notice,
    and (doc_id, path, words, licence, score) of each file that is a licence text."""
    counted, whole = _template_terms(templates), _template_terms(texts)
    vocabulary = sorted({t for _, counts in (*counted, *whole) for t in counts})
    total = files.count()
    frequency = document_frequencies(files)
    # one row for each word of the templates
    seen = {r["term"]: r["df"] for r in frequency.filter(F.col("term").isin(vocabulary)).collect()}
    idf = {t: math.log((1 + total) / (1 + max(1, seen.get(t, 0)))) + 1 for t in vocabulary}
    vectors, whole_vectors = template_weights(counted, idf), template_weights(whole, idf)
    own = {t: idf[t] for _, counts in counted for t in counts}
    distinctive = F.array(*[F.lit(t) for t in distinctive_terms(vectors, own, cosine)])

    lines = files.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    possible = lines.select("doc_id", "path", "line", _terms(F.col("raw")).alias("terms")).filter(
        F.arrays_overlap("terms", distinctive)
    )
    found = _similar(possible, ["doc_id", "path", "line"], vectors, frequency, total, cosine)
    alike = files.select("doc_id", "path", _terms(F.col("text")).alias("terms")).filter(_enough(F.col("terms"), whole_vectors, cosine))
    return found, _similar(alike, ["doc_id", "path"], whole_vectors, frequency, total, cosine)


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def nearest_declared(directories: DataFrame, declared: DataFrame) -> DataFrame:
    """(directory, licence, declared_in): for each directory, the licence that it
    or the nearest directory above it declares. The empty name is the root."""
    parts = F.filter(F.split("directory", "/"), lambda p: p != "")
    above = directories.select("directory", parts.alias("parts")).select(
        "directory",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", F.lit(1), i), "/").alias("name")))).alias("a"),
    )
    declared = declared.select(
        F.array_join(F.filter(F.split("directory", "/"), lambda p: p != ""), "/").alias("name"), "licence", "files"
    )
    one = declared.groupBy("name", "licence").agg(F.sum("files").alias("files")).groupBy("name").agg(
        F.min(F.struct((-F.col("files")).alias("f"), "licence")).alias("best")
    )
    return (
        above.select("directory", "a.depth", "a.name")
        .join(one, "name")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "name", "best.licence")).alias("x"))
        .select("directory", F.col("x.licence").alias("licence"), F.col("x.name").alias("declared_in"))
    )


def scan_licenses(
    files: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "path",
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    texts: Mapping[str, tuple[str, ...]] = TEXTS,
    cosine: float = COSINE,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """One row per input row: doc_id, path, header_licence, score, licence_file,
    licence, origin, declared_in.

    ``header_licence`` is that of the licence text the file is, else of its most
    similar notice (of equals, the first by name), null without one. ``licence`` is the file's own (origin
    ``header`` or, for licence files, ``file``), else that of the nearest
    directory with a licence file (origin ``directory``; the licence most of its
    licence files have, of equals the first by name), else null. Null and empty
    texts have no notice and can inherit. A null path is in no directory and
    inherits nothing. Rows that share id and path are one file with the notices
    of all of them. An empty table gives no rows. Texts of any length are read as a
    whole, a task holds the words of one.
    """
    base = files.select(
        files[id_col].alias("doc_id"), files[path_col].cast("string").alias("path"), files[text_col].alias("text")
    )
    by_line, by_file = (stage_table(x) for x in notices(base, templates, texts, cosine))
    # a whole licence text goes before any notice in it, and all its words count
    every = by_line.select("doc_id", "path", F.lit(1).alias("place"), "licence", "score", "words", F.lit(False).alias("whole")).union(
        by_file.select("doc_id", "path", F.lit(0).alias("place"), "licence", "score", F.lit(0).cast("long").alias("words"), F.lit(True).alias("whole"))
    )
    per_file = every.groupBy("doc_id", "path").agg(
        F.min(F.struct("place", (-F.col("score")).alias("s"), "licence")).alias("best"),
        F.sum("words").alias("in_notices"),
        F.max("whole").alias("whole"),
    )
    # only files with a notice are counted word by word
    ids = per_file.select(F.col("doc_id").alias("f_id"), F.col("path").alias("f_path"), "best", "in_notices", "whole")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("path").eqNullSafe(F.col("f_path"))
    sized = base.select("doc_id", "path", F.coalesce(F.regexp_count(F.lower("text"), F.lit(TERM)), F.lit(0)).alias("terms"))
    known = stage_table(
        sized.join(ids, same, "left")
        .select(
            "doc_id",
            "path",
            _directory(F.col("path")).alias("directory"),
            F.col("best.licence").alias("header_licence"),
            (-F.col("best.s")).alias("score"),
            F.coalesce(
                F.col("whole") | (F.col("in_notices") >= file_share * F.col("terms")) | F.col("path").rlike(LICENCE_NAME) & F.col("best").isNotNull(),
                F.lit(False),
            ).alias("licence_file"),
        )
    )
    declared = known.filter("licence_file AND path IS NOT NULL").groupBy("directory", F.col("header_licence").alias("licence")).agg(
        F.count(F.lit(1)).alias("files")
    )
    directories = known.filter("path IS NOT NULL").select("directory").distinct()
    inherited = nearest_declared(directories, declared).select(
        F.col("directory"), F.col("licence").alias("dir_licence"), F.col("declared_in").alias("dir_name")
    )
    origin = (
        F.when(F.col("licence_file"), "file")
        .when(F.col("header_licence").isNotNull(), "header")
        .when(F.col("dir_licence").isNotNull(), "directory")
    )
    return (
        known.join(inherited, "directory", "left")
        .select(
            "doc_id",
            "path",
            "header_licence",
            "score",
            "licence_file",
            F.coalesce("header_licence", "dir_licence").alias("licence"),
            origin.alias("origin"),
            F.when(F.col("header_licence").isNull(), F.col("dir_name")).alias("declared_in"),
        )
    )
