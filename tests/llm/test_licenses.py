import math
import re
from collections import Counter

import pytest

from clearlane.llm import licenses
from tests.llm.cases import CLASHING, ODD


def frame(spark, rows):
    extra = [c for c in CLASHING if c != "path"]
    schema = "doc_id long, path string, text string" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)


def brute_notices(rows):
    """(row, line) -> (licence, score): cosine with every template; the line of a
    whole file is None."""
    split = lambda t: re.findall(licenses.TERM, (t or "").lower())
    n = len(rows)
    df = Counter(t for r in rows for t in set(split(r[2])))
    idf = lambda t: math.log((1 + n) / (1 + max(1, df[t]))) + 1

    def vector(ts):
        v = {t: (1 + math.log(ts.count(t))) * idf(t) for t in ts}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    out = {}
    for k, r in enumerate(rows):
        units = [(None, r[2] or "", licenses.TEXTS), *((i, x, licenses.TEMPLATES) for i, x in enumerate((r[2] or "").split("\n")))]
        for i, unit, templates in units:
            if ts := split(unit):
                v = vector(ts)
                own = [(name, vector(split(t))) for name, texts in templates.items() for t in texts]
                best = min((-round(sum(x * v.get(t, 0) for t, x in w.items()), 6), name) for name, w in own)
                if -best[0] >= licenses.COSINE:
                    out[k, i] = (best[1], -best[0])
    return out


MIT = licenses.TEXTS["MIT"][0]


def wrapped(text, width=9):
    ws = text.split()
    return "\n".join(" ".join(ws[i : i + width]) for i in range(0, len(ws), width))


ROWS = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (2, "a/x.txt", "some words here\nmore of them"),
    (3, "a/b/c/y.txt", "text without notice"),
    (4, "a/b/z.txt", "// Released under the MIT License.\ncode follows here and goes on for long enough"),
    (5, "a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (6, "a/b/d/e/q.txt", None),
    (7, "other/w.txt", "The license of the city was under review. All rights were kept."),
    (8, "root.txt", "nothing"),
    (9, None, "no path here"),
    (10, "/a//b/lead.txt", "odd slashes"),
    (11, "nc/f.txt", "Licensed under CC BY-NC 4.0.\n" + "word " * 300),
    (12, "nc/g.txt", "Licensed under CC BY-SA 4.0\n" + "word " * 300),
    (13, "two/L1", "All rights reserved."),
    (14, "two/L2", "Released under the MIT License."),
    (15, "two/t.txt", "x"),
    (16, "mit/doc.txt", "MIT License\n\nCopyright (c) 2019 Some Body\n\n" + wrapped(MIT)),
    (17, "mit/src/a.txt", "code of the file"),
    (18, "part/doc.txt", wrapped(licenses.TEXTS["MIT"][1])),
    (19, "part/b.txt", "other code"),
    (20, "bsd/doc.txt", "Copyright 2020\n" + wrapped(licenses.TEXTS["BSD-3-Clause"][0], 12)),
    (21, "named/LICENSE", "                 Apache License\n           Version 2.0, January 2004\n" + " ".join(f"z{i}" for i in range(900))),
    (22, "named/x/c.txt", "more code"),
    (23, "quoted/essay.txt", "They said the software is provided as is and talked of the copyright notice. " + " ".join(f"q{i}" for i in range(60))),
    *[(100 + i, f"odd/{i}.txt", t) for i, t in enumerate(ODD)],
]


def test_own_notices_and_inheritance(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    own = {}
    for (k, line), (name, score) in brute_notices(ROWS).items():
        own[ROWS[k][0]] = min(own.get(ROWS[k][0], (2, 0, "")), (line is not None, -score, name))
    own = {i: x[1:] for i, x in own.items()}
    assert {i: (-r.score, r.header_licence) for i, r in got.items() if r.header_licence} == own
    assert own[11] == (-1.0, "CC-BY-NC-4.0") and own[12] == (-1.0, "CC-BY-SA-4.0") and 7 not in own
    found = {i: (r.licence, r.origin, r.declared_in) for i, r in got.items()}
    assert found[1] == ("Apache-2.0", "file", None)
    assert found[2] == found[10][:2] + ("a",) == ("Apache-2.0", "directory", "a")
    assert found[3] == ("Apache-2.0", "directory", "a")
    assert found[4] == ("MIT", "header", None)
    assert found[6] == ("GPL-3.0", "directory", "a/b/d")
    assert found[15] == ("LicenseRef-Proprietary", "directory", "two")  # of equals, the first by name
    assert all(found[i] == (None, None, None) for i in (7, 8, 9, 23))
    assert all(found[i] == ("MIT", "file", None) for i in (16, 18)) and found[20][:2] == ("BSD-3-Clause", "file")
    assert found[17] == ("MIT", "directory", "mit") and found[19] == ("MIT", "directory", "part")
    assert found[21] == ("Apache-2.0", "file", None) and found[22] == ("Apache-2.0", "directory", "named")


def test_scores_do_not_depend_on_how_many_files_there_are(spark):
    rows = [(i, f"d{i}/f.txt", f"words of file number {i % 5} by the people here") for i in range(20)]
    rows.append((20, "n/f.txt", "Sample scripts released under the MIT License"))
    rows += [(21 + i, f"s{i}/f.txt", "sample scripts of the week") for i in range(9)]
    scores = []
    for times in (1, 40):
        many = [(i + 1000 * k, f"k{k}/{p}", t) for k in range(times) for i, p, t in rows]
        got = licenses.scan_licenses(frame(spark, many)).filter("header_licence = 'MIT'").collect()
        assert len(got) == times and len({r.score for r in got}) == 1
        scores.append(got[0].score)
    assert abs(scores[0] - scores[1]) < 0.05


def test_files_without_enough_of_a_text_cannot_reach_the_cosine(spark):
    """The first filter keeps every file that a cosine of the threshold has."""
    texts = [" ".join(MIT.split()[: 10 * k]) for k in range(1, 17)] + [" ".join(MIT.split()[::k]) for k in range(2, 9)]
    rows = [(i, f"p{i}/f.txt", t) for i, t in enumerate(texts)]
    found = {rows[k][0] for (k, line) in brute_notices(rows) if line is None}
    assert 3 < len(found) < len(rows)
    got = {r.doc_id for r in licenses.notices(frame(spark, rows).select("doc_id", "path", "text"), licenses.TEMPLATES, licenses.TEXTS, licenses.COSINE)[1].collect()}
    assert got == found


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(None, "d/a", "All rights reserved"), (None, "d/a", "All rights reserved"), (None, None, None), (1, "d/b", "x")]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    assert len(got) == 4 and sum(r.licence == "LicenseRef-Proprietary" for r in got) == 3
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("cosine", [0.3, 0.6, 0.9])
def test_lines_without_distinctive_words_cannot_reach_the_cosine(cosine):
    counted = licenses._template_terms(licenses.TEMPLATES)
    idf = {t: 1 + (sum(map(ord, t)) % 97) / 10 for _, c in counted for t in c}
    vectors = licenses.template_weights(counted, idf)
    distinctive = set(licenses.distinctive_terms(vectors, idf, cosine))
    assert all(sum(x * x for t, x in v.items() if t not in distinctive) < cosine**2 for _, v in vectors)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan_licenses(frame(spark, ROWS[:3]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
