import hashlib
import random
import re

from clearlane.llm import lines
from tests.llm.cases import ODD, documents, prose


def templates(line):
    ws = ["<*>" if re.search("[0-9]", w) else w for w in line.split()]
    n = len(ws)
    out = {("w", n, *ws)}
    if n >= 8:
        out |= {("a", n, *ws[: n // 2]), ("b", n, *ws[:3], *ws[n // 2 :])}
    return out


def brute(rows, documents_):
    seen = {}
    for k, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                for x in templates(line):
                    seen.setdefault(x, set()).add(k)
    gone = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip(" \t\n\r\x0b\x0c") and any(len(seen[x]) >= documents_ for x in templates(line)):
                gone.setdefault(i, set()).add(n)
    out = []
    for i, t in rows:
        raw = t.split("\n") if t else []
        kept = "\n".join(x for n, x in enumerate(raw) if n not in gone.get(i, ()))
        out.append((i, len(raw), len([n for n in range(len(raw)) if n in gone.get(i, ())]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()], key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for d in range(60):
        own = [" ".join(prose((d, k), rng.randrange(1, 15), 400)) for k in range(4)]
        page = f"Page {d} of {rng.randrange(99)}"
        posted = f"Posted by {rng.choice(['Ann', 'Bo', 'Cy'])}{d * 'x'} on Monday in the news of this town today"
        texts.append("\n".join([page, *own, " All rights reserved.\t", "", posted, *rng.sample(own, 1)]))
    texts += ODD
    assert result(lines.drop_template_lines(documents(spark, texts))) == brute(list(enumerate(texts)), 10)


def test_nulls_and_repeated_ids(spark):
    texts = ["x 1\nown a", "x 2\nown b", "x 3\n\nown c", None, "", "x 4", "x 4"]
    ids = [1, 2, 3, 4, 5, None, 9]
    assert result(lines.drop_template_lines(documents(spark, texts, ids), 3)) == brute(list(zip(ids, texts, strict=True)), 3)
    again = lines.drop_template_lines(documents(spark, ["x 1", "x 2", "x 3"], [7, 7, 7]), 3).collect()
    assert [(r.n_dropped, r.kept_text) for r in again] == [(1, "")] * 3
    assert lines.drop_template_lines(documents(spark, ["x"]).limit(0)).collect() == []
