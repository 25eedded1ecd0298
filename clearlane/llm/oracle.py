"""SQL that gives the rows of the queries of this package, where SQL can."""

from __future__ import annotations

from clearlane.llm import urlfilter

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM spot),
earliest AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
    FROM win JOIN earliest USING (k) WHERE d < doc_id
),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
    FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

# links of J >= 0.85 on the distinct 5-word shingles, closed by recursion
NEAR = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
    FROM w
),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
sh AS (SELECT doc_id, n, md5(unnest(s)) AS k FROM sized),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
    FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY ALL
),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (nx + ny - c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
    SELECT x, x FROM (SELECT DISTINCT x FROM sym)
    UNION SELECT sym.y, reach.r FROM reach JOIN sym ON sym.x = reach.doc_id
),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT sized.doc_id, n AS n_shingles, coalesce(component_id, sized.doc_id) AS component_id,
    coalesce(component_id, sized.doc_id) = sized.doc_id AS kept
FROM sized LEFT JOIN comp ON comp.doc_id = sized.doc_id
"""

URLS = urlfilter.oracle_sql()

LINES = rf"""
WITH l AS (
    SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS raw
    FROM documents WHERE length(text) > 0
),
s AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
m AS (
    SELECT doc_id, i, list_transform(regexp_split_to_array(line, '[ \t\r\x0B\x0C]+'),
        lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w
    FROM s WHERE line <> ''
),
p AS (
    SELECT doc_id, i, 'w ' || len(w) || ' ' || array_to_string(w, ' ') AS t FROM m
    UNION ALL SELECT doc_id, i, 'a ' || len(w) || ' ' || array_to_string(w[1:len(w) // 2], ' ') FROM m WHERE len(w) >= 8
    UNION ALL SELECT doc_id, i, 'b ' || len(w) || ' ' || array_to_string(w[1:3], ' ') || ' ' || array_to_string(w[len(w) // 2 + 1:], ' ')
        FROM m WHERE len(w) >= 8
),
often AS (SELECT t FROM (SELECT DISTINCT doc_id, t FROM p) GROUP BY t HAVING count(*) >= 10),
gone AS (SELECT DISTINCT doc_id, i FROM p JOIN often USING (t)),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(raw, chr(10) ORDER BY i) AS k
    FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
),
total AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n, 0) AS n_dropped,
    sha256(coalesce(k, '')) AS kept_sha256
FROM documents d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_GRAMS = "\nUNION ALL\n".join(
    f"SELECT lang, {m} AS m, list_slice(ws, i, i + {m - 1}) AS p, count(*) AS f "
    f"FROM (SELECT lang, ws, unnest(range(1, len(ws) - {m} + 2)) AS i FROM words) GROUP BY ALL"
    for m in range(1, 6)
)
COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS ({_GRAMS}),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, m, p, f AS a FROM grams WHERE m >= 2 AND f >= 100),
inside AS (
  SELECT lang, p[1:m - 1] AS p, a FROM candidates WHERE m > 2
  UNION ALL SELECT lang, p[2:m], a FROM candidates WHERE m > 2),
longer AS (SELECT lang, p, max(a) AS a FROM inside GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer x ON x.lang = c.lang AND x.p = c.p
  WHERE x.a IS NULL OR x.a < c.a),
cuts AS (
  SELECT lang, p, a, k, p[1:k] AS head, p[k + 1:m] AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, h.f AS l, t.f AS r, n.n,
         ((1000::HUGEINT * c.a * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.p = c.head
  JOIN grams t ON t.lang = c.lang AND t.p = c.tail JOIN total n ON n.lang = c.lang),
best AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scores WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
