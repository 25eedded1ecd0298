"""URL rules by a bit-parallel wildcard automaton.

All rules are packed side by side into the bits of a few 64-bit words, one bit
for each place in each pattern. A pattern is a list of literal bytes and stars;
a star stays where it is on any byte of its class. One Shift-And step moves all
patterns over one byte: ``state = (state << 1 & literal[byte]) | (state &
loop[byte])``. The step is taken for a whole batch of URLs at once, column by
column, so the work is one array operation for each byte position and mask
word, however many rules there are.

Rules name a host suffix and a path prefix, as they are or as globs, in which a
star stands for any characters and a question mark for one. The automaton reads
the canonical URL ``.host/path`` against ``*.suffix/prefix*``, where the first star,
and every wildcard of the host, stays inside the host. No path can contribute to
the host part, because the pattern's first slash has to be the URL's first slash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlane.llm import tokens as T

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``path`` begins with a slash. With ``glob``, ``*`` and ``?`` are wildcards in
    both parts."""

    verdict: str
    host: str
    path: str
    glob: bool = False

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def _places(rule: Rule) -> list[tuple[np.ndarray, np.ndarray]]:
    """What a rule reads, place by place: the bytes that lead to a place, and those
    on which it stays. The first place has no way to it."""
    every, none = np.ones(256, bool), np.zeros(256, bool)
    in_host = every.copy()
    in_host[ord("/")] = False
    inside = np.zeros(256, bool)
    inside[0x80:0xC0] = True  # the further bytes of a character
    found = [(none, in_host.copy())]
    for part, allowed in (("." + rule.host, in_host), (rule.path, every)):
        for char in part:
            if rule.glob and char == "*":
                found[-1] = (found[-1][0], found[-1][1] | allowed)
            elif rule.glob and char == "?":
                found.append((allowed & ~inside, inside.copy()))
            else:
                found += [(np.arange(256) == byte, none) for byte in char.encode()]
    return [*found[:-1], (found[-1][0], every)]


class Automaton:
    """Masks of all rules. Bit k of a rule's stretch stands for "its first k places
    are read"; bit 0 is the host star, the last bit the path star."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        places = [_places(r) for r in self.rules]
        begins = np.cumsum([0, *map(len, places)])
        self.words = max(1, -(-int(begins[-1]) // 64))
        self.literal = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        for begin, own in zip(begins.tolist(), places, strict=False):
            for k, (led, stays) in enumerate(own):
                word, bit = divmod(begin + k, 64)
                one = np.uint64(1) << np.uint64(bit)
                self.literal[led, word] |= one
                self.loop[stays, word] |= one
                if not k:
                    self.start[word] |= one
            self.accept.append((word, one))
        # the longest rule wins; of equally long ones a block, then the first
        self.order = sorted(
            range(len(self.rules)), key=lambda i: (len(self.rules[i].text), self.rules[i].verdict == BLOCK, -i)
        )

    def winner(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Index of the rule of each URL, -1 without one."""
        length = np.diff(offsets)
        state = np.tile(self.start, (len(length), 1))
        # longest first, so that the URLs still being read are a prefix
        by_length = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][by_length], length[by_length]
        one, high = np.uint64(1), np.uint64(63)
        for at in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -at, "left"))
            byte = data[begin[:live] + at]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> high
            state[:live] = (moved & self.literal[byte]) | (now & self.loop[byte])
        won = np.full(len(length), -1)
        for rule in self.order:
            word, bit = self.accept[rule]
            won[(state[:, word] & bit) != 0] = rule
        out = np.empty(len(length), np.int64)
        out[by_length] = won
        return out


def _judge(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], default: str) -> Iterator[pa.RecordBatch]:
    automaton = Automaton(rules)
    names = pa.array([*[r.text for r in rules], None], pa.string())
    verdicts = pa.array([*[r.verdict for r in rules], default], pa.string())
    for batch in T.slices(batches, "canonical"):
        won = automaton.winner(*T.text_bytes(batch.column("canonical")))
        pick = pa.array(np.where(won < 0, len(rules), won))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("page_id", "host", "path")], names.take(pick), verdicts.take(pick)],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule and verdict.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, with A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. A
    null URL, an empty one and one without ``://`` have an empty host and path.
    No rule fits them, as no rule fits an empty path: rule is null and the
    verdict is ``default``. The longest rule counts, wildcards included; of equally
    long ones one that blocks, then the first. Repeated rows and ids are judged each
    on its own, URLs of any length as a whole. An empty table gives no rows.
    """
    url = pages[url_col]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parsed = (
        pages.select(pages[id_col].alias("page_id"), url.alias("u"))
        .withColumn("rest", F.coalesce(F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")), F.lit("")))
        .withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0))
        .select(
            "page_id",
            F.translate("raw_host", upper, lower).alias("host"),
            F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), r"^[^?#]*", 0).alias("path"),
        )
    )
    kind = dict(parsed.dtypes)["page_id"]
    return parsed.withColumn("canonical", F.concat(F.lit("."), "host", "path")).mapInArrow(
        partial(_judge, rules=list(rules), default=default),
        f"page_id {kind}, host string, path string, rule string, verdict string",
    )


def oracle_sql(rules: Sequence[Rule] = RULES, default: str = ALLOW) -> str:
    """The same in DuckDB SQL, rule by rule."""
    fits = [
        (
            f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))",
            r,
        )
        for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != BLOCK))
    ]
    cases = lambda value: " ".join(f"WHEN {fit} THEN '{value(r)}'" for fit, r in fits)
    return rf"""
WITH u AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
    SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM h
)
SELECT page_id, host, path, CASE {cases(lambda r: r.text)} END AS rule,
    CASE {cases(lambda r: r.verdict)} ELSE '{default}' END AS verdict
FROM p
"""
