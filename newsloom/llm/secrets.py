"""Secret scan over a trigram inverted index.

From each rule's pattern follows a Boolean query: trigrams of which a text must hold one
whole set, or else the pattern cannot match. One pass over the texts gives the postings,
(trigram, text), for the trigrams that the rules ask for, and at once the matches of
rules whose query asks for nothing, which are scanned in full. Postings of a query's sets are
intersected by a join with the sets and a count by text; only the texts that remain are
read again and verified by the patterns themselves.

Trigrams and texts are compared with A-Z lower-cased, so that one index serves rules in
either case; the patterns see the text as it is.
"""

from __future__ import annotations

# The standard library's own parser of its patterns.
import re._parser as syntax
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import importable, saved

#: A query: one of these sets of trigrams is in the text as a whole. The empty set: any text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings that a part of a pattern is followed into, and sets of a query.
STRINGS, SETS = 64, 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, of ``least`` characters or more.

    The length is that of ``group``; 0 is the whole match. A match that is too short is
    dropped, and its characters are not looked at again.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


#: The base rules, and formats of well-known keys beside them.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
RULES = (
    *BASE,
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def _least(sets) -> Query:
    """Without sets that hold another one: those ask for more than is needed."""
    sets = set(sets)
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _both(a: Query, b: Query) -> Query:
    """Both queries hold; where that makes too many sets, the one with fewer is kept."""
    if len(a) * len(b) > SETS:
        return min((q for q in (a, b) if q != ANY), key=len)
    return _least(x | y for x, y in product(a, b))


def _asks(strings: frozenset[str]) -> Query:
    """One of the strings is in the text."""
    if any(len(s) < 3 for s in strings):
        return ANY
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def _sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    """What a sequence of pattern nodes may match: all strings, or None and a query."""
    strings, query, whole = frozenset([""]), ANY, True
    for node in nodes:
        more, asked = _node(*node)
        if more is not None and len(strings) * len(more) <= STRINGS:
            strings = frozenset(a + b for a, b in product(strings, more))
            continue
        whole = False
        query = _both(query, _asks(strings))
        query = _both(query, asked if more is None else _asks(more))
        strings = frozenset([""])
    return (strings, ANY) if whole else (None, _both(query, _asks(strings)))


def _node(op, value) -> tuple[frozenset[str] | None, Query]:
    if op is syntax.LITERAL:
        return frozenset([fold(chr(value))]), ANY
    if op is syntax.IN:
        chars = set()
        for kind, what in value:
            if kind is syntax.LITERAL:
                chars.add(fold(chr(what)))
            elif kind is syntax.RANGE and what[1] - what[0] < STRINGS:
                chars |= {fold(chr(c)) for c in range(what[0], what[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= STRINGS else (None, ANY)
    if op is syntax.SUBPATTERN:
        return _sequence(value[-1])
    if op is syntax.ATOMIC_GROUP:
        return _sequence(value)
    if op is syntax.BRANCH:
        ways = [_sequence(way) for way in value[1]]
        if all(s is not None for s, _ in ways) and sum(len(s) for s, _ in ways) <= STRINGS:
            return frozenset().union(*(s for s, _ in ways)), ANY
        sets = _least(s for way, asked in ways for s in (asked if way is None else _asks(way)))
        return None, sets if len(sets) <= SETS else ANY
    if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT, syntax.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, asked = _sequence(body)
        if low == 0:
            return (strings | {""}, ANY) if high == 1 and strings is not None else (None, ANY)
        if low == high == 1:
            return strings, asked
        return None, asked if strings is None else _asks(strings)
    if op in (syntax.AT, syntax.ASSERT, syntax.ASSERT_NOT):
        return frozenset([""]), ANY
    # Anything else may match whatever it likes.
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """The sets of trigrams of which a text that the pattern matches holds one.

    ``ANY`` (the empty set alone) if the pattern has no trigram that it cannot do without.
    """
    strings, asked = _sequence(syntax.parse(pattern, re.ASCII))
    return asked if strings is None else _asks(strings)


def matches(text: str, rules: Sequence[tuple[int, Rule]]) -> list[tuple[int, int, int]]:
    """``(start, number of the rule, end)`` of all matches, in code points."""
    found = []
    for number, rule in rules:
        for m in rule.compiled().finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


_FOUND = "array<struct<start: long, rule: int, end: long>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, hash, text``: rows that agree in all three have the same matches."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(id_.cast("string"), F.lit("")).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def scan(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc, hash, grams, found``: one pass over all texts.

    ``grams`` are the trigrams of the rules' queries that the text holds, ``found`` the
    matches of rules without a query.
    """
    grams = [(g, g.encode()) for g in sorted({g for r in rules for s in trigram_query(r.pattern) for g in s})]
    bare = [(k, r) for k, r in enumerate(rules) if trigram_query(r.pattern) == ANY]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Of bytes, lower() changes A-Z alone.
            low = (t.encode("utf-8", "surrogatepass").lower() for t in batch["text"])
            out = batch[["doc", "hash"]].copy()
            out["grams"] = [[g for g, b in grams if b in t] for t in low]
            out["found"] = [matches(t, bare) for t in batch["text"]]
            yield out

    return keyed.mapInPandas(run, f"doc string, hash long, grams array<string>, found {_FOUND}")


def postings(scanned: DataFrame) -> DataFrame:
    """``gram, doc, hash``: the index, each file of it in order of the trigrams."""
    return scanned.select(F.explode("grams").alias("gram"), "doc", "hash").sortWithinPartitions("gram", "doc")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc, hash, rules``: texts that may match, by intersection of postings.

    A text is a candidate of a rule if it is in the postings of all trigrams of one of
    the rule's sets. Postings are counted by text, so a trigram of very many texts is
    spread like any other.
    """
    sets = [
        (gram, k, number, 1 << i, (1 << len(grams)) - 1)
        for k, rule in enumerate(rules)
        for number, grams in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
        for i, gram in enumerate(grams)
    ]
    # A row per rule, set and trigram: as large as the rules, whatever the texts.
    wanted = index.sparkSession.createDataFrame(sets, "gram string, rule int, number int, bit long, full long")
    held = index.join(F.broadcast(wanted), "gram").groupBy("doc", "hash", "rule", "number", "full").agg(F.bit_or("bit").alias("bits"))
    return held.where("bits = full").groupBy("doc", "hash").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def verify(keyed: DataFrame, wanted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc, hash, checked``: matches of each candidate, one row per key."""
    rules = list(enumerate(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc", "hash"]].copy()
            out["checked"] = [matches(t, [rules[k] for k in ks]) for t, ks in zip(batch["text"], batch["rules"])]
            yield out

    found = keyed.join(wanted, ["doc", "hash"]).mapInPandas(run, f"doc string, hash long, checked {_FOUND}")
    # Rows that repeat a key have the same matches.
    return found.where(F.size("checked") > 0).groupBy("doc", "hash").agg(F.any_value("checked").alias("checked"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, spans``, one row per row of ``docs``.

    ``spans`` is an array of ``kind, start, end`` (code points, end exclusive), by start,
    then by the place of the kind's rule. A null text is empty and has none; null and
    repeated ids are rows like others. Other columns do not matter; an empty table gives
    no rows. A text is matched as a whole, however long it is.
    """
    importable(docs.sparkSession)
    keyed = _keyed(docs)
    scanned = saved(scan(keyed, rules), "secret-scan")
    index = saved(postings(scanned), "trigram-index")
    wanted = saved(candidates(index, rules), "secret-candidates")
    checked = saved(verify(keyed, wanted, rules), "secret-checked")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    every = F.array_sort(F.concat("found", F.coalesce("checked", F.array().cast(_FOUND))))
    spans = F.transform(every, lambda m: F.struct(kinds[m["rule"]].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    id_ = F.when(F.col("doc") != "", F.col("doc").cast("long")).alias("doc_id")
    return scanned.join(checked, ["doc", "hash"], "left").select(id_, spans.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _sql_pattern(rule: Rule) -> str:
    return ("(?i)" if rule.either_case else "") + rule.pattern.replace("'", "''")


def _sql_spans(rule: Rule, place: int) -> str:
    """Spans of one rule: matches and the texts between them give the positions."""
    p = _sql_pattern(rule)
    return f"""SELECT uid, {place} AS place, '{rule.kind}' AS kind, list_zip(
      regexp_extract_all(t, '{p}'), regexp_extract_all(t, '{p}', {rule.group}), regexp_split_to_array(t, '{p}')) AS z, {rule.least} AS least
    FROM d WHERE regexp_matches(t, '{p}')"""


#: The same by the patterns alone, over every text.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
u AS (SELECT uid, place, kind, least, unnest(z) AS z, unnest(range(1, len(z) + 1)) AS i FROM r),
s AS (
  SELECT uid, place, kind, least, z[1] AS m, z[2] AS g,
    sum(length(z[3]) + coalesce(length(z[1]), 0)) OVER (PARTITION BY uid, place ORDER BY i) AS after
  FROM u
),
f AS (
  SELECT uid, place, kind, CAST(after - length(m) AS BIGINT) AS a, CAST(after AS BIGINT) AS b
  FROM s WHERE m IS NOT NULL AND length(g) >= least
),
x AS (
  SELECT uid, count_if(place = 0) AS n_assign, count_if(place = 1) AS n_access, count_if(place = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (WHERE place < 3), '') AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM f GROUP BY uid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (uid)
"""
