"""The SQL twin of the quality query."""

from __future__ import annotations

from newsloom.llm import quality as Q

_WHITE = r"[\x20\x09-\x0D]"
#: What a class of characters is not, as a pattern; the rules' symbols are no punctuation.
_CLASSES = {
    "upper": r"\p{Lu}\p{Lt}",
    "lower": r"\p{Ll}",
    "letter": r"\p{Lm}\p{Lo}\p{M}",
    "digit": r"\p{N}",
    "white": r"\p{Z}\x20\x09-\x0D",
}


def _number(inside: str, text: str = "t") -> str:
    return f"length(regexp_replace({text}, '[^{inside}]', '', 'g'))"


def _classes() -> str:
    """``k, n`` for each class of a text, in one list of structs."""
    rows = [f"{{'k': '{name}', 'n': {_number(inside)}}}" for name, inside in _CLASSES.items()]
    bare = r"regexp_replace(t, '[#*$%&|<>]', '', 'g')"
    rows.append(f"{{'k': 'mark', 'n': {_number(r'\p{P}', bare)}}}")
    rows.append(f"{{'k': 'symbol', 'n': {_number(r'\p{S}', bare)} + {_number(r'#*$%&|<>')}}}")
    rest = r"regexp_replace(t, '[\p{L}\p{M}\p{N}\p{Z}\p{P}\p{S}\x20\x09-\x0D]', '', 'g')"
    rows.append(f"{{'k': 'other', 'n': length({rest})}}")
    return f"[{', '.join(rows)}]"


def _judged(name: str, chosen: str) -> str:
    """Tables ``name`` of verdicts against the references of the rows ``chosen``."""
    parts = []
    for h, least, size, most in (("cls", Q.LEAST_CHARS, "word_chars", Q.MOST_CLASS), ("com", Q.LEAST_COMMON, "n_words", Q.MOST_COMMON)):
        parts.append(f"""
{name}_{h}_ref AS (
  SELECT lang, k, s / sum(s) OVER (PARTITION BY lang) AS q FROM (
    SELECT lang, k, CAST(sum(n * 1000000 // total) AS DOUBLE) AS s FROM {h} JOIN base USING (rid)
    WHERE lang IN (SELECT lang FROM largest) AND {chosen} GROUP BY lang, k)
),
{name}_{h}_far AS (
  SELECT rid, r.lang, sqrt(greatest(0, sum(
      (CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / 2
      - CASE WHEN p + q > 0 THEN (p + q) / 2 * log2((p + q) / 2) ELSE 0 END))) AS far
  FROM (SELECT rid, k, n / CAST(total AS DOUBLE) AS p FROM {h} WHERE total > 0) d JOIN {name}_{h}_ref r USING (k)
  GROUP BY rid, r.lang
),
{name}_{h} AS (
  SELECT rid, coalesce(min(CASE WHEN f.lang = b.lang THEN far END), min(far)) AS far
  FROM {name}_{h}_far f JOIN base b USING (rid) GROUP BY rid
),
{name}_{h}_bad AS (SELECT rid FROM {name}_{h} JOIN base USING (rid) WHERE {size} >= {least} AND far > {most})""")
    bad = " AND ".join(f"rid NOT IN (SELECT rid FROM {name}_{h}_bad)" for h in ("cls", "com"))
    parts.append(f"\n{name} AS (SELECT rid FROM base WHERE NOT base_failed AND {bad})")
    return ",".join(parts)


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '{_WHITE}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
),
spot AS (SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM spot JOIN (SELECT rid, g FROM spot GROUP BY rid, g HAVING count(*) > 1) USING (rid, g)),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
base AS (
  SELECT *, n_words < {Q.LEAST_WORDS} OR 100 * n_repeat_words > {Q.MOST_REPEATED} * n_words AS base_failed FROM (
    SELECT rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST({_number(r'^\x20\x09-\x0D').replace('[^^', '[')} AS BIGINT) AS word_chars,
      CAST({_number('#*$%&|<>')} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN rep USING (rid))
),
words AS (SELECT rid, lang, unnest(ws) AS word FROM w),
counted AS (SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY lang, word),
largest AS (SELECT lang FROM counted GROUP BY lang ORDER BY sum(n) DESC, lang LIMIT {Q.LANGUAGES}),
common AS (
  SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r
    FROM counted WHERE lang IN (SELECT lang FROM largest)) WHERE r <= {Q.COMMON}
),
cls AS (
  SELECT rid, k.k AS k, k.n AS n, sum(k.n) OVER (PARTITION BY rid) AS total
  FROM (SELECT rid, unnest({_classes()}) AS k FROM w)
),
known AS (SELECT rid, c.word AS k, count(*) AS n FROM words JOIN common c USING (word) GROUP BY rid, c.word),
com AS (
  SELECT g.rid, g.k, coalesce(CASE WHEN g.k = '' THEN n_words - coalesce(s.n, 0) ELSE known.n END, 0) AS n, n_words AS total
  FROM (SELECT rid, k FROM base, (SELECT word AS k FROM common UNION ALL SELECT '')) g JOIN base USING (rid)
  LEFT JOIN known ON known.rid = g.rid AND known.k = g.k
  LEFT JOIN (SELECT rid, sum(n) AS n FROM known GROUP BY rid) s ON s.rid = g.rid
),{_judged("first", "NOT base_failed")},{_judged("final", "rid IN (SELECT rid FROM first)")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  rid IN (SELECT rid FROM final) AS kept FROM base
"""
